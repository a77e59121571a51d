"""Benchmark decontamination with DataFrame functions only: a broadcast hash set of benchmark windows meets every training window.

Words are runs of characters other than ASCII separators after A-Z is lower-cased. A benchmark item's windows are its runs
of WINDOW consecutive words; a shorter item, if it has words, is one window. Every document's windows of those lengths are
hashed, exploded once and joined on the hash; a hit counts only if a second, independent hash of the window agrees too.
The hash set is broadcast up to MOST_BROADCAST windows, which bounds it at some 100 MB, and joined by a shuffle beyond.

Defined results: null text has no words and no hits. Rows that repeat both doc_id and text are one document and give one
row of contamination(); decontaminate() keeps or drops them alike. Items without words take no part; rows that repeat
an item_id add windows to the same item. Items without an id hit like others; together they are one null in item_ids, which
op9 counts as one item and leaves out of items_sha256. Extra columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import _shared as sh

WINDOW = 10
MOST_BROADCAST = 1_000_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(sh.ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _windows(hashes: Column, n: Column, length: Column | int) -> Column:
    """Structs of the place, length, hash and check of each window of that length."""
    length = F.lit(length) if isinstance(length, int) else length

    def window(at: Column) -> Column:
        part = F.slice(hashes, at + 1, length)
        return F.struct(at.alias("at"), length.alias("length"), F.xxhash64(part).alias("hash"), F.hash(part).alias("check"))

    return F.transform(F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>")), window)


def _hashed(df: DataFrame, *keys: str) -> DataFrame:
    """keys, the hashes of the words and their number; the number refers to the hashes too, so they are made once."""
    hashed = df.select(*keys, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"))
    return hashed.select(*keys, "hashes", F.size("hashes").alias("n"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """hash, check, length and item_id of every distinct window of benchmark(item_id, text)."""
    items = _hashed(sh.typed(benchmark, item_id="long", text="string"), "item_id").where("n > 0")
    each = items.select("item_id", F.explode(_windows(F.col("hashes"), F.col("n"), F.least(F.lit(window), F.col("n")))).alias("w"))
    return each.select("w.hash", "w.check", "w.length", "item_id").distinct()


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """For each of documents(doc_id, text): doc_id, text_hash, n_words, hit_words (places, ascending) and item_ids with occurring windows."""
    of_items = sh.written(benchmark_windows(benchmark, window), "windows")
    lengths = sorted(r["length"] for r in of_items.select("length").distinct().collect())  # at most `window` numbers
    size = of_items.count()
    mark = documents.sparkSession.range(1).select(F.lit(0).cast("long").alias("hash"), F.lit(None).cast("struct<check:int,length:int,item_id:bigint>").alias("item"))
    known = of_items.select("hash", F.struct("check", "length", "item_id").alias("item")).union(mark).groupBy("hash").agg(F.collect_list("item").alias("items"))

    docs = sh.typed(documents, doc_id="long", text="string").withColumn("text_hash", F.xxhash64("text"))
    hashed = _hashed(docs, "doc_id", "text_hash")
    # every document also sends a row of its own, at place -1, that carries its number of words: through a broadcast join as
    # a window that is always known, around a join by shuffle, where these rows would all have one key
    small = size <= most_broadcast
    own = F.array(F.struct(F.lit(-1).alias("at"), F.col("n").alias("length"), F.lit(0).cast("long").alias("hash"), F.lit(0).alias("check")))
    of_items_only = [_windows(F.col("hashes"), F.col("n"), k) for k in lengths]
    exploded = lambda df, *parts: df.select("doc_id", "text_hash", F.explode(F.flatten(F.array(*parts))).alias("w")).select("doc_id", "text_hash", "w.*")
    if small:
        found = exploded(hashed, own, *of_items_only).join(known.hint("broadcast"), "hash")
    else:
        hashed = sh.written(hashed, "hashed")
        found = exploded(hashed, *of_items_only).join(known.hint("merge"), "hash").unionByName(exploded(hashed, own).withColumn("items", F.lit(None).cast(known.schema["items"].dataType)))
    items = F.filter("items", lambda x: (x["check"] == F.col("check")) & (x["length"] == F.col("length")))
    found = found.select("doc_id", "text_hash", "at", "length", F.when(F.col("at") >= 0, F.transform(items, lambda x: x["item_id"])).alias("item_ids"))
    hits = found.where((F.col("at") < 0) | (F.size("item_ids") > 0))
    spans = F.collect_list(F.when(F.col("at") >= 0, F.struct("at", "length")))
    by_document = hits.groupBy("doc_id", "text_hash").agg(
        F.max(F.when(F.col("at") < 0, F.col("length"))).cast("long").alias("n_words"), spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids")
    )
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1)))))
    return by_document.select("doc_id", "text_hash", "n_words", covered.alias("hit_words"), "item_ids")


def decontaminate(documents: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW) -> DataFrame:
    """documents without the contaminated ones, or with the hit words (and the gaps after them) cut out where remove is "spans"."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove: {remove!r} is neither 'documents' nor 'spans'")
    hit = contamination(documents, benchmark, window).where(F.size("hit_words") > 0)
    key = [documents["doc_id"].eqNullSafe(hit["doc_id"]), F.xxhash64(documents["text"]) == hit["text_hash"]]
    if remove == "documents":
        return documents.join(hit, key, "left_anti")
    text = documents["text"].cast("string")
    joined = documents.join(hit, key, "left").select(*(documents[c] for c in documents.columns if c != "text"), text.alias("text"), hit["hit_words"])
    runs = F.flatten(F.array(F.array(F.lit("")), F.regexp_extract_all("text", F.lit(WORD_ANY_CASE), F.lit(0))))
    parts = F.zip_with(runs, F.split("text", WORD_ANY_CASE), lambda w, gap: F.concat(w, gap))  # 0: what comes before the first word
    hit_words = F.col("hit_words")
    cut = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains(hit_words, i - 1)), "")
    return joined.select(*(F.when(hit_words.isNotNull(), cut).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in documents.columns))
