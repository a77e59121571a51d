"""Line dedup with DataFrame functions only: overlapping windows of three lines, hashed, found globally, removed after their first place.

A window is three consecutive lines that hold more than white space, compared without white space around them. Its first
occurrence, by (doc_id, line), stays; every line of every later occurrence goes, with blank lines inside it. Each line text
that goes stays at some earlier place, since a later occurrence always refers to an earlier one. Windows are counted with
map-side aggregation and joined to their first places. Those of more than one window in SHARES are at most SHARES different
ones; they are broadcast, so that no window's places meet in one task, and the others are joined by a shuffle.

Defined results: null text stays null; empty texts and texts of fewer than three lines with words have no windows and stay.
Rows that repeat both doc_id and text are one document: their windows count once and they are cleaned alike. A null doc_id
orders before all others. Extra columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import _shared as sh

LINES = 3
#: A window is heavy from this share of all windows on; so there can be no more heavy ones than this.
SHARES = 1000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, first and last line (from 0), and two hashes of every window of documents(doc_id, text)."""
    docs = sh.typed(documents, doc_id="long", text="string").select("doc_id", F.xxhash64("text").alias("text_hash"), _lines(F.col("text")).alias("lines"))
    stripped = lambda x: F.regexp_replace(x, r"^[\s]+|[\s]+$", "")
    hashed = F.transform("lines", lambda x, i: F.struct(i.alias("at"), F.xxhash64(stripped(x)).alias("hash"), F.hash(stripped(x)).alias("check")))
    blank = F.xxhash64(F.lit("")), F.hash(F.lit(""))
    full = docs.select("doc_id", "text_hash", F.filter(hashed, lambda x: (x["hash"] != blank[0]) | (x["check"] != blank[1])).alias("full"))
    full = full.select("doc_id", "text_hash", "full", F.size("full").alias("n")).where(f"n >= {LINES}")
    full_lines = F.col("full")

    def window(i: Column) -> Column:
        part = [full_lines[i + k] for k in range(LINES)]
        return F.struct(part[0]["at"].alias("first"), part[-1]["at"].alias("last"), F.xxhash64(*(x["hash"] for x in part)).alias("hash"), F.xxhash64(*(x["check"] for x in part)).alias("check"))

    each = full.select("doc_id", "text_hash", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - LINES), window)).alias("w"))
    return each.select("doc_id", "text_hash", "w.*")


def repeated_lines(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash and the ascending line numbers that later occurrences of windows cover, for documents that have any."""
    each = sh.written(windows(documents).distinct(), "lines")
    place = F.struct("doc_id", "text_hash", "first")
    repeats = sh.written(each.groupBy("hash", "check").agg(F.min(place).alias("origin"), F.count("*").alias("n")).where("n > 1"), "repeats")
    least = each.count() // SHARES
    heavy, light = repeats.where(F.col("n") > least).drop("n"), repeats.where(F.col("n") <= least).drop("n")
    rest = each.join(F.broadcast(heavy.select("hash", "check")), ["hash", "check"], "left_anti")
    later = each.join(F.broadcast(heavy), ["hash", "check"]).unionByName(rest.join(light, ["hash", "check"])).where(~place.eqNullSafe(F.col("origin")))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform(F.collect_list(F.struct("first", "last")), lambda s: F.sequence(s["first"], s["last"])))))
    return later.groupBy("doc_id", "text_hash").agg(covered.alias("covered"))


def dedup_lines(documents: DataFrame) -> DataFrame:
    """documents with the later occurrences cut out of text, and the new columns n_lines and n_removed."""
    sh.require(documents, "doc_id", "text")
    covered = repeated_lines(documents).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "covered")
    others = [c for c in documents.columns if c not in ("text", "n_lines", "n_removed")]
    text = F.col("text").cast("string")
    lined = documents.select(*others, _lines(text).alias("_lines"), F.xxhash64(text).alias("_text_hash"))
    joined = lined.join(covered, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left")
    n = F.size("_lines")
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.col("covered"))
    lines = F.col("_lines")
    cut = F.array_join(F.transform(kept, lambda i: lines[i]), "\n")
    new = {"text": F.when(F.col("covered").isNull(), F.array_join(lines, "\n")).otherwise(cut)}
    new["n_lines"] = F.when(lines.isNull(), F.lit(0)).otherwise(n).cast("long")
    new["n_removed"] = F.when(F.col("covered").isNull(), F.lit(0)).otherwise(F.size("covered")).cast("long")
    return joined.select(*(new.pop(c).alias(c) if c in new else F.col(c) for c in documents.columns), *(v.alias(k) for k, v in new.items()))
