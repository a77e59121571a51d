"""Whole queries against plain loops: word-piece counts on the real vocabulary, both ways of decontamination, the pipeline with a trained classifier."""

import json

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import _shared, decontamination, language, near_duplicates, packing, quality, queries, token_counts

REAL = "/root/testdata/sf0.001"


def test_token_counts_against_a_plain_loop_on_the_real_vocabulary(spark):
    byte_of = token_counts._byte_of()
    with open(token_counts.default_vocabulary(), encoding="utf-8") as f:
        tokens = [bytes(byte_of[c] for c in x) for x in json.load(f)["model"]["vocab"] if all(c in byte_of for c in x)]
    single = {bytes([b]) for b in range(256)}
    begins, goes_on = {x[1:] for x in tokens if x[:1] == b" " and len(x) > 1} | single, {x for x in tokens if x[:1] != b" "} | single
    longest, known = max(map(len, tokens)), {}

    def count(word):
        if word not in known:
            at, n, left = 0, 0, word.encode()
            while at < len(left):
                pieces = goes_on if n else begins
                at += next(k for k in range(min(longest, len(left) - at), 0, -1) if left[at : at + k] in pieces)
                n += 1
            known[word] = n
        return known[word]

    texts = {r["doc_id"]: r["text"] or "" for r in _shared.table(spark, REAL, "documents").collect()}
    for r in queries.op5_token_counts(spark, REAL).collect():
        words = texts[r["doc_id"]].split()
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(map(count, words)))
    long = spark.createDataFrame([(1, "unbelievable " * 80_000), (1, "unbelievable " * 80_000), (None, "x" * 1_000_000)], "doc_id long, text string")
    got = [(r["doc_id"], r["n_tokens"]) for r in token_counts.token_counts(long).collect()]
    assert got.count((1, 80_000 * count("unbelievable"))) == 2 and (None, count("x" * 1_000_000)) in got


def test_decontamination_both_ways_and_by_spans(spark):
    docs, items = _shared.table(spark, REAL, "documents"), _shared.table(spark, REAL, "benchmark")
    first = items.orderBy("item_id").first()["text"]
    more = spark.createDataFrame([(None, f"before {first} after", "en", "s", 1), (9_000_001, f"Before, {first}... after " + "x " * 300_000, "en", "s", 1), (9_000_001, "other text", "en", "s", 1)], docs.schema)
    own = docs.unionByName(more)
    ways = [sorted(map(str, decontamination.contamination(own, items, most_broadcast=n).collect())) for n in (1_000_000, 0)]
    assert ways[0] == ways[1] and len(ways[0]) == own.count()
    cut = {(r["doc_id"], r["text"][:6]): r["text"] for r in decontamination.decontaminate(more, items, remove="spans").collect()}
    assert cut[None, "before"] == "before after" and cut[9_000_001, "Before"].startswith("Before, after x x ") and cut[9_000_001, "other "] == "other text"
    assert decontamination.decontaminate(more, items).count() == 1


def test_pipeline_with_a_trained_classifier(spark):
    """Each stage by its operator and its rule on what the one before kept; run() packs what they leave, every token once."""
    docs = _shared.table(spark, REAL, "documents")
    model = quality.fit(docs, _shared.table(spark, REAL, "labels"))
    accepted = {r["doc_id"] for r in quality.score(docs, model).where("predicted = 1").collect()}
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before, docs = docs, _shared.written(stage(spark, docs, REAL), f"stage-{k}")
        counts.append(docs.count())
        assert docs.columns == before.columns
        if k == 0:
            assert model.weights and {r["doc_id"] for r in docs.collect()} == accepted and 0 < counts[1] < counts[0]
        if k == 2:
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in near_duplicates.near_duplicates(before).where("kept").collect()}
    assert docs.join(decontamination.contamination(docs, _shared.table(spark, REAL, "benchmark")).where(F.size("hit_words") > 0), "doc_id").isEmpty()
    pieces = [tuple(r) for r in corpus_pipeline.run(spark, REAL).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()]
    assert sorted(pieces) == sorted(tuple(r) for r in packing.pack_documents(docs, with_ids=False).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect())
    print(f"pipeline: documents after each stage {counts}")


def test_quality_and_language_of_long_and_repeated_rows(spark):
    docs = _shared.table(spark, REAL, "documents").select("doc_id", "text", "lang")
    model = quality.fit(docs, _shared.table(spark, REAL, "labels"))
    speaker = language.fit(docs)
    one = docs.where("length(text) > 500").orderBy("doc_id").first()["text"]
    rows = spark.createDataFrame([(1, one), (1, one), (None, one), (2, (one + "\n") * (1_000_000 // len(one))), (3, "")], "doc_id long, text string").withColumn("score", F.lit("x"))
    scores = sorted((r["doc_id"] or 0, r["score"]) for r in quality.score(rows, model).collect())
    assert len({round(s, 12) for k, s in scores if k < 2}) == 1 and all(np.isfinite(s) and 0 <= s <= 1 for _, s in scores)
    told = [(r["doc_id"] or 0, r["lang_pred"], round(r["score"], 9)) for r in language.identify(rows.drop("score"), speaker).collect()]
    assert len({x[1:] for x in told if x[0] < 2}) == 1 and {x[1] for x in told if x[0] == 2} == {x[1] for x in told if x[0] == 1} and (3, "und") in [x[:2] for x in told]
