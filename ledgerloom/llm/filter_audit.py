"""How document filters interact: what each of five filters removes at every place of every order, by part of the corpus.

Each document is reduced to its part, five failure flags and two label flags, and counted by them: one row for each part and
combination of flags, made with map-side aggregation. CUBE over part and the five flags then holds, for every subset of the
filters, the row whose selected flags are all false: the documents that the subset lets through. A step of an order goes from
one subset to the subset with its filter, so each of the 600 steps joins a pair of subsets, and everything asked of a step is a
difference of two survivor counts. The filters themselves are never run in any order.

A text is a copy if a row of a smaller doc_id has the same text. Texts are told apart by their SHA-256; the least doc_id of each
is an aggregation, and its rows are found by a join on both text and doc_id, so that a text with a third of all rows is spread
by its ids. Parts, too, are only keys of counts.

Defined results: a null text is an empty one, and all empty ones are copies of each other; a null lang is the part ''. A row without
doc_id is no copy and makes none; rows that repeat id and text count each for themselves and are no copies of each other. A
document is good (toxic) if any of its labels says so. An empty table has no parts, so no rows. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import _shared as sh

#: The filters' letters; a subset of them is a mask with a bit for each, the first one's lowest.
FILTERS = "ABCDE"
WORD, SPACES = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
SYMBOLS = "[#$%&*|]"
COUNTED = ("n", "good", "toxic")
EVERY = (1 << len(FILTERS)) - 1


def failures(text: Column) -> dict[str, Column]:
    """The failure flags that a text has by itself: too short, repetitive, too many capitals, symbols."""
    words = F.regexp_count(text, F.lit(WORD))
    # a text of one word or more splits into its words and at most two empty strings, at the ends
    distinct = F.size(F.array_remove(F.array_distinct(F.split(text, SPACES)), ""))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    wide = lambda c: c.cast("long")
    return {
        "A": words < LEAST_WORDS,
        "B": 100 * wide(distinct) < LEAST_DISTINCT * wide(words),
        "C": 100 * wide(capitals) > MOST_CAPITALS * wide(F.length(text)),
        "D": text.rlike(SYMBOLS),
    }


def flagged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic and the flags A to E of each of documents(doc_id, text, lang)."""
    docs = sh.typed(documents, doc_id="long", text="string", lang="string").fillna("", ["text", "lang"])
    own = docs.select("doc_id", F.col("lang").alias("part"), F.unhex(F.sha2("text", 256)).alias("content"), *(c.alias(k) for k, c in failures(F.col("text")).items()))
    own = sh.written(own, "flags")
    firsts = own.where("doc_id is not null").groupBy("content").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = sh.typed(labels, doc_id="long", quality="int", toxic="int").where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic"))
    told = own.join(firsts, ["content", "doc_id"], "left").join(known, "doc_id", "left")
    return told.select("part", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")), *FILTERS[:-1], (F.col("doc_id").isNotNull() & F.col("first").isNull()).alias(FILTERS[-1]))


def survivors(flags: DataFrame) -> DataFrame:
    """part, mask, n, good and toxic: what each subset of the filters lets through, zeros included."""
    combined = flags.groupBy("part", *FILTERS).agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    combined = sh.written(combined, "combinations")  # 32 rows a part at most
    cube = combined.cube("part", *FILTERS).agg(*(F.sum(c).alias(c) for c in COUNTED), *(F.grouping(c).alias(f"over_{c}") for c in ("part", *FILTERS)))
    # a subset's row has its own flags false and the others summed over
    passed = cube.where("over_part = 0").where(reduce(lambda a, b: a & b, (F.coalesce(~F.col(c), F.col(f"over_{c}") == 1) for c in FILTERS)))
    mask = reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.col(f"over_{c}") == 0, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(FILTERS)))
    found = passed.select("part", mask.alias("mask"), *COUNTED)
    subsets = combined.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(EVERY))).alias("mask"))
    return subsets.join(found, ["part", "mask"], "left").fillna(0, list(COUNTED))


def steps(spark) -> DataFrame:
    """filter_order, step, filter, and the subsets before and after it and of that filter alone and without it."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            own = 1 << FILTERS.index(letter)
            rows.append(("".join(order), step, letter, before, before | own, own, EVERY ^ own))
            before |= own
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, before int, after int, alone int, others int")


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley of every step of every order."""
    through = sh.written(survivors(flagged(documents, labels)), "survivors")
    named = lambda name, *columns: through.select("part", F.col("mask").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))
    # 600 rows of one order book for each part
    joined = named("before", *COUNTED).join(F.broadcast(steps(documents.sparkSession)), "before").join(named("after", *COUNTED), ["part", "after"])
    for name in ("alone", "others"):
        joined = joined.join(named(name, "n"), ["part", name])
    ends = through.where(F.col("mask").isin(0, EVERY)).groupBy("part").agg(F.sum(F.when(F.col("mask") == 0, F.col("n"))).alias("all"), F.sum(F.when(F.col("mask") == EVERY, F.col("n"))).alias("clean"))
    lost = lambda c: F.col(f"{c}_before") - F.col(f"{c}_after")
    out = joined.join(ends, "part").select(
        "part", "filter_order", "step", "filter", F.col("n_after").alias("kept"), lost("n").alias("removed"), (F.col("all") - F.col("n_alone") - lost("n")).alias("redundant"),
        (F.col("n_others") - F.col("clean")).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))
