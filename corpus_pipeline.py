"""A corpus pipeline: quality, line dedup, near-duplicates, benchmark decontamination, packing.

STAGES holds (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and reread as the next one's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontamination, line_dedup, near_duplicates, packing, quality
from ledgerloom.llm._shared import table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; texts without words are rejected. Labels of fewer than two classes make no classifier, so nothing is rejected then."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    if not model.weights:
        return docs
    return quality.score(docs, model).where("predicted = 1").select(docs.columns)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows; a document that loses all its words goes."""
    cut = line_dedup.dedup_lines(docs).where(r"n_removed = 0 or text rlike '\\S'")
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", changed).select(docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest doc_id; rows that repeat id and text come once. An empty table stays empty."""
    return near_duplicates.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window. Null texts stay; with an empty benchmark all stay."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    return packing.pack_documents(docs, with_ids=False)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", cut_repeated_lines),
    ("near-duplicates", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: A trained classifier decides which documents stay, which SQL can't express; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
