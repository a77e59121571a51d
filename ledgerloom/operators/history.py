"""Queries on units and finished reconciliations; sources.store keeps their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def listed(reconciliations: DataFrame, units: DataFrame, unit: int | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Reconciliations with their unit's name as unidade, the newest first; unit, start and end (inclusive days) narrow them.

    The conditions stand on the columns that the stored table is partitioned by, so they prune its files.
    """
    own = reconciliations
    if unit is not None:
        own = own.where(F.col("unidade_id") == unit)
    if start:
        own = own.where(F.col("data_conciliacao") >= F.lit(start).cast("date"))
    if end:
        own = own.where(F.col("data_conciliacao") <= F.lit(end).cast("date"))
    names = units.select(F.col("id").alias("unidade_id"), F.col("nome").alias("unidade"))
    return own.join(names, "unidade_id").orderBy(F.desc("data_conciliacao"), F.desc("criado_em"))


def usage(units: DataFrame, reconciliations: DataFrame) -> DataFrame:
    """For each unit how many reconciliations it has, and whether it may be deleted: only without any."""
    counts = reconciliations.groupBy("unidade_id").agg(F.count("*").alias("conciliacoes"))
    n = F.coalesce("conciliacoes", F.lit(0).cast("bigint"))
    return units.select(F.col("id").alias("unidade_id")).join(counts, "unidade_id", "left").select("unidade_id", n.alias("conciliacoes"), (n == 0).alias("pode_excluir"))


def units_by_name(units: DataFrame) -> DataFrame:
    """Units in the order of their names, whatever their case: the names are compared under a collation, ties by number."""
    return units.orderBy(F.collate("nome", "UTF8_LCASE"), "id")


def with_files(reconciliations: DataFrame, files: DataFrame) -> DataFrame:
    """reconciliations with arquivos, a map of origin to its file (name, path, category)."""
    entry = F.struct("origem", F.struct("nome_original", "caminho_arquivo", "categoria").alias("arquivo"))
    own = files.groupBy("conciliacao_id").agg(F.map_from_entries(F.collect_list(entry)).alias("arquivos"))
    return reconciliations.join(own, reconciliations["id"] == own["conciliacao_id"], "left").drop("conciliacao_id")
