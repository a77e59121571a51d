"""Ledger entries that one authorisation splits over several service orders become one row before matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import MONEY
from ledgerloom.operators.keeping import keep, keep_counted

CRITICAL = ("empresa", "data_shift_usada_para_match", "modalidade", "bandeira", "parcela", "numero_parcelas")
REPEATED = ("os_shift", "codigo_registro", "valor_bruto", "valor_liquido", "data_shift_usada_para_match", "parcela", "numero_parcelas")
SUMMED = ("valor_bruto", "valor_liquido", "valor_mdr", "valor_desconto")
#: Fixed values.
CRITERION = "AUTORIZACAO+EMPRESA+DATA_SHIFT+Bandeira+MODALIDADE+PARCELA+TOTAL_PARCELAS"
WHY = "Múltiplas O.S. da Shift com a mesma autorização foram consolidadas antes do matching."
LISTS = {
    "_rows_agrupadas": ("_row", ", "), "_codigos_conta_agrupados": ("codigo_conta", " | "), "_codigos_registro_agrupados": ("codigo_registro", " | "),
    "_autorizacoes_originais_agrupadas": ("raw_autorizacao", " | "), "_os_shift_agrupadas": ("os_shift", " | "),
    "_valores_brutos_originais_agrupados": ("valor_bruto", " | "), "_valores_liquidos_originais_agrupados": ("valor_liquido", " | "), "_descricoes_originais_agrupadas": ("descricao", " | "),
}
#: Groups come after all other rows, in the order of their first members.
AFTER = 1 << 61
#: Numbers of a stretch of ord in which a group's rows are put together first.
CHUNK = 1 << 14
#: So many authorisations of several rows at most, and kinds of exact duplicates, are sent to all tasks (some 100 bytes each).
FEW = 1 << 20


def _hash(*fields: str) -> Column:
    """64 bits for the fields; nulls are equal to each other and to nothing else."""
    return F.xxhash64(*(x for f in fields for x in (F.col(f), F.col(f).isNull())))


def _hashed(ledger: DataFrame) -> DataFrame:
    order = F.when(F.col("os_shift").isNotNull(), _hash("os_shift"))
    return ledger.select("ord", "autorizacao", _hash(*CRITICAL).alias("critical"), _hash(*REPEATED).alias("_same"), order.alias("order"))


def _per_authorization(hashed: DataFrame) -> DataFrame:
    """_of, n, ambiguous and _group of each authorisation: rows of one that is not ambiguous agree in all critical fields, so they are its only group."""
    per_auth = hashed.groupBy(F.col("autorizacao").alias("_of")).agg(
        F.count("*").alias("n"), (F.min("critical") != F.max("critical")).alias("ambiguous"), F.coalesce(F.min("order") != F.max("order"), F.lit(False)).alias("several"), F.min("ord").alias("first")
    )
    return per_auth.select("_of", "n", "ambiguous", F.when(F.col("several") & ~F.col("ambiguous"), F.col("first")).alias("_group"))


def counts(ledger: DataFrame) -> DataFrame:
    """One row: how many rows (rows), groups (groups) and rows in groups (grouped) consolidated() makes, without them."""
    own = _per_authorization(_hashed(ledger))
    in_group = F.when(F.col("_group").isNotNull(), F.col("n")).otherwise(0)
    one = own.agg(F.coalesce(F.sum(F.col("n") - in_group), F.lit(0)).alias("single"), F.count("_group").alias("groups"), F.coalesce(F.sum(in_group), F.lit(0)).alias("grouped"))
    return one.select((F.col("single") + F.col("groups")).alias("rows"), "groups", "grouped")


def _marked(ledger: DataFrame) -> DataFrame:
    """ledger with _ambiguous (its authorisation has rows that differ in critical fields), _repeated (an exact duplicate) and _group (null for single rows).

    One aggregation by authorisation tells all but the duplicates. Only authorisations of several rows are kept, and duplicates are sought
    among them. As long as they are FEW, all tasks get them and no ledger row is moved; otherwise narrow rows meet them, and the wide ones
    meet marks by ord.
    """
    hashed = _hashed(ledger)
    shared, n_shared = keep_counted(_per_authorization(hashed).where("n > 1").drop("n"), "shared")
    to_all = lambda df, n: F.broadcast(df) if n["n"] <= FEW else df
    among = to_all(shared.where("not ambiguous").select("_of"), n_shared)
    copies = hashed.join(among, F.col("autorizacao").eqNullSafe(F.col("_of")), "left_semi").groupBy(F.col("autorizacao").alias("_auth"), F.col("_same").alias("_twin")).agg(F.count("*").alias("n"))
    twins, n_twins = keep_counted(copies.where("n > 1").drop("n"), "twins")

    def met(rows: DataFrame) -> DataFrame:
        own = rows.join(to_all(shared, n_shared), F.col("autorizacao").eqNullSafe(F.col("_of")), "left").join(to_all(twins, n_twins), F.col("autorizacao").eqNullSafe(F.col("_auth")) & (F.col("_same") == F.col("_twin")), "left")
        marks = {"_ambiguous": F.coalesce("ambiguous", F.lit(False)), "_repeated": F.col("_twin").isNotNull()}
        return own.select(*(F.col(c) for c in ledger.columns if c in rows.columns), *(c.alias(name) for name, c in marks.items()), "_group")

    if n_shared["n"] <= FEW and n_twins["n"] <= FEW:
        return met(ledger.withColumn("_same", _hash(*REPEATED)))
    marks = keep(met(hashed).where("_ambiguous or _repeated or _group is not null").select("ord", "_ambiguous", "_repeated", "_group"), "marks")
    return ledger.join(marks, "ord", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("_ambiguous", "_repeated")})


def flagged(ledger: DataFrame) -> DataFrame:
    """Rows with _ambiguous and _repeated."""
    return _marked(ledger).drop("_group")


def consolidated(ledger: DataFrame) -> DataFrame:
    """Rows after consolidation, with _grouped, _linhas_agrupadas_shift and the lists of what each group holds (null for single rows).

    A group's rows are aggregated in two levels, first by stretches of CHUNK numbers of their order, each with its pieces of the lists:
    a hot group's rows spread over tasks, and what meets in one are the pieces, whose concatenation is the result.
    """
    rows = _marked(ledger)
    own = [c for c in rows.columns if c not in ("_group", *SUMMED)]
    in_order = lambda items: F.transform(F.filter(F.array_sort(items), lambda x: x["v"].isNotNull()), lambda x: x["v"])
    listed = lambda c: F.collect_list(F.struct("ord", F.col(c).cast("string").alias("v")))
    pieces = rows.where("_group is not null").groupBy("_group", F.floor(F.col("ord") / CHUNK).alias("chunk")).agg(
        F.min_by(F.struct(*own), "ord").alias("first"),
        *(F.sum(c).alias(c) for c in SUMMED),
        F.count("*").alias("n"),
        *(in_order(listed(c)).alias(name) for name, (c, _) in LISTS.items()),
    )
    joined = [F.when(F.size(name) > 0, F.array_join(name, separator)).alias(name) for name, (_, separator) in LISTS.items()]
    pieces = pieces.select("_group", "chunk", "first", *SUMMED, "n", *joined)
    grouped = pieces.groupBy("_group").agg(
        F.min_by("first", "chunk").alias("first"),
        *(F.sum(c).cast(MONEY).alias(c) for c in SUMMED),
        F.sum("n").alias("_linhas_agrupadas_shift"),
        *(F.array_join(in_order(F.collect_list(F.struct("chunk", F.col(name).alias("v")))), separator).alias(name) for name, (_, separator) in LISTS.items()),
    )
    merged = grouped.select("first.*", *SUMMED, "_linhas_agrupadas_shift", *LISTS).withColumns(
        {"ord": F.col("ord") + AFTER, "_grouped": F.lit(True), "_criterio_agrupamento": F.lit(CRITERION), "_motivo_agrupamento": F.lit(WHY)}
    )
    single = rows.where("_group is null").drop("_group").withColumn("_grouped", F.lit(False))
    return single.unionByName(merged, allowMissingColumns=True)
