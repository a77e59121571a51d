"""Data quality of ledger rows: codes per row, and the report with a row for each code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.keeping import keep

#: Codes for absent fields in order, codes that alone don't make an error, and keys of duplicates.
REQUIRED = {
    "autorizacao": "AUTORIZACAO_VAZIA", "nsu": "NSU_VAZIO", "valor_bruto": "VALOR_VAZIO", "parcela": "PARCELA_VAZIA",
    "numero_parcelas": "NUMERO_PARCELAS_VAZIO", "bandeira": "BANDEIRA_VAZIA", "modalidade": "MODALIDADE_VAZIA", "status": "STATUS_VAZIO",
}
WEAK = (
    "AUTORIZACAO_DUPLICADA", "NSU_DUPLICADO", "PARCELA_VAZIA", "NUMERO_PARCELAS_VAZIO", "BANDEIRA_VAZIA", "MODALIDADE_VAZIA", "STATUS_VAZIO",
    "NSU_FORMATO_INVALIDO", "VALOR_ZERADO", "NSU_VAZIO", "FORMA_PAGAMENTO_AUSENTE", "PARCELAMENTO_NAO_IDENTIFICADO",
    "DIVERGENCIA_PARCELAMENTO_FORMA_PAGAMENTO", "VALOR_BRUTO_INVALIDO",
)
DUPLICATES = {"AUTORIZACAO_DUPLICADA": ("autorizacao",), "NSU_DUPLICADO": ("nsu",), "PAGAMENTO_DUPLICADO": ("autorizacao", "nsu", "valor_bruto", "parcela")}
ALERT, ERROR = "ALERTA_CADASTRAL_SHIFT", "ERRO_CADASTRAL_SHIFT"


def cancelled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike("SIM|CANCEL|CONTEST")


def with_duplicates(rows: DataFrame) -> DataFrame:
    """A boolean column for each kind of duplicate. rows: a kept table.

    Counts are aggregated map-side, and rows with null keys stay out. Rows find the keys that are repeated by a semi-join, where a hot
    key's rows are one side only and adaptive execution may split them; the marks are joined back by ord, which is unique.
    """
    kept = rows
    marked = [kept.dropna(subset=list(keys)).join(kept.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), list(keys), "left_semi").select("ord", F.lit(code).alias("code")) for code, keys in DUPLICATES.items()]
    marks = reduce(DataFrame.union, marked).groupBy("ord").agg(*(F.bool_or(F.col("code") == code).alias(code) for code in DUPLICATES))
    return kept.join(marks, "ord", "left").withColumns({code: F.coalesce(code, F.lit(False)) for code in DUPLICATES})


def with_codes(ledger: DataFrame) -> DataFrame:
    """ledger, a kept table, with the array column codes, each code once, in the order of the checks. The codes are kept as a narrow table, which wide rows meet by ord."""
    needed = {*REQUIRED, "ord", "cancelamento", "autorizacao_erro", "_alertas_normalizacao", *(c for keys in DUPLICATES.values() for c in keys)}
    rows = with_duplicates(ledger.select(*needed))
    absent = [F.when(F.coalesce(F.col(c).cast("string").isin("", "NAO_INFORMADO"), F.lit(True)), F.lit(code)) for c, code in REQUIRED.items()]
    checks = [
        F.when((F.col("valor_bruto") == 0) & ~cancelled(F.col("cancelamento")), F.lit("VALOR_ZERADO")),
        F.when(F.coalesce("autorizacao_erro", F.lit("")) != "", F.lit("AUTORIZACAO_TAMANHO_INVALIDO")),
        F.when((F.col("nsu") != "") & ~F.col("nsu").rlike("^[A-Z0-9-]+$"), F.lit("NSU_FORMATO_INVALIDO")),
    ]
    repeated = [F.when(F.col(code), F.lit(code)) for code in DUPLICATES]
    found = F.concat(F.array(*absent, *checks), F.col("_alertas_normalizacao"), F.array(*repeated))
    codes = keep(rows.select("ord", F.array_distinct(F.array_compact(found)).alias("codes")), "codes")
    return ledger.join(codes, "ord").select(*ledger.columns, "codes")


def classification(code: Column) -> Column:
    return F.when(code.isin(*WEAK), F.lit(ALERT)).otherwise(F.lit(ERROR))


def report(with_codes_: DataFrame) -> DataFrame:
    """A row for each code of each ledger row."""
    each = with_codes_.select("ord", "_row", "raw_autorizacao", "autorizacao", "nsu", F.posexplode("codes").alias("place", "problema"))
    return each.select(
        "ord", "place", F.col("_row").alias("linha_shift"), F.col("raw_autorizacao").alias("autorizacao_original"), F.col("autorizacao").alias("autorizacao_normalizada"), "nsu", "problema",
        classification(F.col("problema")).alias("classificacao"),
    )
