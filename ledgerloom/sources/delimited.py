"""One delimited file as a table: a CSV export, or the ledger's financial report. Many files are read together by records.py and uploads.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import prepare
from ledgerloom.operators.schema import ONE_OF_REPORT, REQUIRED_OF_REPORT
from ledgerloom.sources import records

#: Why rows are left out of the financial report.
NOT_CARD, NOT_CARD_NOTE = "FORMA_PAGAMENTO_NAO_CARTAO", "Linha ignorada porque não foi identificada como pagamento de cartão Rede."


def check_format(path: str) -> None:
    if not path.lower().endswith(".csv"):
        raise ValueError("Formato não suportado. Envie CSV, XLS ou XLSX.")


def check_report(names: list[str]) -> None:
    if not any(name in names for name in ONE_OF_REPORT):
        raise ValueError('Não foi possível identificar pagamentos de cartão porque o relatório não possui "Espécie" nem "Forma de pagamento/cobrança".')
    if missing := [f'"{name}"' for name in REQUIRED_OF_REPORT if name not in names]:
        raise ValueError(f"O relatório do Shift não contém a coluna essencial {' e '.join(missing)}.")


def _table(found: records.Records, *more: str) -> DataFrame:
    """The rows of one file as columns named by its header."""
    own = next(iter(found.shapes.values()), [])
    return found.rows.select(F.col("n").alias("ord"), F.col("n").alias("_line"), *more, *(F.get("cells", F.lit(k)).alias(x) for k, x in own))


def is_report(spark: SparkSession, path: str) -> bool:
    """Whether a file is the ledger's financial report: one of its first lines is that report's header."""
    return records.reports(spark, [path])[0]


def read(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file as text columns with ord and _line. Other formats are an error."""
    check_format(path)
    return _table(records.read(spark, [path]))


def card_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A report's card rows, and the discard report of the others."""
    card, other = prepare.card_scope(rows)
    return card, prepare.discards(other, "SHIFT", NOT_CARD, NOT_CARD_NOTE)


def read_report(spark: SparkSession, path: str, scope: str = "card") -> tuple[DataFrame, DataFrame]:
    """The card rows of the ledger's financial report with _source_line, and the discard report of the others. A blank file gives neither.

    scope: anything but "card" keeps all rows.
    """
    found = records.read(spark, [path], as_report=True)
    if not found.shapes:
        nothing = spark.createDataFrame([], "ord bigint, _line bigint")
        return nothing, prepare.discards(nothing, "SHIFT", NOT_CARD)
    rows = _table(found, "_source_line")
    check_report(rows.columns)
    if scope != "card":
        return rows, prepare.discards(rows.limit(0), "SHIFT", NOT_CARD)
    return card_rows(rows)
