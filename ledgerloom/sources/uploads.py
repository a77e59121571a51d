"""Uploaded files of one side, read together: each row knows its file, sheet, report date and line."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import report_date
from ledgerloom.operators import prepare, schema
from ledgerloom.sources import delimited, headers, records, workbook

#: ord of a row: the file's place among its side's files, then the row's in the file.
PER_FILE = 1 << 40
FORM = "Forma de pagamento/cobrança"


@dataclass(frozen=True)
class Upload:
    """A file of one side. origin is its place in the upload, such as REDE_01; name is what the user calls it."""

    path: str
    origin: str
    name: str
    category: str = ""
    sheet: str | None = None


def _base(upload: Upload) -> str:
    return upload.path.rsplit("/", 1)[-1]


def sheet(spark: SparkSession, upload: Upload) -> tuple[DataFrame, str]:
    """The rows of an XLSX file as text, and its sheet. Other formats are an error."""
    suffix = upload.path.lower().rpartition(".")[2]
    if suffix == "xls":
        raise ValueError("O formato XLS (binário) não é suportado. Salve o arquivo como XLSX ou CSV.")
    if suffix != "xlsx":
        delimited.check_format(upload.path)
    return workbook.read(spark, upload.path, upload.sheet)


def _is_csv(upload: Upload) -> bool:
    return upload.path.lower().endswith(".csv")


def _mapped(rows: DataFrame, source: str) -> DataFrame:
    fields = tuple(headers.CANONICAL)
    return schema.normalized(rows, source, headers.mapping([c for c in rows.columns if c not in ("ord", "_line")]), fields)


def _placed(df: DataFrame, k: Column | int) -> DataFrame:
    return df.withColumn("ord", F.col("ord") + k * F.lit(PER_FILE))


def _exports(spark: SparkSession, uploads: list[tuple[int, Upload]], source: str) -> DataFrame:
    """All CSV exports of one side in canonical form, in one scan, with the lineage of each row. uploads: with their places."""
    found = records.read(spark, [u.path for _, u in uploads])
    wanted = {}
    for shape, names in found.shapes.items():
        places = {x: k for k, x in names}
        wanted[shape] = {field: places[x] for field, x in headers.mapping(list(places)).items()}
    own = records.columns(found, wanted, list(headers.CANONICAL)).withColumnRenamed("n", "_line")
    files = [(k, place, u.name, u.origin, _base(u)) for k, (place, u) in enumerate(uploads)]
    about = spark.createDataFrame(files, "file int, place bigint, rede_arquivo_origem string, origem_id string, base string").withColumn("rede_data_relatorio", report_date(F.col("base"))).drop("base")
    rows = own.join(F.broadcast(about), "file").withColumn("ord", F.col("place") * PER_FILE + F.col("_line"))  # a row for each upload
    fields = tuple(headers.CANONICAL)
    return schema.normalized(rows, source, {f: f for f in fields}, fields, ("rede_arquivo_origem", "origem_id", "rede_data_relatorio"))


def _reports(spark: SparkSession, uploads: list[tuple[int, Upload]]) -> tuple[list[DataFrame], list[DataFrame]]:
    """The card rows of all financial reports in canonical form, in one scan, and their discards. Reports with a payment form's column and without raise other alerts."""
    found = records.read(spark, [u.path for _, u in uploads], as_report=True)
    about = spark.createDataFrame([(k, place, u.origin) for k, (place, u) in enumerate(uploads)], "file int, place bigint, origem_id string")
    rows, gone = [], []
    for with_form in (True, False):
        wanted = {}
        for shape, names in found.shapes.items():
            delimited.check_report([x for _, x in names])
            if (FORM in [x for _, x in names]) == with_form:
                wanted[shape] = {x: k for k, x in names}
        if wanted:
            names = sorted({x for own in wanted.values() for x in own})
            own = records.columns(found, wanted, names).withColumnRenamed("n", "_line").join(F.broadcast(about), "file").withColumn("ord", F.col("place") * PER_FILE + F.col("_line"))  # a row for each upload
            card, other = delimited.card_rows(own.drop("place", "file"))
            rows.append(schema.normalized_report(card))
            gone.append(other)
    return rows, gone


def acquirer(spark: SparkSession, uploads: list[Upload]) -> DataFrame:
    """All files of the acquirer in canonical form, with their lineage. Workbooks are read one by one."""
    own, exports = [], [(k, u) for k, u in enumerate(uploads) if _is_csv(u)]
    if exports:
        own.append(_exports(spark, exports, schema.ACQUIRER).withColumnRenamed("origem_id", "rede_origem_id"))
    for k, upload in enumerate(uploads):
        if not _is_csv(upload):
            rows, name = sheet(spark, upload)
            lineage = {"rede_arquivo_origem": F.lit(upload.name), "rede_origem_id": F.lit(upload.origin), "rede_aba_origem": F.lit(name), "rede_data_relatorio": report_date(F.lit(_base(upload)))}
            own.append(_placed(_mapped(rows, schema.ACQUIRER), k).withColumns(lineage))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), own)
    return schema.acquirer(rows.withColumns({"rede_linha_original": F.col("_row"), "rede_duplicado_entre_arquivos": F.lit(False)}))


@dataclass(frozen=True)
class LedgerRows:
    """rows in canonical form with origem_id; discards of the financial reports; whether any file was one."""

    rows: DataFrame
    discards: DataFrame
    reports: bool


def ledger(spark: SparkSession, uploads: list[Upload]) -> LedgerRows:
    csv = [(k, u) for k, u in enumerate(uploads) if _is_csv(u)]
    told = dict(zip((k for k, _ in csv), records.reports(spark, [u.path for _, u in csv]), strict=True)) if csv else {}
    reports, exports = [(k, u) for k, u in csv if told[k]], [(k, u) for k, u in csv if not told[k]]
    own, gone = _reports(spark, reports) if reports else ([], [])
    if exports:
        own.append(_exports(spark, exports, schema.LEDGER).drop("rede_arquivo_origem", "rede_data_relatorio"))
    for k, upload in enumerate(uploads):
        if not _is_csv(upload):
            own.append(_placed(_mapped(sheet(spark, upload)[0], schema.LEDGER), k).withColumn("origem_id", F.lit(upload.origin)))
    empty = schema.ledger(spark.createDataFrame([], "ord bigint")).withColumn("origem_id", F.lit(None).cast("string"))
    rows = schema.ledger(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), own)) if own else empty
    return LedgerRows(rows, prepare.all_discards(prepare.discards(empty.limit(0), "SHIFT", ""), *gone), bool(reports))
