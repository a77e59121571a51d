"""Delimited files of any size and number, read in one scan: byte ranges are read by many tasks, and records keep their numbers.

Lines come from Spark's text source, which splits files, with the file and byte range that they are of. A quoted cell may hold line
ends, so whether a line begins a record depends on what is before it. Each line is a function of that one bit, and only lines
with quotes are other than the identity: they leave it set, clear it, or turn it. Within a byte range the bit is found for
both beginnings at once; the ranges' functions are then applied one after another (a row for each range), which tells the
beginning of each. Records get their numbers in the same way: counts of each range, and the sums of those before.

Rows are arrays of cells. Headers, separators, encodings and which columns are empty are facts of files, found by aggregation and
joined to the rows by file; only the distinct headers come to the driver. The number of jobs does not depend on that of files.

Defined results: lines end with a line feed, before which a carriage return goes; a file in which any line isn't UTF-8 is Latin-1;
a byte order mark goes. The separator is the one of ; , tab | that is most often in the first eight lines (reports: ;). Blank
records are none. Records of more cells than the header are skipped; missing cells are null, as are texts of NULLS. A quote
inside a cell that doesn't begin with one is a character like any other. An open quote at the end of a file is the last record.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators.keeping import keep
from ledgerloom.sources.headers import folded

SEPARATORS = (";", ",", "\t", "|")
PEEK_LINES, REPORT_PEEK_LINES = 8, 60
#: Where the ledger's financial report begins and ends, and texts that are nulls.
HEADER, FOOTER = "Empresa;", "Emitido por:"
NULLS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
#: Which columns have values is a bit for each; columns beyond so many count as having some.
MASK_BITS, MASKS = 62, 4
MARK = "﻿"


def named(paths: list[str], spark: SparkSession) -> DataFrame:
    """file and path of the files, as the scan names them. A row for each path that the caller lists."""
    system = lambda p: p.getFileSystem(spark._jsc.hadoopConfiguration())
    own = [spark._jvm.org.apache.hadoop.fs.Path(path) for path in paths]
    return spark.createDataFrame([(k, system(p).makeQualified(p).toUri().toString()) for k, p in enumerate(own)], "file int, path string").withColumn("path", _short("path"))


def _short(path: str) -> Column:
    """Local files have one slash or three."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, block, id and value of all lines: block is where the line's byte range begins, and id ascends within it."""
    text = spark.read.option("lineSep", "\n").text(sorted(set(paths)))
    own = text.select("value", _short("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    return own.join(F.broadcast(named(paths, spark)), "path").select("file", "block", "id", "value")


def peeked(own: DataFrame) -> DataFrame:
    """file and head, its first lines: only first byte ranges are read, and no more than these lines are kept of each."""
    first = Window.partitionBy("file").orderBy("id")
    few = own.where("block = 0").withColumn("at", F.row_number().over(first)).where(F.col("at") <= REPORT_PEEK_LINES)
    return few.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "value"))), lambda x: x["value"]).alias("head"))


def _is_report() -> Column:
    return F.exists("head", lambda x: F.ltrim(x, F.lit(MARK)).startswith(HEADER))


def _separator() -> Column:
    text = F.array_join(F.slice("head", 1, PEEK_LINES), "\n")
    counts = [F.length(text) - F.length(F.replace(text, F.lit(s), F.lit(""))) for s in SEPARATORS]
    most = F.greatest(*counts)
    own = F.lit(SEPARATORS[-1])
    for s, n in reversed(list(zip(SEPARATORS, counts, strict=True))):
        own = F.when(n == most, F.lit(s)).otherwise(own)
    return own


def reports(spark: SparkSession, paths: list[str]) -> list[bool]:
    """Whether each file is the ledger's financial report: one of its first lines is that report's header."""
    found = {r["file"] for r in peeked(lines(spark, paths)).where(_is_report()).select("file").collect()}
    return [k in found and p.lower().endswith(".csv") for k, p in enumerate(paths)]


def _by_separator(make) -> Column:
    """make(pattern of the separator), as the file has it."""
    out = F.lit(None)
    for s in SEPARATORS:
        out = F.when(F.col("sep") == s, make({"|": r"\|", "\t": r"\t"}.get(s, s))).otherwise(out)
    return out


_QUOTED = r'"[^"]*+(?:""[^"]*+)*+'


def _ends_inside(text: Column, inside: bool) -> Column:
    """Whether a line ends within a quoted cell, if it begins within one or not."""

    def pattern(s: str) -> str:
        fields = rf'(?:(?:{_QUOTED}"[^{s}]*+|[^"{s}][^{s}]*+|){s})*+{_QUOTED}\z'
        open_ = r'[^"]*+(?:""[^"]*+)*+'
        return rf'\A(?:{open_}\z|{open_}"[^{s}]*+{s}{fields})' if inside else rf"\A{fields}"

    return _by_separator(lambda s: text.rlike(pattern(s)))


def _cells(text: Column) -> Column:
    """The cells of a record, without their quotes."""
    raw = _by_separator(lambda s: F.regexp_extract_all(F.concat(F.col("sep"), text), F.lit(rf'{s}({_QUOTED}"[^{s}]*+|[^{s}]*+)'), F.lit(1)))
    closed = r'(?s)\A"([^"]*+(?:""[^"]*+)*+)"(.*)\z'
    plain = lambda x: F.when(x.startswith('"'), F.when(x.rlike(closed), F.concat(F.replace(F.regexp_extract(x, closed, 1), F.lit('""'), F.lit('"')), F.regexp_extract(x, closed, 2))).otherwise(F.substr(x, F.lit(2)))).otherwise(x)
    return F.transform(raw, lambda x: F.when(F.contains(x, F.lit('"')), plain(x)).otherwise(x))


def _facts(own: DataFrame, as_report: bool) -> DataFrame:
    """sep, latin, and of reports the place of the header and of the end, for each file."""
    spoilt = own.groupBy("file").agg(F.bool_or(~F.is_valid_utf8("value")).alias("latin"))
    if not as_report:
        return peeked(own).select("file", _separator().alias("sep")).join(spoilt, "file")
    place = lambda text: F.min(F.when(F.ltrim(F.col("value"), F.lit(MARK)).startswith(text), F.struct("block", "id")))
    bounds = own.groupBy("file").agg(place(HEADER).alias("begins"), place(FOOTER).alias("ends"))
    return bounds.join(spoilt, "file").withColumn("sep", F.lit(";"))


def _joined(text_lines: DataFrame) -> DataFrame:
    """file, block, id, sep and text of each record, the place of its first line. text_lines: file, block, id, sep, text."""
    quoted = F.contains("text", F.lit('"'))
    out_in, in_in = (F.when(quoted, F.coalesce(_ends_inside(F.col("text"), x), F.lit(False))).otherwise(F.lit(x)) for x in (False, True))
    own = text_lines.withColumns({"out_in": out_in, "in_in": in_in})
    # over the lines before: the last that leaves the bit set or cleared, whatever it was, and how many since then turn it
    w = Window.partitionBy("file", "block").orderBy("id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    turns, fixes = F.col("out_in") & ~F.col("in_in"), F.col("out_in") == F.col("in_in")
    own = own.withColumn("turned", F.coalesce(F.sum(F.when(turns, 1).otherwise(0)).over(w), F.lit(0)))
    own = own.withColumns({"fixed": F.last(F.when(fixes, F.struct(F.col("out_in").alias("bit"), "turned")), ignorenulls=True).over(before), "turned_before": F.coalesce(F.lag("turned").over(w), F.lit(0))})
    since = lambda bit: (bit.cast("int") + F.col("turned_before") - F.coalesce("fixed.turned", F.lit(0))) % 2 == 1
    own = own.withColumns({f"inside_{k}": since(F.coalesce("fixed.bit", F.lit(bool(k)))) for k in (0, 1)})
    own = own.withColumns({f"from_{k}": F.last(F.when(~F.col(f"inside_{k}"), F.col("id")), ignorenulls=True).over(w) for k in (0, 1)} | {f"next_{k}": F.lead(f"inside_{k}").over(w) for k in (0, 1)})
    kept = keep(own.select("file", "block", "id", "sep", "text", "inside_0", "inside_1", "from_0", "from_1", "next_0", "next_1", "out_in", "in_in"), "lines")
    # ranges one after another: the bit at each one's beginning, as functions of the bit at the file's beginning, which is clear
    ends = kept.groupBy("file", "block").agg(F.max_by(F.struct("inside_0", "inside_1", "out_in", "in_in", "from_0", "from_1"), "id").alias("e"))
    end = lambda k: F.when(F.col(f"e.inside_{k}"), F.col("e.in_in")).otherwise(F.col("e.out_in"))
    ranges = ends.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", end(0).alias("end_0"), end(1).alias("end_1"), F.col("e.from_0").alias("from_0"), F.col("e.from_1").alias("from_1")))).alias("ranges"))
    start = F.struct(F.lit(False).alias("bit"), F.lit(None).cast("bigint").alias("from"), F.lit(None).cast("bigint").alias("of"), F.array().cast("array<struct<block:bigint,bit:boolean,from:bigint,of:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        bit, begun = F.when(acc["bit"], x["end_1"]).otherwise(x["end_0"]), F.when(acc["bit"], x["from_1"]).otherwise(x["from_0"])
        out = F.array_append(acc["out"], F.struct(x["block"].alias("block"), acc["bit"].alias("bit"), acc["from"].alias("from"), acc["of"].alias("of")))
        return F.struct(bit.alias("bit"), F.coalesce(begun, acc["from"]).alias("from"), F.when(begun.isNotNull(), x["block"]).otherwise(acc["of"]).alias("of"), out.alias("out"))

    begins = ranges.select("file", F.inline(F.aggregate("ranges", start, step)["out"]))
    following = begins.select("file", "block", F.lead("bit").over(Window.partitionBy("file").orderBy("block")).alias("bit_after"))
    begins = begins.join(following, ["file", "block"])
    pick = lambda name: F.when(F.col("bit"), F.col(f"{name}_1")).otherwise(F.col(f"{name}_0"))
    told = kept.join(begins, ["file", "block"]).select(
        "file", "sep", "text", "id", "block", pick("inside").alias("inside"), F.coalesce(pick("from"), "from").alias("start"), F.when(pick("from").isNull(), F.col("of")).otherwise(F.col("block")).alias("start_block"),
        F.coalesce(pick("next"), "bit_after", F.lit(False)).alias("goes_on"),
    )
    whole = told.where("not inside and not goes_on").select("file", "block", "id", "sep", "text")
    # only lines of records over several lines meet
    parts = told.where("inside or goes_on").groupBy("file", F.col("start_block").alias("block"), F.col("start").alias("id")).agg(F.any_value("sep").alias("sep"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "id", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return whole.unionByName(parts.select(whole.columns))


@dataclass(frozen=True)
class Records:
    """rows: file, n (from 0, in the file's order), _source_line, shape and cells. shapes: the header and the filled columns of each shape."""

    rows: DataFrame
    shapes: dict[int, list[tuple[int, str]]]


def unique_names(header: list[str | None]) -> list[str]:
    """Column names of a header: empty ones are numbered, repeated ones get a number after a point."""
    seen: dict[str, int] = {}
    out = []
    for k, x in enumerate(header):
        x = (x or "").strip() or f"Unnamed: {k}"
        seen[x] = seen.get(x, -1) + 1
        out.append(f"{x}.{seen[x]}" if seen[x] else x)
    return out


def unnamed(name: str) -> bool:
    plain = folded(name)
    return plain.startswith("unnamed") or plain.startswith("coluna") and plain.removeprefix("coluna").strip().isdigit()


def _mask(k: int, test) -> Column:
    """A bit for each of the k-th MASK_BITS cells that test holds for."""
    bits = F.transform(F.slice("cells", k * MASK_BITS + 1, MASK_BITS), lambda x, i: F.when(test(x), F.expr("1L") * F.pow(F.lit(2.0), i).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def read(spark: SparkSession, paths: list[str], as_report: bool = False) -> Records:
    """The records of CSV files below their headers; of reports, those between the header and the footer, with the line numbers of the file.

    Without empty rows (reports: with them), records that are too long, empty columns, and unnamed columns that are blank. A report
    without its header is an error; blank files have no rows.
    """
    own = lines(spark, paths)
    facts = keep(_facts(own, as_report), "files")
    text = F.when(F.col("latin"), F.decode(F.col("value").cast("binary"), "ISO-8859-1")).otherwise(F.col("value"))
    text_lines = own.join(F.broadcast(facts), "file").withColumn("text", F.rtrim(F.when((F.col("block") == 0) & F.col("value").startswith(MARK), F.ltrim(F.col("value"), F.lit(MARK))).otherwise(text), F.lit("\r")))  # a row for each file
    if as_report:
        if not (lost := facts.where("begins is null")).isEmpty():
            blank = own.where(F.trim("value") != "").join(lost, "file", "left_semi")
            if not blank.isEmpty():
                raise ValueError(f'Não foi possível localizar o cabeçalho do relatório financeiro do Shift (linha iniciada por "{HEADER}").')
        place = F.struct("block", "id")
        numbered = text_lines.where("begins is not null and (block < begins.block or block = begins.block and id < begins.id)").groupBy("file").agg(F.count("*").alias("above"))
        text_lines = text_lines.where(F.col("begins").isNotNull() & (place >= F.col("begins")) & (F.col("ends").isNull() | (place < F.col("ends"))) & (F.trim("text") != ""))
    records = _joined(text_lines.select("file", "block", "id", "sep", "text")).where(F.trim(F.regexp_replace("text", r"\s", " ")) != "")
    cells = F.transform(_cells(F.col("text")), lambda x: F.when(~x.isin(*NULLS), x))
    parsed = keep(records.select("file", "block", "id", F.when(F.contains("text", F.lit('"')), cells).otherwise(F.transform(_by_separator(lambda s: F.split("text", s, -1)), lambda x: F.when(~x.isin(*NULLS), x))).alias("cells")), "records")
    heads = parsed.groupBy("file").agg(F.min_by("cells", F.struct("block", "id")).alias("head"), F.min(F.struct("block", "id")).alias("top"))
    below = parsed.join(F.broadcast(heads), "file").where((F.struct("block", "id") > F.col("top")) & (F.size("cells") <= F.size("head")))  # a row for each file
    if not as_report:
        below = below.where(F.exists("cells", lambda x: x.isNotNull()))
    order = Window.partitionBy("file", "block").orderBy("id")
    placed = keep(below.drop("top").withColumn("n", F.row_number().over(order) - 1), "placed")
    counts = placed.groupBy("file", "block").agg(F.count("*").alias("k"))
    offsets = counts.select("file", "block", F.coalesce(F.sum("k").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    given, some = (lambda x: x.isNotNull()), (lambda x: F.coalesce(F.trim(F.regexp_replace(x, r"\s", " ")) != "", F.lit(False)))
    masks = [f"{kind}{k}" for kind in ("given", "some") for k in range(MASKS)]
    filled = placed.groupBy("file").agg(F.any_value("head").alias("head"), *(F.bit_or(_mask(k, test)).alias(f"{kind}{k}") for kind, test in (("given", given), ("some", some)) for k in range(MASKS)))
    filled = keep(filled.withColumn("shape", F.xxhash64(F.to_json("head"), *masks)), "filled")
    shapes = {}
    for r in filled.dropDuplicates(["shape"]).collect():  # distinct headers, not files
        names = unique_names(r["head"])
        has = lambda kind, k, r=r: k >= MASK_BITS * MASKS or bool(r[f"{kind}{k // MASK_BITS}"] >> k % MASK_BITS & 1)
        shapes[r["shape"]] = [(k, x) for k, x in enumerate(names) if has("some" if unnamed(x) else "given", k)]
    rows = placed.drop("head").join(offsets, ["file", "block"]).join(F.broadcast(filled.select("file", "shape")), "file").withColumn("n", F.col("n") + F.col("offset"))
    line = F.lit(None).cast("bigint")
    if as_report:
        rows = rows.join(F.broadcast(numbered), "file", "left")
        line = F.col("n") + F.coalesce("above", F.lit(0)) + 2
    return Records(rows.select("file", "n", line.alias("_source_line"), "shape", "cells"), shapes)


def columns(records: Records, wanted: dict[int, dict[str, int]], names: list[str]) -> DataFrame:
    """records.rows with the columns names instead of cells. wanted: name to the cell's place, of each shape."""
    places = records.rows.sparkSession.createDataFrame([(s, own) for s, own in wanted.items()], "shape bigint, place map<string,int>")
    rows = records.rows.join(F.broadcast(places), "shape")  # a row for each distinct header
    return rows.select("file", "n", "_source_line", *(F.get("cells", F.element_at("place", F.lit(name))).alias(name) for name in names))
