"""XLSX workbooks: sheets are chosen by name or by how much a row looks like a header; rows are read in Spark tasks.

A workbook is one uploaded file, a zip archive of XML parts, so one task streams through it; many are read side by side.
Cells come as text: numbers as written (dates are serial numbers, which the date rule knows), booleans as True or False.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators.keeping import keep
from ledgerloom.sources.headers import folded, header_score
from ledgerloom.sources.records import NULLS, unique_names, unnamed

CHOICE_ROWS, HEADER_ROWS, LEAST_SCORE = 20, 25, 2
#: The sheet that is taken wherever it exists.
USUAL = "pagamentos"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _sheets(archive: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Name and part of each sheet, in order."""
    parts = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    found = ElementTree.fromstring(archive.read("xl/workbook.xml")).iter(f"{MAIN}sheet")
    return [(s.get("name", ""), "xl/" + parts[s.get(RELATION)].removeprefix("/").removeprefix("xl/")) for s in found]


def _text(element: ElementTree.Element) -> str:
    """The text of a shared or inline string, without phonetic hints."""
    return "".join(t.text or "" for child in element for t in ([child] if child.tag == f"{MAIN}t" else child.findall(f"{MAIN}t") if child.tag == f"{MAIN}r" else []))


def _number(text: str) -> str:
    if not re.search("[eE]", text):
        return text
    value = float(text)
    return str(int(value)) if value.is_integer() else repr(value)


def _place(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _rows(archive: zipfile.ZipFile, part: str) -> Iterator[tuple[int, list[str | None]]]:
    """Number (from 0) and cells of each row of a sheet that has any."""
    shared: list[str] = []
    if "xl/sharedStrings.xml" in archive.namelist():
        with archive.open("xl/sharedStrings.xml") as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag == f"{MAIN}si":
                    shared.append(_text(e))
                    e.clear()
    with archive.open(part) as f:
        last = -1
        for _, e in ElementTree.iterparse(f):
            if e.tag != f"{MAIN}row":
                continue
            last = int(e.get("r", last + 2)) - 1
            cells: list[str | None] = []
            for c in e.findall(f"{MAIN}c"):
                at = _place(c.get("r", "")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                kind, value = c.get("t", "n"), c.find(f"{MAIN}v")
                if kind == "inlineStr":
                    own = c.find(f"{MAIN}is")
                    cells[at] = _text(own) if own is not None else None
                elif value is not None and value.text is not None:
                    cells[at] = shared[int(value.text)] if kind == "s" else {"0": "False", "1": "True"}.get(value.text, value.text) if kind == "b" else _number(value.text) if kind == "n" else value.text
            yield last, cells
            e.clear()


def _read(spark: SparkSession, path: str, rows: Callable[[zipfile.ZipFile], Iterator[tuple[str, int, list[str | None]]]]) -> DataFrame:
    """sheet, n and cells of what rows() yields for the workbook."""
    name = path.rsplit("/", 1)[-1]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile as e:
                    raise ValueError(f"Não foi possível abrir o arquivo Excel '{name}': {e}") from e
                held: list[tuple] = []
                for row in rows(archive):
                    held.append(row)
                    if len(held) == 1000:
                        yield _batch(held)
                        held = []
                yield _batch(held)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "sheet string, n bigint, cells array<string>")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["sheet", "n", "cells"])


def _previews(spark: SparkSession, path: str) -> dict[str, list[tuple[int, list[str | None]]]]:
    """The first rows of each sheet, in the order of the sheets."""

    def first(archive: zipfile.ZipFile) -> Iterator[tuple[str, int, list[str | None]]]:
        for name, part in _sheets(archive):
            yield name, -1, []
            for n, cells in _rows(archive, part):
                if n >= HEADER_ROWS:
                    break
                yield name, n, cells

    out: dict[str, list[tuple[int, list[str | None]]]] = {}
    for r in _read(spark, path, first).collect():
        own = out.setdefault(r["sheet"], [])
        if r["n"] >= 0:
            own.append((r["n"], r["cells"]))
    return out


def list_sheets(spark: SparkSession, path: str) -> list[str]:
    """The sheets of a workbook; none for other files."""
    return list(_previews(spark, path)) if path.lower().endswith(".xlsx") else []


def choose_sheet(previews: dict[str, list[tuple[int, list[str | None]]]], requested: str | None = None) -> str:
    """The requested sheet (an error if there is none), else the usual one, else the first with the best header row."""
    if requested:
        if requested not in previews:
            raise ValueError(f"Aba '{requested}' não encontrada. Disponíveis: {list(previews)}")
        return requested
    for name in previews:
        if folded(name) == USUAL:
            return name
    score = lambda name: max((header_score(cells) for n, cells in previews[name] if n < CHOICE_ROWS), default=0)
    return max(previews, key=score)


def read(spark: SparkSession, path: str, sheet: str | None = None) -> tuple[DataFrame, str]:
    """A sheet as text columns with ord and _line, and its name."""
    previews = _previews(spark, path)
    chosen = choose_sheet(previews, sheet)
    own = previews[chosen]
    scores = [header_score(cells) for _, cells in own]
    at = scores.index(max(scores)) if scores and max(scores) >= LEAST_SCORE else 0
    if not own:
        return spark.createDataFrame([], "ord bigint, _line bigint"), chosen
    begins, header = own[at]
    rows = keep(_read(spark, path, lambda archive: ((name, n, cells) for name, part in _sheets(archive) if name == chosen for n, cells in _rows(archive, part) if n > begins)), "sheet")
    width = max(len(header), rows.agg(F.max(F.size("cells"))).first()[0] or 0)
    names = unique_names([*header, *[None] * (width - len(header))])
    value = lambda k: F.get("cells", F.lit(k))
    return pruned(rows.select("n", *(F.when(~value(k).isin(*NULLS), value(k)).alias(x) for k, x in enumerate(names)))), chosen


def pruned(rows: DataFrame) -> DataFrame:
    """Without empty rows, empty columns, and unnamed columns that are blank; ord and _line count what stays."""
    names = [c for c in rows.columns if c != "n"]
    if not names:
        return rows.select(F.col("n").alias("ord"), F.col("n").alias("_line"))
    some = F.coalesce(*(F.col(f"`{c}`") for c in names)).isNotNull()
    full = rows.agg(*(F.count_if(F.trim(f"`{c}`") != "" if unnamed(c) else F.col(f"`{c}`").isNotNull()).alias(f"k{k}") for k, c in enumerate(names))).first()
    kept = [c for k, c in enumerate(names) if full[k]]
    line = F.row_number().over(Window.orderBy("n")) - 1  # one sheet
    return rows.where(some).withColumn("_line", line.cast("bigint")).select(F.col("_line").alias("ord"), "_line", *(F.col(f"`{c}`") for c in kept))
