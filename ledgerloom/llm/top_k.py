"""Exact top-k search by inner product over a pivot-distance index.

Vectors become integers, floor(1024 * x). A bounded sample of rows gives the pivots; every vector is keyed by its nearest
pivot and its distance to it, and a range-partitioned sort by (pivot, distance, id) cuts each pivot's cell into annuli of
bounded size, so a hot pivot or a vector with many copies only makes more annuli. An annulus also knows the least and the
largest distance of its vectors to every other pivot.

A query first meets its own annulus, which gives a bound: its k-th best score there. With 2 q.x = |q|^2 + |x|^2 - d(q, x)^2,
only vectors within r = sqrt(|q|^2 + max|x|^2 - 2 * bound) of q can reach the bound, and by the triangle inequality an annulus
whose distances to any pivot p are more than r away from d(q, p) holds none. Queries are broadcast in batches of at most
QUERY_BYTES and go to the annuli, which never move: each task expands its annuli outwards from every query, nearest first,
raises the query's bound on the way and stops at the first one out of reach. What is shuffled is at most k rows for each
query and task. Every pruning step is strict, so ties are never lost, and scores are exact integers.

How much is pruned depends on the data: annuli of clusters are narrow, but vectors without structure in many dimensions are
all about equally far apart, and no triangle inequality tells them from each other. The share of (query, annulus) pairs that
were visited is logged at level INFO.

Defined results: vectors that are null or empty or hold a null or non-finite component take no part, nor do rows with a null
vec_id. All others do: vectors so large that 64 bits might not hold a score (vectors.py) have annuli of their own, which nothing
prunes, and are multiplied as unbounded integers; a returned score that is no long raises an error. Vectors meet only vectors
of their own length. Rows with the query's own vec_id are not its candidates; other repeated rows are candidates
like any others, and a repeated query row is a query of its own. Ties go to the smaller vec_id. Fewer candidates than k: all
of them. Extra columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ledgerloom.llm import _shared as sh
from ledgerloom.llm import vectors as v

SCALE = 1024
#: The pivots are this many rows, the first by hash of their id.
PIVOTS = 64
#: An annulus has at most so many vectors and so many bytes of them.
BLOCK, BLOCK_BYTES = 2048, 1 << 20
#: Queries of one pass over the annuli: so many bytes are collected and broadcast at a time.
QUERY_BYTES = 16 << 20
#: Annuli that a task expands together, and queries that meet an annulus together.
RUN, TOGETHER = 16, 512
#: Distances are floats; bounds are widened by this share of the vectors' lengths, above their rounding up to 10,000 dimensions.
SLACK = 2e-6
NO_BOUND = v.LEAST
LOG = logging.getLogger(__name__)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between the rows of two matrices of scaled tame vectors."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        place = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        place = np.arange(len(scores))
    return place[np.lexsort((ids[place], -scores[place]))[:k]]


def reach(norms: np.ndarray, norm: float, bound: np.ndarray) -> np.ndarray:
    """How far from each query a vector of at most that squared length may be for a score that reaches the bound."""
    squared = np.where(bound == NO_BOUND, np.inf, norms + norm - 2 * bound.astype(np.float64))
    return np.sqrt(np.maximum(squared, 0)) + SLACK * (1 + np.sqrt(norms + norm))


class Queries:
    """Queries of one length in one batch, all tame or none, with what was found for each so far."""

    def __init__(self, rows: list[tuple], dim: int, tame: bool, centres: np.ndarray | None, component: str, k: int):
        self.k, self.tame = k, tame
        self.ids = np.concatenate([np.frombuffer(r[0], "<i8") for r in rows])
        self.values = np.concatenate([np.frombuffer(r[1], component).reshape(-1, dim) for r in rows])
        self.bound = np.concatenate([np.frombuffer(r[2], "<i8") for r in rows]).copy()
        self.scaled = v.scaled(self.values, SCALE)
        self.norms = v.squares(self.scaled) if tame else np.full(len(self.ids), np.inf)
        self.to_pivots = distances(self.scaled, centres) if centres is not None and tame else np.zeros((len(self.ids), 0))
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.visited = self.pairs = 0

    def expand(self, annuli: list[dict]) -> None:
        """Meet a run of annuli, each query from its nearest on until one is out of reach."""
        gaps = np.zeros((len(self.ids), len(annuli)))
        norms = np.array([a["norm"] for a in annuli])
        for i, a in enumerate(annuli):
            if self.to_pivots.shape[1] and a["tame"]:
                gaps[:, i] = np.maximum(np.maximum(a["low"] - self.to_pivots, self.to_pivots - a["high"]).max(1), 0)
        order = np.argsort(gaps, axis=1, kind="stable")
        going = np.arange(len(self.ids))
        self.pairs += gaps.size
        for turn in range(len(annuli)):
            now = order[going, turn]
            going = going[gaps[going, now] <= reach(self.norms[going], norms.max(), self.bound[going])]  # later ones are farther yet
            now = order[going, turn]
            for i in np.unique(now).tolist():
                near = going[now == i]
                near = near[gaps[near, i] <= reach(self.norms[near], norms[i], self.bound[near])]
                self.visited += len(near)
                for a in range(0, len(near), TOGETHER):
                    self.meet(near[a : a + TOGETHER], annuli[i])

    def meet(self, places: np.ndarray, annulus: dict) -> None:
        ids = annulus["ids"]
        scores = v.whole_products(self.scaled[places], annulus["scaled"]) if self.tame and annulus["tame"] else v.products(self.values[places], annulus["values"], SCALE)
        ok = (scores >= self.bound[places, None]) & (ids[None, :] != self.ids[places, None])
        for j in np.flatnonzero(ok.any(1)).tolist():
            q = int(places[j])
            s, i = scores[j, ok[j]], ids[ok[j]]
            if q in self.found:
                s, i = np.concatenate([self.found[q][0], s]), np.concatenate([self.found[q][1], i])
            place = best(s, i, self.k)
            self.found[q] = s[place], i[place]
            if len(place) == self.k:
                self.bound[q] = max(self.bound[q], s[place[-1]])


def _pivots(plain: DataFrame) -> dict[int, np.ndarray]:
    """Distinct tame vectors, scaled, of the first PIVOTS rows by hash, by length."""
    sample = plain.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(PIVOTS).toArrow()
    out: dict[int, np.ndarray] = {}
    for _, m in v.matrices(sample.column("v").combine_chunks()) if sample.num_rows else []:
        f = v.scaled(m, SCALE)
        f = np.unique(f[v.tame(f)], axis=0)
        if len(f):
            out[m.shape[1]] = f
    return out


def index(plain: DataFrame, centres: dict[int, np.ndarray], component: str) -> DataFrame:
    """The annuli of plain(vec_id, v, query): sorted runs of vectors of one cell, with their distances to all pivots. Cell -1 has no pivots; -2 holds what isn't tame."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, m in v.matrices(batch.column("v")):
                f, dim = v.scaled(m, SCALE), m.shape[1]
                fine = v.tame(f)
                pivot, distance = np.where(fine, -1, -2), np.zeros(len(rows))
                if dim in centres and fine.any():
                    d = distances(f[fine], centres[dim])
                    pivot[fine], distance[fine] = d.argmin(1), d.min(1)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(take), batch.column("query").take(take), pa.array([dim] * len(rows), pa.int32()), pa.array(pivot, pa.int32()), pa.array(distance, pa.float64()), sh.binary_array(m)],
                    names=["vec_id", "query", "dim", "pivot", "distance", "values"],
                )

    def annuli(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def annulus() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            dim, tame = t.column("dim")[0].as_py(), t.column("pivot")[0].as_py() > -2
            m = sh.binary_rows(t.column("values"), component, dim)
            f = v.scaled(m, SCALE)
            d = distances(f, centres[dim]) if dim in centres and tame else np.zeros((len(m), 0))
            ids, query = (np.asarray(t.column(c).to_numpy(zero_copy_only=False)).astype(kind) for c, kind in (("vec_id", "<i8"), ("query", "u1")))
            plain_values = [pa.array([x], kind) for x, kind in ((dim, pa.int32()), (tame, pa.bool_()), (float(v.squares(f).max()) if tame else np.inf, pa.float64()), (bool(query.any()), pa.bool_()))]
            return pa.RecordBatch.from_arrays([*plain_values, *(sh.binary_array(x.reshape(1, -1)) for x in (d.min(0), d.max(0), ids, query, m))], names=["dim", "tame", "norm", "asks", "low", "high", "ids", "query", "values"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.stack([batch.column(c).to_numpy() for c in ("dim", "pivot")], 1)
            cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                most = max(1, min(BLOCK, BLOCK_BYTES // (int(component[-1]) * int(cell[x, 0]))))
                if held and (held[-1].column("dim")[0].as_py(), held[-1].column("pivot")[0].as_py()) != tuple(cell[x].tolist()):
                    yield annulus()
                while x < y:
                    room = most - sum(b.num_rows for b in held)
                    held.append(batch.slice(x, min(room, y - x)))
                    x += held[-1].num_rows
                    if sum(b.num_rows for b in held) == most:
                        yield annulus()
        if held:
            yield annulus()

    columns = "vec_id long, query boolean, dim int, pivot int, distance double, values binary"
    order = ("dim", "pivot", "distance", "vec_id")
    in_order = plain.mapInArrow(keyed, columns).repartitionByRange(*order).sortWithinPartitions(*order)
    return sh.written(in_order.mapInArrow(annuli, "dim int, tame boolean, norm double, asks boolean, low binary, high binary, ids binary, query binary, values binary"), "annuli")


def _asked(blocks: DataFrame, component: str, k: int) -> DataFrame:
    """The queries of each annulus, each with the bound that its own annulus gives."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, m = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["values"], component).reshape(-1, r["dim"])
                f = v.scaled(m, SCALE)
                at = np.flatnonzero(np.frombuffer(r["query"], "u1"))
                bound = np.full(len(at), NO_BOUND)
                for first in range(0, len(at), TOGETHER):
                    some = at[first : first + TOGETHER]
                    for j, scores in enumerate(v.whole_products(f[some], f) if r["tame"] else v.products(m[some], m, SCALE), first):
                        scores = scores[ids != ids[at[j]]]
                        if len(scores) >= k:
                            bound[j] = np.partition(scores, len(scores) - k)[len(scores) - k]
                yield pa.RecordBatch.from_arrays([pa.array([r["dim"]], pa.int32()), pa.array([r["tame"]]), *(sh.binary_array(x.reshape(1, -1)) for x in (ids[at], m[at], bound))], names=["dim", "tame", "ids", "values", "bounds"])

    return sh.written(blocks.where("asks").select("dim", "tame", "ids", "query", "values").mapInArrow(ask, "dim int, tame boolean, ids binary, values binary, bounds binary"), "asked")


def _batches(asked: DataFrame) -> Iterator[list[Row]]:
    """Rows of asked, of which each has at most an annulus's bytes, in batches of about QUERY_BYTES. The driver holds one batch."""
    held, size = [], 0
    for row in asked.toLocalIterator():
        held.append(row)
        size += len(row["values"])
        if size >= QUERY_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _visited(blocks: DataFrame, batch: list[Row], number: int, centres: dict[int, np.ndarray], component: str, k: int) -> DataFrame:
    """For each query of the batch (asked, place) at most k rows from each task; and a row without a query with the pairs visited and all pairs."""
    by_kind: dict[tuple[int, bool], list[tuple]] = {}
    for row in batch:
        by_kind.setdefault((row["dim"], row["tame"]), []).append((bytes(row["ids"]), bytes(row["values"]), bytes(row["bounds"])))
    shared = blocks.sparkSession.sparkContext.broadcast(by_kind)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = {(dim, tame): Queries(rows, dim, tame, centres.get(dim), component, k) for (dim, tame), rows in shared.value.items()}
        runs: dict[int, list[dict]] = {dim: [] for dim, _ in queries}

        def expand(dim: int) -> None:
            for own, asking in queries.items():
                if own[0] == dim and runs[dim]:
                    asking.expand(runs[dim])
            runs[dim] = []

        for arrow in batches:
            for at in range(arrow.num_rows):
                r = arrow.slice(at, 1).to_pylist()[0]
                if r["dim"] not in runs:
                    continue
                own = {"norm": r["norm"], "tame": r["tame"], "ids": np.frombuffer(r["ids"], "<i8"), "values": np.frombuffer(r["values"], component).reshape(-1, r["dim"])}
                runs[r["dim"]].append(own | {"scaled": v.scaled(own["values"], SCALE)} | {c: np.frombuffer(r[c], "<f8") for c in ("low", "high")})
                if len(runs[r["dim"]]) == RUN:
                    expand(r["dim"])
        for dim in runs:
            expand(dim)
        for (dim, tame), own in queries.items():
            dim = dim if tame else -dim  # places are numbered apart
            n = [len(s) for s, _ in own.found.values()]
            place = np.repeat(np.array(list(own.found), np.int64), n)
            none = np.zeros(0, np.int64)
            scores, ids = (np.concatenate([none, *(x[c] for x in own.found.values())]) for c in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(place), number)), pa.array(np.full(len(place), dim), pa.int32()), pa.array(place), pa.array(own.ids[place]), pa.array(ids), pa.array(scores)], names=["asked", "dim", "place", "query_id", "vec_id", "score"]
            )
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in ((number, pa.int64()), (dim, pa.int32()), (None, pa.int64()), (None, pa.int64()), (own.visited, pa.int64()), (own.pairs, pa.int64()))], names=["asked", "dim", "place", "query_id", "vec_id", "score"])

    out = sh.written(blocks.drop("query", "asks").mapInArrow(visit, "asked long, dim int, place long, query_id long, vec_id long, score long"), "found")
    shared.unpersist()
    return out


def top_k(vectors: DataFrame, k: int, is_query: Column, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score for each row of vectors that is_query holds for, against all rows."""
    sh.require(vectors, id_column, vector_column)
    kind = v.component_type(vectors, vector_column)
    component = "<f4" if kind == "array<float>" else "<f8"
    plain = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast(kind).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query")).where("vec_id is not null and v is not null")
    centres = _pivots(plain)
    blocks = index(plain, centres, component)
    found = [_visited(blocks, batch, number, centres, component, k) for number, batch in enumerate(_batches(_asked(blocks, component, k)))]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    candidates = reduce(DataFrame.union, found)
    if LOG.isEnabledFor(logging.INFO):
        LOG.info("%d of %d (query, annulus) pairs visited", *visits(candidates))
    order = Window.partitionBy("query_id", "asked", "dim", "place").orderBy(F.desc("score"), "vec_id")
    ranked = candidates.where("place is not null").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", v.fits(F.col("score")).alias("score"))


def visits(candidates: DataFrame) -> tuple[int, int]:
    """How many (query, annulus) pairs were visited, and how many there are."""
    row = candidates.where("place is null").agg(F.sum("vec_id"), F.sum("score")).first()
    return row[0] or 0, row[1] or 0
