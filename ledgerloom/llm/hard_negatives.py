"""Hard negatives: a distributed nearest-neighbour join over Voronoi cells of norm-augmented vectors.

Vectors are whole numbers, floor(256 * x), and scores their inner products. A candidate x gets one component more,
sqrt(M^2 - |x|^2) with M the largest length, and an anchor q a zero, so that d(q, x)^2 = |q|^2 + M^2 - 2 q.x: a higher score is a
shorter distance, and pivots and the triangle inequality bound scores. Every vector belongs to the Voronoi cell of its nearest
pivot. Candidates, sorted by label, cell and distance, are cut into blocks of bounded size, and anchors into groups; both know the
least and largest distance of their own to each pivot. A hot label, cell or vector with many copies only makes more blocks.

The join is made twice. For the positives, blocks that hold a cell's first vectors of one label say within which distance of the
pivot there are enough of them, which bounds how far each anchor's positives can be; a block is replicated to the groups that
have a label in common with it and may reach it within that bound. For the negatives, each positive's score gives an anchor a
band of distances, and a block goes to the groups with other labels whose bands it may meet. What is replicated meets its group
in shares of bounded size (cogrouped by group and share), each anchor's blocks from the nearest on, with the bound that its best
finds so far give; a share hands on the best few rows of each anchor, which a ranking over all shares merges. Pruning is strict
and scores are exact, so no tie is lost.

How much is pruned depends on the data, as in top_k: among vectors without structure every block goes to every group.

Defined results: rows with a null id, label or vector, with an empty one, or with a null or non-finite component take no part. All
others do, whatever their size (vectors.py); a positive whose score is no long raises an error. Vectors meet only vectors of
their own length. Rows with the anchor's own id are not its candidates; a repeated anchor row is an anchor of its own, and other
repeated rows are candidates like any others. Ties go to the smaller id, then by row. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import _shared as sh
from ledgerloom.llm import vectors as v
from ledgerloom.operators.keeping import settings

SCALE = 256
#: Pivots of a length, and the rows, the first by hash of their id, that they come from.
PIVOTS, PIVOT_ROWS = 16, 64
#: A block has at most so many vectors and bytes.
BLOCK, BLOCK_BYTES = 2048, 1 << 19
#: A group has at most so many anchors, or more where there would be over MOST_GROUPS: what is known of groups is broadcast, some 300 bytes each.
GROUP, MOST_GROUPS = 4096, 4096
#: Blocks of one share, so that a share is some 8 MB, and anchors that meet a block at a time.
SHARE, TOGETHER = 16, 512
#: Distances are doubles; bounds are widened by this share of the lengths, above their rounding up to 10,000 dimensions.
SLACK = 2e-6
NONE = v.LEAST


class Space:
    """The pivots of one length, augmented, and the largest squared length."""

    def __init__(self, pivots: np.ndarray, top: float):
        self.pivots, self.top = pivots, top
        self.own = v.squares(pivots)
        self.extra = np.sqrt(np.maximum(top - self.own, 0))

    @property
    def slack(self) -> float:
        return SLACK * (1 + 2 * np.sqrt(self.top))

    def of_candidates(self, f: np.ndarray) -> np.ndarray:
        extra = np.sqrt(np.maximum(self.top - v.squares(f), 0))
        return np.sqrt(np.maximum(2 * self.top - 2 * (f @ self.pivots.T + extra[:, None] * self.extra), 0))

    def of_anchors(self, f: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(v.squares(f)[:, None] + self.top - 2 * (f @ self.pivots.T), 0))

    def reach(self, norms: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """How far from an anchor a candidate of that score is; NONE is any distance."""
        return np.where(scores == NONE, np.inf, np.sqrt(np.maximum(norms + self.top - 2 * scores.astype(np.float64), 0)) + self.slack)


def spaces(plain: DataFrame) -> dict[int, Space]:
    """Of each length among the pivot rows."""
    rows = plain.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(PIVOT_ROWS).toArrow()
    pivots: dict[int, np.ndarray] = {}
    if rows.num_rows:
        for _, m in v.matrices(rows.column("v").combine_chunks()):
            f = v.scaled(m, SCALE)
            f = np.unique(f[v.tame(f)], axis=0)
            if len(f):
                pivots[m.shape[1]] = f[np.linspace(0, len(f) - 1, min(PIVOTS, len(f))).astype(int)]

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, m in v.matrices(batch.column("v")):
                f = v.scaled(m, SCALE)
                f = f[v.tame(f)]
                if m.shape[1] in pivots and len(f):
                    yield pa.RecordBatch.from_arrays([pa.array([m.shape[1]], pa.int32()), pa.array([float(v.squares(f).max())])], names=["dim", "top"])

    tops = plain.select("v").mapInArrow(largest, "dim int, top double").groupBy("dim").agg(F.max("top")).collect()  # lengths of pivots only
    return {dim: Space(pivots[dim], top) for dim, top in tops}


def keyed(plain: DataFrame, known: dict[int, Space]) -> DataFrame:
    """plain(vec_id, label, v) with cell and distance; a vector without a cell (-1) is beyond bounds, tame or not."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, m in v.matrices(batch.column("v")):
                f, dim = v.scaled(m, SCALE), m.shape[1]
                cell, distance = np.full(len(rows), -1), np.zeros(len(rows))
                fine = v.tame(f)
                if dim in known and fine.any():
                    d = known[dim].of_candidates(f[fine])
                    cell[fine] = d.argmin(1)
                    distance[fine] = d.min(1)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(take), batch.column("label").take(take), pa.array(np.full(len(rows), dim), pa.int32()), pa.array(cell, pa.int32()), pa.array(distance), sh.binary_array(m)],
                    names=["vec_id", "label", "dim", "cell", "distance", "values"],
                )

    return plain.mapInArrow(own, "vec_id long, label long, dim int, cell int, distance double, values binary")


def packed(plain: DataFrame, known: dict[int, Space], most: int, most_bytes: int, enough: int, kind: str, name: str, anchors: bool = False) -> DataFrame:
    """Runs of sorted vectors as rows: number, dim, bounded, the least and largest label, distances low and high to the pivots, sixth, ids, labels and values.

    bounded: the distances hold, as all vectors have a cell. sixth: the distance to the pivot of the cell within which enough ids of
    the run's one label and cell are; null without such.
    """
    component = "<f4" if kind == "array<float>" else "<f8"
    size = np.dtype(component).itemsize

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        made = 0

        def run() -> pa.RecordBatch:
            nonlocal made
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            dim, cells = t.column("dim")[0].as_py(), t.column("cell").to_numpy()
            m = sh.binary_rows(t.column("values").chunk(0), component, dim)
            ids, labels = (t.column(c).to_numpy().astype("<i8") for c in ("vec_id", "label"))
            low, high, sixth, bounded = np.zeros(0), np.zeros(0), None, bool(cells[0] >= 0)
            if bounded:
                f = v.scaled(m, SCALE)
                d = known[dim].of_anchors(f) if anchors else known[dim].of_candidates(f)
                low, high = d.min(0), d.max(0)
                if labels[0] == labels[-1] and cells[0] == cells[-1]:
                    to_own = np.sort(d[np.lexsort((d[:, cells[0]], ids)), cells[0]][np.unique(np.sort(ids), return_index=True)[1]])  # the nearest row of each id
                    sixth = float(to_own[enough - 1]) if len(to_own) >= enough else None
            made += 1
            values = [(TaskContext.get().partitionId() << 32) + made, dim, bounded, int(labels[0]), int(labels[-1]), int(cells[0]), low.tolist(), high.tolist(), sixth]
            kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]
            return pa.RecordBatch.from_arrays([*(pa.array([x], k) for x, k in zip(values, kinds, strict=True)), *(sh.binary_array(x.reshape(1, -1)) for x in (ids, labels, m))], names=names)

        names = ["number", "dim", "bounded", "label_min", "label_max", "cell", "low", "high", "sixth", "ids", "labels", "values"]
        for batch in batches:
            if not batch.num_rows:
                continue
            part = np.stack([batch.column("dim").to_numpy(), batch.column("cell").to_numpy() < 0], 1)
            cuts = [0, *(np.flatnonzero((part[1:] != part[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                room = max(1, min(most, most_bytes // (size * int(part[x, 0]))))
                if held and (held[-1].column("dim")[0].as_py(), held[-1].column("cell")[0].as_py() < 0) != (part[x, 0], bool(part[x, 1])):
                    yield run()
                while x < y:
                    held.append(batch.slice(x, min(room - sum(b.num_rows for b in held), y - x)))
                    x += held[-1].num_rows
                    if sum(b.num_rows for b in held) == room:
                        yield run()
        if held:
            yield run()

    order = (F.col("dim"), F.col("cell") < 0, F.col("label"), F.col("cell"), F.col("distance"), F.col("vec_id"), F.col("values"))
    out = keyed(plain, known).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "number long, dim int, bounded boolean, label_min long, label_max long, cell int, low array<double>, high array<double>, sixth double, ids binary, labels binary, values binary"
    return sh.written(out.mapInArrow(runs, schema), name)


class Group:
    """One group of anchors as a task or the driver needs it."""

    def __init__(self, row: dict, known: dict[int, Space], component: str):
        self.dim, self.bounded = row["dim"], row["bounded"]
        self.ids, self.labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        self.values = np.frombuffer(row["values"], component).reshape(-1, self.dim)
        self.scaled = v.scaled(self.values, SCALE)
        self.space = known[self.dim] if self.bounded else None
        if self.space is not None:
            self.norms, self.to_pivots = v.squares(self.scaled), self.space.of_anchors(self.scaled)

    def gaps(self, low: np.ndarray, high: np.ndarray, bounded: bool) -> tuple[np.ndarray, np.ndarray]:
        """Between which distances of each anchor a block's vectors are."""
        if self.space is None or not bounded:
            return np.zeros(len(self.ids)), np.full(len(self.ids), np.inf)
        near = np.maximum(np.maximum(low - self.to_pivots, self.to_pivots - high).max(1), 0)
        return near - self.space.slack, (self.to_pivots + high).min(1) + self.space.slack

    def scores(self, places: np.ndarray, block: dict) -> np.ndarray:
        if self.bounded and block["bounded"]:
            return v.whole_products(self.scaled[places], block["scaled"])
        return v.products(self.values[places], block["values"], SCALE)


def _block(row: dict, component: str) -> dict:
    values = np.frombuffer(row["values"], component).reshape(-1, row["dim"])
    out = {k: np.array(row[k]) for k in ("low", "high")} | {k: np.frombuffer(row[k], "<i8") for k in ("ids", "labels")}
    return out | {"bounded": row["bounded"], "values": values, "scaled": v.scaled(values, SCALE)}


class Best:
    """The k best finds of each of n seekers: scores (NONE where there is none), ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores, self.ids = np.full((n, k), NONE), np.zeros((n, k), np.int64)
        self.found = np.zeros(n, np.int64)

    @property
    def bound(self) -> np.ndarray:
        """The score that a further find must reach."""
        return np.where(self.found == self.k, self.scores[:, -1], NONE)

    def add(self, seekers: np.ndarray, ids: np.ndarray, scores: np.ndarray, allowed: np.ndarray) -> None:
        """Candidates ids, of which each seeker may take where allowed; scores and allowed have a row for each seeker."""
        if scores.shape[1] > self.k:
            # without those below the k-th best of the row
            masked = np.where(allowed, scores, NONE)
            kth = np.partition(masked, masked.shape[1] - self.k, 1)[:, masked.shape[1] - self.k]
            allowed = allowed & (scores >= kth[:, None])
        allowed = allowed & (scores >= self.bound[seekers, None])
        row, column = np.nonzero(allowed)
        if not len(row):
            return
        touched = np.unique(row)
        own = seekers[touched]
        old = np.nonzero(np.arange(self.k) < self.found[own, None])
        who = np.concatenate([seekers[row], own[old[0]]])
        s = np.concatenate([scores[row, column], self.scores[own][old]])
        i = np.concatenate([ids[column], self.ids[own][old]])
        order = np.lexsort((i, -s, who))
        who, s, i = who[order], s[order], i[order]
        first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        rank = np.arange(len(who)) - np.repeat(first, np.diff([*first, len(who)]))
        top = rank < self.k
        self.scores[who[top], rank[top]], self.ids[who[top], rank[top]] = s[top], i[top]
        self.found[own] = np.minimum(self.k, np.diff([*first, len(who)]))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Seekers, ids and scores of all finds."""
        seeker, rank = np.nonzero(np.arange(self.k) < self.found[:, None])
        return seeker, self.ids[seeker, rank], self.scores[seeker, rank]


def replicated(blocks: DataFrame, summary: list[dict], others: bool) -> DataFrame:
    """blocks with the number of each group that they might serve, and their share."""
    of_dim: dict[int, dict] = {}
    for dim in {g["dim"] for g in summary}:
        own = [g for g in summary if g["dim"] == dim]
        pivots = max(len(g["low"]) for g in own)
        wide = lambda g, side, value: np.array(g[side] if len(g[side]) == pivots else [value] * pivots, float)
        of_dim[dim] = {k: np.array([g[k] for g in own]) for k in ("number", "label_min", "label_max", "bounded", "nearest", "farthest")}
        of_dim[dim] |= {"low": np.array([wide(g, "low", 0.0) for g in own]), "high": np.array([wide(g, "high", np.inf) for g in own])}

    def serving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for r in batch.select(["dim", "bounded", "label_min", "label_max", "low", "high"]).to_pylist():
                g = of_dim.get(r["dim"])
                if g is None:
                    lists.append([])
                    continue
                if others:
                    ok = ~((g["label_min"] == r["label_max"]) & (g["label_max"] == r["label_min"]))
                else:
                    ok = (g["label_min"] <= r["label_max"]) & (g["label_max"] >= r["label_min"])
                if r["bounded"] and r["low"]:
                    low, high = np.array(r["low"]), np.array(r["high"])
                    near = np.maximum(np.maximum(low - g["high"], g["low"] - high).max(1), 0)
                    far = (g["high"] + high).min(1)
                    ok &= ~g["bounded"] | (near <= g["farthest"]) & (far >= g["nearest"])
                lists.append(g["number"][ok].tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int64()))], names=[*batch.schema.names, "groups"])

    return blocks.mapInArrow(serving, sh.with_fields(blocks.schema, groups=T.ArrayType(T.LongType())))


def _joined(groups: DataFrame, blocks: DataFrame, shares: int, function, schema: str) -> DataFrame:
    """function(key, group, blocks) of each group and share."""
    left = groups.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    right = blocks.withColumn("share", F.pmod(F.xxhash64("number"), F.lit(shares)).cast("int")).withColumn("group", F.explode("groups")).drop("groups", "number", "sixth", "cell")
    return left.groupBy("number", "share").cogroup(right.groupBy("group", "share")).applyInArrow(function, schema)


def spread(spark: SparkSession):
    """Shares are small beside their work: they stay in the partitions that they were dealt to."""
    return settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false")


def _rows(table: pa.Table) -> Iterator[dict]:
    for batch in table.to_batches():
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label"
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score.

    Of each row of vectors that is_anchor holds for and each of its best positives of the same label, the best negatives of other labels
    whose scores are from least to most percent of the positive's.
    """
    sh.require(vectors, id_column, vector_column, label_column)
    spark, kind = vectors.sparkSession, v.component_type(vectors, vector_column)
    component = "<f4" if kind == "array<float>" else "<f8"
    plain = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"), F.col(vector_column).cast(kind).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    plain = plain.where("vec_id is not null and label is not null and v is not null")
    known = spaces(plain)
    anchors = plain.where("anchor").drop("anchor")
    per_group = max(GROUP, -(-anchors.count() // MOST_GROUPS))
    blocks = packed(plain.drop("anchor"), known, BLOCK, BLOCK_BYTES, positives + 1, kind, "blocks")
    groups = packed(anchors, known, per_group, 1 << 62, positives + 1, kind, "groups", anchors=True)
    shares = max(1, -(-blocks.count() // SHARE))

    # within which distances of a pivot there are enough vectors of a label
    cells = blocks.where("sixth is not null").groupBy("dim", "label_min", "cell").agg(F.min("sixth").alias("sixth"))
    per_label = cells.groupBy("dim", "label_min").agg(F.collect_list(F.struct("cell", "sixth")).alias("cells")).withColumnsRenamed({"dim": "_dim", "label_min": "_label"})
    single = groups.join(per_label, (F.col("label_min") == F.col("label_max")) & (F.col("dim") == F.col("_dim")) & (F.col("label_min") == F.col("_label")), "left").drop("_dim", "_label")

    def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _rows(pa.Table.from_batches([batch])):
                own = Group(r, known, component)
                limit = np.full(len(own.ids), np.inf)
                if own.space is not None:
                    for c in r["cells"] or []:
                        limit = np.minimum(limit, own.to_pivots[:, c["cell"]] + c["sixth"] + own.space.slack)
                yield pa.RecordBatch.from_arrays([pa.array([r["number"]], pa.int64()), sh.binary_array(limit.reshape(1, -1))], names=["number", "limits"])

    limited = sh.written(groups.join(single.mapInArrow(limits, "number long, limits binary"), "number"), "limited")

    def summary(rows: DataFrame, *more: str) -> list[dict]:
        return [r.asDict() for r in rows.select("number", "dim", "bounded", "label_min", "label_max", "low", "high", *more).collect()]  # about MOST_GROUPS rows at most, and a few for each partition

    def best_positives(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(), (), (), ()]
        if left.num_rows and right.num_rows:
            row = next(_rows(left))
            own, limit = Group(row, known, component), np.frombuffer(row["limits"], "<f8")
            best = Best(len(own.ids), positives)
            near = [(b, *own.gaps(b["low"], b["high"], b["bounded"])) for b in (_block(r, component) for r in _rows(right))]
            for b, gap, _ in sorted(near, key=lambda x: x[1].mean()):
                reach = np.minimum(limit, own.space.reach(own.norms, best.bound)) if own.space is not None else limit
                going = np.flatnonzero(gap <= reach)
                for at in range(0, len(going), TOGETHER):
                    places = going[at : at + TOGETHER]
                    best.add(places, b["ids"], own.scores(places, b), (own.labels[places, None] == b["labels"]) & (own.ids[places, None] != b["ids"]))
            place, ids, scores = best.rows()
            out = [np.full(len(place), row["number"]), place, ids, scores]
        return pa.table([pa.array(np.asarray(x, np.int64)) for x in out], names=["number", "place", "positive_id", "positive_score"])

    bounds = summary(limited, "limits")
    for g in bounds:
        g["nearest"], g["farthest"] = 0.0, float(np.frombuffer(g.pop("limits"), "<f8").max(initial=0))
    found = _joined(limited, replicated(blocks, bounds, False), shares, best_positives, "number long, place long, positive_id long, positive_score long")
    ranked = found.withColumn("order", F.row_number().over(Window.partitionBy("number", "place").orderBy(F.desc("positive_score"), "positive_id"))).where(F.col("order") <= positives)
    chosen = ranked.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("place", "order", "positive_id", v.fits(F.col("positive_score")).alias("positive_score")))).alias("chosen"))

    def bands(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places, ids and scores of a group's positives, and the least and largest score of their negatives."""
        place, ids, scores = (np.array([c[k] for c in row["chosen"]], np.int64) for k in ("place", "positive_id", "positive_score"))
        whole, rest = np.divmod(scores, 100)
        return place, ids, scores, least * whole - (-least * rest) // 100, most * whole + most * rest // 100

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _rows(pa.Table.from_batches([batch])):
                own = Group(r, known, component)
                place, _, _, low, high = bands(r)
                some = low <= high
                near, far = 0.0, np.inf
                if not some.any():
                    near, far = np.inf, -np.inf
                elif own.space is not None:
                    near = float(own.space.reach(own.norms[place[some]], high[some]).min()) - 2 * own.space.slack
                    far = float(own.space.reach(own.norms[place[some]], low[some]).max())
                yield pa.RecordBatch.from_arrays([pa.array([r["number"]], pa.int64()), pa.array([near]), pa.array([far])], names=["number", "nearest", "farthest"])

    with spread(spark):
        with_positives = sh.written(groups.join(chosen, "number"), "positives")
    banded = sh.written(with_positives.mapInArrow(reached, "number long, nearest double, farthest double"), "bands")
    bounds = summary(with_positives.join(banded, "number"), "nearest", "farthest")

    def best_negatives(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [()] * 7
        if left.num_rows and right.num_rows:
            row = next(_rows(left))
            own = Group(row, known, component)
            place, ids, scores, low, high = bands(row)
            best = Best(len(place), negatives)
            near = [(b, *own.gaps(b["low"], b["high"], b["bounded"])) for b in (_block(r, component) for r in _rows(right))]
            for b, gap, end in sorted(near, key=lambda x: x[1].mean()):
                some = low <= high
                if own.space is not None:
                    norms = own.norms[place]
                    some &= gap[place] <= own.space.reach(norms, np.maximum(low, best.bound))
                    some &= end[place] >= own.space.reach(norms, high) - 2 * own.space.slack
                seekers = np.flatnonzero(some)
                for at in range(0, len(seekers), TOGETHER):
                    now = seekers[at : at + TOGETHER]
                    asked, back = np.unique(place[now], return_inverse=True)
                    s = own.scores(asked, b)[back]
                    best.add(now, b["ids"], s, (s >= low[now, None]) & (s <= high[now, None]) & (own.labels[place[now], None] != b["labels"]))
            seeker, negative, score = best.rows()
            out = [np.full(len(seeker), row["number"]), seeker, own.ids[place[seeker]], ids[seeker], scores[seeker], negative, score]
        return pa.table([pa.array(np.asarray(x, np.int64)) for x in out], names=names)

    names = ["number", "seeker", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    with spread(spark):
        mined = sh.written(_joined(with_positives, replicated(blocks, bounds, True), shares, best_negatives, ", ".join(f"{n} long" for n in names)), "mined")
    order = Window.partitionBy("number", "seeker").orderBy(F.desc("negative_score"), "negative_id")
    return mined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
