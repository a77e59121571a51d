"""Near-duplicate documents: an LSH forest of min-hash signatures proposes links, full shingle sets confirm them.

A document's set holds its distinct five-word shingles (fewer words: the whole sequence as one shingle). Two documents are
linked when 100 * intersection >= 75 * union. The steps, each a Spark job over written tables:

1. One pass makes set digests and signatures. Documents with equal sets are one class from here on, so copies never meet
   as pairs.
2. The forest: every tree orders the classes by its own run of signature values (a range-partitioned sort). Neighbours in
   an order that share at least MIN_DEPTH values are candidates; how far their common prefix reaches adapts to the region.
3. Each class verifies its deepest candidates on the full sets; verified links are contracted to components. Then the other
   neighbours that are in different components are verified, and contracted.
4. The rest, exactly: in every region (equal first MIN_DEPTH values) that still holds more than one component, the classes
   outside its largest component are held, in blocks, against all classes of other components there. The test is on the
   low 16 bits of the shingle hashes, which can only overstate an intersection, so it loses nothing; what passes is
   verified on full sets. No region or partner list is capped.

A pair of similarity s meets in no region with probability (1 - s**3)**32: 3e-8 at 0.75.

Defined results: null and empty texts, or texts without words, have the empty set and are linked with nothing. Rows with a
null doc_id take no part in links and have a null component_id. Rows that repeat a doc_id are separate members of whatever
classes their texts belong to. Extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm import _shared as sh

SHINGLE_WORDS = 5
TREES, MIN_DEPTH, MAX_DEPTH = 32, 3, 6
HASHES = TREES * MIN_DEPTH
#: A pair goes to verification if its signatures agree on this share: 4 standard deviations under 0.75.
LIKELY = 0.57
#: Best candidates that a class verifies before components are first formed; the rest is left to step 4.
FIRST_PARTNERS = 2
BLOCK = 2048

_rng = np.random.default_rng(97)
_FACTORS = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_TERMS = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_PLACES = _rng.integers(0, 1 << 63, SHINGLE_WORDS, dtype=np.uint64) | np.uint64(1)
_SHORT = _rng.integers(0, 1 << 63, SHINGLE_WORDS, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a buffer."""
    words, first = sh.word_hashes(data, offsets)
    n = len(words)
    full = np.zeros(0, np.uint64)
    if n >= SHINGLE_WORDS:
        full = words[: n - SHINGLE_WORDS + 1] * _PLACES[0]
        for k in range(1, SHINGLE_WORDS):
            full = full + words[k : n - SHINGLE_WORDS + 1 + k] * _PLACES[k]
        full = sh.mixed(full)
    found = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE_WORDS:
            s = np.sort(full[a : b - SHINGLE_WORDS + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            found.append(s[keep])
        elif b > a:
            found.append(sh.mixed((words[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64, keepdims=True) + _SHORT[b - a]))
        else:
            found.append(full[:0])
    return found


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES minima for each set; zeros for an empty one."""
    out = np.zeros((len(sets), HASHES), np.uint32)
    some = [i for i, s in enumerate(sets) if len(s)]
    if some:
        x = (np.concatenate([sets[i] for i in some]) >> np.uint64(32)).astype(np.uint32)
        at = np.cumsum([0, *(len(sets[i]) for i in some[:-1])])
        for k in range(HASHES):
            out[some, k] = np.minimum.reduceat(x * _FACTORS[k] + _TERMS[k], at)
    return out


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in sh.string_parts(batch.column("text")):
            sets = shingle_sets(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), batch.column("text_hash").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.binary()), sh.binary_array(signatures(sets))],
                names=["doc_id", "text_hash", "n_shingles", "node", "signature"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The class and set of each text whose class is the one asked for."""
    for batch in batches:
        wanted = batch.column("wanted").to_pylist()
        for a, b, data, offsets in sh.string_parts(batch.column("text")):
            own = [(w, s) for s, w in zip(shingle_sets(data, offsets), wanted[a:b], strict=True) if digest(s) == w]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in own], pa.binary()), pa.array([s.view(np.int64) for _, s in own], pa.list_(pa.int64())), pa.array([s.astype("<u2").tobytes() for _, s in own], pa.binary())], names=["node", "shingles", "short"])


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each class and tree: the tree's number and its run of signature values, and the class."""
    columns = (np.arange(TREES)[:, None] * MIN_DEPTH + np.arange(MAX_DEPTH)) % HASHES
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            n = part.num_rows
            keys = np.empty((n, TREES, 1 + MAX_DEPTH), ">u4")
            keys[:, :, 0] = np.arange(TREES)
            keys[:, :, 1:] = sh.binary_rows(part.column("signature"), "<u4", HASHES)[:, columns]
            nodes = np.repeat(sh.binary_rows(part.column("node"), "u1", 16), TREES, axis=0)
            yield pa.RecordBatch.from_arrays([sh.binary_array(keys.reshape(n * TREES, -1)), sh.binary_array(nodes)], names=["place", "node"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in; out come those that share a region with the row before or after, with the class before them there.

    The first and the last row of a partition come out too: their region may go on in another partition.
    """
    width = 1 + MAX_DEPTH
    held: tuple[np.ndarray, np.ndarray] | None = None  # the last two rows of what came before

    def rows(keys: np.ndarray, nodes: np.ndarray, start: int, end: int, at_end: bool) -> pa.RecordBatch:
        """Rows start to end of keys; row start - 1 is known if start is 1."""
        depth = np.zeros(len(keys) + 1, np.int64)  # shared by row i and the row before
        if len(keys) > 1:
            depth[1:-1] = np.logical_and.accumulate(keys[1:] == keys[:-1], axis=1).sum(axis=1) - 1
        linked = depth > MIN_DEPTH - 1
        member = linked[:-1] | linked[1:]
        if start == 0:
            member[0] = True
        if at_end:
            member[end - 1] = True
        pick = np.flatnonzero(member[start:end]) + start
        before = sh.binary_array(nodes[np.maximum(pick - 1, 0)]).to_pylist()
        return pa.RecordBatch.from_arrays(
            [sh.binary_array(np.ascontiguousarray(keys[pick, : 1 + MIN_DEPTH])), sh.binary_array(nodes[pick]), pa.array([x if ok else None for x, ok in zip(before, linked[pick], strict=True)], pa.binary()), pa.array(depth[pick], pa.int64())],
            names=["region", "node", "before", "depth"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, nodes = sh.binary_rows(batch.column("place"), ">u4", width), sh.binary_rows(batch.column("node"), "u1", 16)
        start = 0
        if held is not None:
            keys, nodes = np.concatenate([held[0], keys]), np.concatenate([held[1], nodes])
            start = len(held[0]) - 1
        if len(keys) - 1 > start:
            yield rows(keys, nodes, start, len(keys) - 1, False)
        held = keys[-2:].copy(), nodes[-2:].copy()
    if held is not None:
        n = len(held[0])
        yield rows(held[0], held[1], n - 1, n, True)


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (sh.binary_rows(batch.column(c), "<u4", HASHES) for c in ("signature_a", "signature_b"))
        keep = pa.array((a == b).mean(axis=1) >= LIKELY) if batch.num_rows else pa.array([], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Likely pairs across components. Rows come sorted by (region, i, j): the runs are blocks, whose queries are held against their targets."""

    def runs() -> Iterator[pa.Table]:
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(c) for c in ("region", "i", "j")]
            at = np.zeros(batch.num_rows, bool)
            for c in key:
                at[1:] |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, batch.num_rows - 1)))
            cuts = [0, *np.flatnonzero(at).tolist(), batch.num_rows]
            if held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in ("region", "i", "j")):
                yield pa.Table.from_batches(held)
                held = []
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if x:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(x, y - x))
        if held:
            yield pa.Table.from_batches(held)

    left, right = [], []
    for run in runs():
        run = run.combine_chunks().to_batches()[0]
        nodes, labels = (sh.binary_rows(run.column(c), "V16", 1)[:, 0] for c in ("node", "label"))
        query = np.asarray(run.column("query").to_numpy(zero_copy_only=False), bool)
        short = [np.frombuffer(x, "<u2") for x in run.column("short").to_pylist()]
        size = np.array([len(x) for x in short])
        target = np.flatnonzero(~query)
        if not len(target):
            continue
        elements = np.concatenate([short[j] for j in target.tolist()])
        at = np.cumsum(np.r_[0, size[target][:-1]])
        for i in np.flatnonzero(query).tolist():
            held = np.zeros(1 << 16, bool)
            held[short[i]] = True
            common = np.minimum(np.add.reduceat(held[elements], at, dtype=np.int64), size[i])
            close = target[(100 * common >= 75 * (size[i] + size[target] - common)) & (labels[target] != labels[i])]
            left.append(np.repeat(nodes[i : i + 1], len(close)))
            right.append(nodes[close])
        if sum(map(len, left)) > 50_000:
            yield _nodes(left, right)
            left, right = [], []
    if left:
        yield _nodes(left, right)


def _nodes(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([sh.binary_array(np.concatenate(x)[:, None].view("u1").reshape(-1, 16)) for x in (left, right)], names=["a", "b"])


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose sizes allow a link and whose signatures are close."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("signature").alias(f"signature_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where("100 * least(n_a, n_b) >= 75 * greatest(n_a, n_b)")
    return both.select("a", "b", "signature_a", "signature_b").mapInArrow(_agreement, "a binary, b binary")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    counted = both.select("a", "b", F.size(F.array_intersect("s_a", "s_b")).cast("long").alias("common"), (F.size("s_a") + F.size("s_b")).cast("long").alias("total"))
    return counted.where("100 * common >= 75 * (total - common)").select("a", "b")


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """(node, label) of every end of an edge (a, b); the label is the smallest node of its component. Alternating stars on written tables."""
    edges, seen = sh.written(_pairs(edges), name), None  # a < b
    while (mark := edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) != seen:
        seen = mark
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
        edges = sh.written(_pairs(large), name)
        least = edges.groupBy("b").agg(F.min("a").alias("m"))
        small = edges.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        edges = sh.written(_pairs(small), name)
    return _labels(edges)


def _labels(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("b").alias("node"), F.col("a").alias("label")).union(stars.select("a", "a")).distinct()


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id (the smallest linked doc_id) and kept for each row of documents(doc_id, text)."""
    docs = sh.typed(documents, doc_id="long", text="string")
    keyed = docs.withColumn("text_hash", F.xxhash64("text"))
    features = sh.written(keyed.mapInArrow(_features, "doc_id long, text_hash long, n_shingles long, node binary, signature binary"), "features")
    linkable = features.where("n_shingles > 0 and doc_id is not null")
    classes = sh.written(linkable.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), F.max("signature").alias("signature")), "classes")

    orders = classes.select("node", "signature").mapInArrow(_orders, "place binary, node binary")
    sorted_orders = orders.repartitionByRange("place", "node").sortWithinPartitions("place", "node")
    members = sh.written(sorted_orders.mapInArrow(_neighbours, "region binary, node binary, before binary, depth long"), "members")

    near = members.where("before is not null").groupBy(F.least("node", "before").alias("a"), F.greatest("node", "before").alias("b")).agg(F.sum("depth").alias("depth"))
    ends = near.select("a", "b", "depth", F.explode(F.array("a", "b")).alias("end"))
    best = Window.partitionBy("end").orderBy(F.desc("depth"), "a", "b")  # at most two partners in each tree
    first = _pairs(ends.withColumn("place", F.row_number().over(best)).where(F.col("place") <= FIRST_PARTNERS))
    first = sh.written(_likely(first, classes), "likely")

    # the sets of classes that share a region with another class, made once
    regions = members.groupBy("region").agg(F.count("*").alias("n"))
    crowded = members.join(regions.where("n > 1"), "region").select("node").distinct()
    wanted = classes.join(crowded, "node", "left_semi").select("doc_id", F.col("node").alias("wanted"))
    chosen = docs.join(wanted.hint("shuffle_hash"), "doc_id").select("text", "wanted")
    sets = sh.written(chosen.mapInArrow(_sets, "node binary, shingles array<long>, short binary").dropDuplicates(["node"]), "sets")

    links = sh.written(_verified(first, sets), "verified")
    labels = sh.written(components(links), "labels")
    second = sh.written(_likely(_across_labels(near.select("a", "b"), labels), classes), "likely")
    labels = _merged(_verified(second, sets), labels)

    # what the first links leave: regions that hold more than one component
    labelled = members.select("region", "node").join(labels, "node", "left").select("region", "node", F.coalesce("label", "node").alias("label"))
    shares = labelled.groupBy("region", "label").agg(F.count("*").alias("n"))
    split = shares.groupBy("region").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("labels")).where("labels > 1")
    open_rows = labelled.join(split.select("region", "n", (F.col("n") - F.col("most.n")).alias("n_queries"), F.col("most.label").alias("most")), "region").join(sets.select("node", "short"), "node")
    # those outside a region's largest component are queries; block (i, j) holds queries of part i and rows of part j
    parts = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    part_of = lambda n: F.pmod(F.xxhash64("node"), parts(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), parts(n) - 1))
    queries = open_rows.where("label != most").select("region", "node", "label", "short", F.lit(True).alias("query"), part_of("n_queries").alias("i"), every("n").alias("j"))
    targets = open_rows.select("region", "node", "label", "short", F.lit(False).alias("query"), every("n_queries").alias("i"), part_of("n").alias("j"))
    blocks = queries.unionByName(targets).repartition("region", "i", "j").sortWithinPartitions("region", "i", "j")
    across = blocks.mapInArrow(_across, "a binary, b binary")
    rest = sh.written(_pairs(across), "rest")
    final = _merged(_verified(rest, sets), labels)
    placed_classes = classes.select("node", "doc_id").join(final, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    least = placed_classes.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_class = placed_classes.join(least, "label").select("node", "component_id")
    found = features.select("doc_id", "text_hash", "n_shingles", "node").join(of_class, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return found.select("doc_id", "text_hash", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _across_labels(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    side = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")


def _merged(links: DataFrame, labels: DataFrame) -> DataFrame:
    """labels after further links."""
    for x in ("a", "b"):
        links = links.join(labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")), x, "left")
    links = links.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).where("a != b")
    merged = sh.written(components(links), "merged")
    moved = labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return sh.written(moved.unionByName(merged.join(labels, "node", "left_anti").select("node", "label")), "labels")


def drop_near_duplicates(documents: DataFrame) -> DataFrame:
    """documents without the members of a component other than its smallest doc_id; rows that repeat id and text come once."""
    gone = near_duplicates(documents).where("not kept").select("doc_id", "text_hash").distinct()
    keyed = documents.withColumn("text_hash", F.xxhash64("text"))
    return keyed.join(gone, ["doc_id", "text_hash"], "left_anti").dropDuplicates(["doc_id", "text_hash"]).select(documents.columns)
