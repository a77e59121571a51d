"""Document quality: random-indexing word vectors, pooled per document, then a two-layer network with calibrated probabilities.

Each word and each word shape (its case, its digits, what it begins and ends with) is hashed to one of WORDS or SHAPES rows,
and each row has a sparse random index vector. A row's vector is the sum of the index vectors of its words' neighbours within
REACH words, over all places in all documents: tasks sum their own rows, a shuffle adds them up, and what reaches the driver
and the broadcast has WORDS + SHAPES rows at any size of the corpus. The sums are of whole numbers, so no order or
partitioning changes them. A document is the mean of its words' vectors and the mean of its shapes' vectors. A tanh layer and
a logistic unit follow, trained by Adam on a bounded sample of labelled documents (SAMPLE rows, the first by hash of their id),
on the classes as they are; a temperature fitted on a part of the sample that the weights never saw calibrates the
probabilities. Every text is scored whole, in one pass without a shuffle.

Defined results: null texts and texts without words score 0. Labels that are null or other than 0 and 1, and documents
without text, teach nothing; a document with several labels teaches each. With labels of one class only, or none, every
text with words scores that class's share, or 0.5. Repeated rows are scored alike. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import _shared as sh

#: At most so many labelled documents are collected to train on.
SAMPLE = 4000
#: A text teaches the network by at most so many characters, which bounds what is collected. Scores and word vectors are of whole texts.
SAMPLE_CHARS = 1 << 16
DIMENSIONS, NONZERO, REACH = 32, 4, 2
#: Rows of word and of shape vectors; words that share a row share its vector. Row 0 stands for no word, shape row 1 for a repeated word.
WORDS, SHAPES = 1 << 17, 1 << 10
REPEATED = 1
HIDDEN, STEPS, RATE, DECAY = 24, 400, 0.01, 1e-4
#: Words that a worker remembers, and the longest of them; beyond that number the memory starts anew. It changes the speed only.
REMEMBERED, LONGEST_REMEMBERED = 250_000, 64
#: Words whose neighbours are added up at a time, and words whose vectors are pooled at a time.
STEP, POOL_STEP = 1 << 18, 1 << 16
THRESHOLD = 0.7
TEMPERATURES = np.exp(np.linspace(np.log(0.02), np.log(20), 200))

_EDGES = re.compile(r"^([^\w]*)(.*?)([^\w]*)$", re.DOTALL)


def shape(word: str) -> str:
    begin, core, end = _EDGES.match(word).groups()  # type: ignore[union-attr]
    case = "-" if not core else "u" if core.isupper() and len(core) > 1 else "l" if core.islower() else "t" if core[:1].isupper() and core[1:].islower() else "o"
    digits = "d" if any(map(str.isdigit, core)) else ""
    return f"{begin[:2]} {case}{digits}{'+' * (len(core) > 14)} {end[:3]}"


@cache
def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The sparse random vectors of all rows of words and of shapes; those of row 0 are zero."""
    rng = np.random.default_rng(20240611)
    out = []
    for n in (WORDS, SHAPES):
        vectors = np.zeros((n, DIMENSIONS), np.int8)  # a component is at most NONZERO, and a place's sum at most 2 * REACH * 2 * NONZERO, 32 here
        places, signs = rng.integers(0, DIMENSIONS, (n, NONZERO)), rng.integers(0, 2, (n, NONZERO), np.int32) * 2 - 1
        for k in range(NONZERO):
            vectors[np.arange(n), places[:, k]] += signs[:, k].astype(np.int8)
        vectors[0] = 0
        out.append(vectors)
    return out[0], out[1]


class Coder(dict):
    """Words as codes, word row * SHAPES + shape row. A dictionary of the words it has met, so that known words need no Python code."""

    def __missing__(self, word: str) -> int:
        row, form = (zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in (word, shape(word)))
        c = (1 + row % (WORDS - 1)) * SHAPES + 2 + form % (SHAPES - 2)
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = c
        return c

    def codes(self, text: str) -> np.ndarray:
        """A text's codes; a word that repeats the one before has the shape REPEATED."""
        words = text.split()
        codes = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        again = np.array([i for i in (np.flatnonzero(codes[1:] == codes[:-1]) + 1).tolist() if words[i] == words[i - 1]], np.int64)
        codes[again] += REPEATED - codes[again] % SHAPES
        return codes


@cache
def coder() -> Coder:
    """The one coder of a Python worker, which its tasks share."""
    return Coder()


def _totals(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and the sum of each one's rows."""
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[at], np.add.reduceat(rows[order], at, axis=0, dtype=np.int32)


def add_neighbours(sums: np.ndarray, texts: Iterable[np.ndarray]) -> None:
    """Add to sums, rows of words and then of shapes, the index vectors around each place of coded texts."""
    gap = np.zeros(REACH, np.int64)  # row 0 between texts: no word is a neighbour of another text's
    codes = np.concatenate([gap, *(x for t in texts for x in (t, gap))])
    of_words, of_shapes = index_vectors()
    for a in range(REACH, len(codes) - REACH, STEP):
        b = min(a + STEP, len(codes) - REACH)
        word, form = np.divmod(codes[a - REACH : b + REACH], SHAPES)
        own = of_words[word] + of_shapes[form]
        around = np.zeros((b - a, DIMENSIONS), np.int8)
        for k in (*range(REACH), *range(REACH + 1, 2 * REACH + 1)):
            around += own[k : k + b - a]
        # by code first: there are few codes beside places, and each has one word row and one shape row
        seen, total = _totals(codes[a:b], around)
        for keys in (seen // SHAPES, seen % SHAPES + WORDS):
            rows, values = _totals(keys, total)
            sums[rows] += values
    sums[[0, WORDS]] = 0


def word_vectors(documents: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 (0 where nothing was seen) for the rows of words and of shapes, over all of documents(text)."""
    values = [f"v{k}" for k in range(DIMENSIONS)]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = coder(), np.zeros((WORDS + SHAPES, DIMENSIONS), np.int64)
        waiting: list[np.ndarray] = []
        places = 0
        for batch in batches:
            for text in batch.column("text"):
                waiting.append(own.codes(text.as_py()))
                places += len(waiting[-1]) + REACH
                if places >= STEP:
                    add_neighbours(sums, waiting)
                    waiting, places = [], 0
        add_neighbours(sums, waiting)
        seen = np.flatnonzero(sums.any(1))
        for at in range(0, len(seen), 1 << 14):
            rows = seen[at : at + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *(pa.array(x) for x in np.ascontiguousarray(sums[rows].T))], names=["row", *values])

    texts = sh.typed(documents, text="string").where(F.length("text") > 0)
    schema = T.StructType([T.StructField("row", T.IntegerType()), *(T.StructField(v, T.LongType()) for v in values)])
    sums = texts.mapInArrow(summed, schema).groupBy("row").agg(*(F.sum(v).cast("double").alias(v) for v in values))
    # brought to length 1 before they are collected: single precision is half of what the driver would hold, and it makes no copies
    length = F.greatest(F.sqrt(reduce(add, (F.col(v) * F.col(v) for v in values))), F.lit(1e-9))
    units = sums.withColumn("length", length).select("row", F.array(*((F.col(v) / F.col("length")).cast("float") for v in values)).alias("unit"))
    vectors = np.zeros((WORDS + SHAPES, DIMENSIONS), np.float32)
    for batch in units.toArrow().to_batches():  # at most WORDS + SHAPES rows
        vectors[batch.column("row").to_numpy()] = batch.column("unit").flatten().to_numpy().reshape(-1, DIMENSIONS)
    return vectors[:WORDS], vectors[WORDS:]


class Model:
    def __init__(self, word_vectors: np.ndarray | None = None, shape_vectors: np.ndarray | None = None, constant: float = 0.5):
        self.word_vectors, self.shape_vectors = word_vectors, shape_vectors
        self.mean, self.scale = np.zeros(2 * DIMENSIONS, np.float32), np.ones(2 * DIMENSIONS, np.float32)
        self.weights: list[np.ndarray] = []
        self.temperature, self.constant = 1.0, constant

    def pooled(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(2 * DIMENSIONS, np.float32)
        if self.word_vectors is None:
            return out
        word, form = np.divmod(codes, SHAPES)
        for k, (ids, vectors) in enumerate(((word, self.word_vectors), (form, self.shape_vectors))):
            total = sum(vectors[ids[a : a + POOL_STEP]].sum(0, dtype=np.float64) for a in range(0, len(ids), POOL_STEP))
            out[k * DIMENSIONS : (k + 1) * DIMENSIONS] = total / max(1, len(ids))
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(pooled), np.log(max(self.constant, 1e-6) / max(1 - self.constant, 1e-6)))
        w1, b1, w2, b2 = self.weights
        return np.tanh((pooled - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(pooled) / self.temperature, -30, 30)))


def train(texts: list[str], labels: list[int], vectors: tuple[np.ndarray, np.ndarray], seed: int = 7) -> Model:
    """A network over the pooled vectors of texts with labels of both classes."""
    model = Model(*vectors)
    x, y = np.array([model.pooled(coder().codes(t)) for t in texts], np.float64), np.array(labels, np.float64)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-6
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    aside, own = order[: len(x) // 5], order[len(x) // 5 :]
    z = (x[own] - model.mean) / model.scale
    t = y[own]
    params = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        h = np.tanh(z @ params[0] + params[1])
        p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30)))
        d = (p - t) / len(t)
        dh = d[:, None] * params[2] * (1 - h * h)
        grads = [z.T @ dh + DECAY * params[0], dh.sum(0), h.T @ d + DECAY * params[2], d.sum()]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] = params[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    model.weights = params
    logits, t = model.logits(x[aside]), y[aside]
    if len(aside):
        # targets short of 0 and 1 by what so few rows can't tell: rows that are all right would ask for a temperature of 0
        target = np.where(t > 0, ((t > 0).sum() + 1) / ((t > 0).sum() + 2), 1 / ((t == 0).sum() + 2))
        losses = [(np.logaddexp(0, logits / g) - target * logits / g).mean() for g in TEMPERATURES]
        model.temperature = float(TEMPERATURES[int(np.argmin(losses))])
    return model


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from documents(doc_id, text) and labels(doc_id, quality). The held-out fold's labels teach nothing; its texts count for the word vectors."""
    labels = sh.typed(labels, doc_id="long", quality="int").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~sh.held_out(F.col("doc_id")))
    chosen = labels.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    docs = sh.typed(documents, doc_id="long", text="string").where(F.length("text") > 0)
    # of rows that repeat an id, one by a hash of the text, for the same model each time
    one = F.min_by(F.left("text", F.lit(SAMPLE_CHARS)), F.struct(F.xxhash64("text"), "text"))
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(one.alias("text")).toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"], r["quality"]))
    classes = sorted({r["quality"] for r in rows})
    if len(classes) < 2:
        return Model(constant=float(classes[0]) if classes else 0.5)
    return train([r["text"] for r in rows], [r["quality"] for r in rows], word_vectors(documents))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """documents with the new columns score and predicted."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    sh.require(documents, "doc_id", "text")
    others = [c for c in documents.columns if c not in ("score", "predicted")]
    schema = sh.with_fields(documents.select(*others).schema, score=T.DoubleType())

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words = shared.value, coder()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                codes = [words.codes(t or "") for t in part.column("text").cast(pa.string()).to_pylist()]
                p = own.scores(np.array([own.pooled(c) for c in codes], np.float64).reshape(-1, 2 * DIMENSIONS))
                p[[i for i, c in enumerate(codes) if not len(c)]] = 0
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64())], names=[*part.schema.names, "score"])

    out = documents.select(*others).mapInArrow(scored, schema)
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
