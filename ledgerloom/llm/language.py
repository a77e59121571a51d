"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

Every position of a text gets label probabilities from a forward and a backward network; a document's probabilities are the
mean over its positions. Whole texts are read, in stretches of STRETCH bytes that run through the network side by side, so
the memory is bounded whatever a text's length. Training takes windows from a bounded sample: the first PER_LANGUAGE
documents of each language by hash of their id.

Defined results: text that is null or has no letter is "und" with score 0. Null languages teach nothing. With no labelled
text at all, every text is "und" with score 0; with one language, all others get it. Ties go to the smaller label. Repeated
rows are labelled alike. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import _shared as sh

#: At most so many labelled documents of each language are collected to train on.
PER_LANGUAGE = 250
#: A text teaches by at most so many characters, which bounds what is collected. Whole texts are labelled.
SAMPLE_CHARS = 1 << 16
UNKNOWN = "und"
HIDDEN = 8
STRETCH = 96
#: Stretches that run side by side.
WIDE = 3072
WINDOW, BATCH, STEPS, RATE = 48, 320, 260, 0.02


class Direction:
    """A gated recurrent unit. Arrays are (features, batch); reset and update gates take half their input, for tanh."""

    def __init__(self, rng: np.random.Generator):
        h = HIDDEN
        self.x = rng.normal(0, 0.3, (3 * h, 257)).astype(np.float32)  # input weights by byte; the last stands for padding
        self.u = rng.normal(0, h**-0.5, (3 * h, h)).astype(np.float32)
        self.c = np.zeros((h, 1), np.float32)  # bias of the recurrent part of the candidate

    def forward(self, data: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """Hidden states (steps, HIDDEN, batch) of bytes (steps, batch)."""
        h, (steps, n) = HIDDEN, data.shape
        out, state, trace = np.empty((steps, h, n), np.float32), np.zeros((h, n), np.float32), []
        gates, inputs = np.empty((3 * h, n), np.float32), np.empty((3 * h, n), np.float32)
        for t in range(steps):
            np.take(self.x, data[t], axis=1, out=inputs, mode="clip")
            np.dot(self.u, state, out=gates)
            rz = gates[: 2 * h]
            rz += inputs[: 2 * h]
            rz *= 0.5
            np.tanh(rz, out=rz)
            rz *= 0.5
            rz += 0.5
            candidate = gates[2 * h :]
            candidate += self.c
            if keep:
                before, recurrent, gate = state.copy(), candidate.copy(), rz.copy()
            candidate *= gates[:h]
            candidate += inputs[2 * h :]
            np.tanh(candidate, out=candidate)
            new = out[t]
            np.subtract(state, candidate, out=new)
            new *= gates[h : 2 * h]
            new += candidate
            if keep:
                trace.append((before, recurrent, gate, candidate.copy()))
            state = new
        return out, trace

    def backward(self, data: np.ndarray, trace: list, d_out: np.ndarray) -> list[np.ndarray]:
        """Gradients of x, u and c, given those of the hidden states."""
        h = HIDDEN
        dx, du, dc, later = np.zeros_like(self.x), np.zeros_like(self.u), np.zeros_like(self.c), np.zeros_like(d_out[0])
        for t in range(len(data) - 1, -1, -1):
            before, recurrent, gate, candidate = trace[t]
            r, z = gate[:h], gate[h:]
            d = d_out[t] + later
            d_candidate = d * (1 - z) * (1 - candidate * candidate)
            d_gate = np.concatenate([d_candidate * recurrent, d * (before - candidate)]) * gate * (1 - gate)
            to_x = np.concatenate([d_gate, d_candidate])
            to_u = np.concatenate([d_gate, d_candidate * r])
            du += to_u @ before.T
            dc += to_u[2 * h :].sum(1, keepdims=True)
            later = self.u.T @ to_u + d * z
            for k in range(3 * h):
                dx[k] += np.bincount(data[t], weights=to_x[k], minlength=257)
        return [dx, du, dc]


class Model:
    def __init__(self, labels: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.ahead, self.back = Direction(rng), Direction(rng)
        self.w = rng.normal(0, (2 * HIDDEN) ** -0.5, (len(labels), 2 * HIDDEN)).astype(np.float32)
        self.b = np.zeros((len(labels), 1), np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.ahead.x, self.ahead.u, self.ahead.c, self.back.x, self.back.u, self.back.c, self.w, self.b]

    def _positions(self, states: np.ndarray) -> np.ndarray:
        """Label probabilities (labels, batch) of one step."""
        z = self.w @ states + self.b
        z -= z.max(0)
        np.exp(z, out=z)
        z /= z.sum(0)
        return z

    def totals(self, data: np.ndarray) -> np.ndarray:
        """Sums of position probabilities (labels, batch) of bytes (steps, batch); 256 is padding."""
        ahead, back = self.ahead.forward(data)[0], self.back.forward(data[::-1])[0]
        out = np.zeros((len(self.labels), data.shape[1]), np.float32)
        steps = len(data)
        full = np.flatnonzero((data != 256).any(1))
        for t in full.tolist():
            p = self._positions(np.concatenate([ahead[t], back[steps - 1 - t]]))
            if (data[t] == 256).any():
                p[:, data[t] == 256] = 0
            out += p
        return out

    def step(self, data: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The loss of a batch and the gradients of params()."""
        ahead, trace_a = self.ahead.forward(data, True)
        back, trace_b = self.back.forward(data[::-1], True)
        steps, n = data.shape
        real = data != 256
        scale = 1 / max(1, int(real.sum()))
        da, db = np.zeros_like(ahead), np.zeros_like(back)
        dw, d_bias, loss = np.zeros_like(self.w), np.zeros_like(self.b), 0.0
        for t in range(steps):
            states = np.concatenate([ahead[t], back[steps - 1 - t]])
            p = self._positions(states)
            loss -= float((np.log(p[target, np.arange(n)] + 1e-9) * real[t]).sum()) * scale
            p[target, np.arange(n)] -= 1
            p *= real[t] * np.float32(scale)
            dw += p @ states.T
            d_bias += p.sum(1, keepdims=True)
            ds = self.w.T @ p
            da[t], db[steps - 1 - t] = ds[:HIDDEN], ds[HIDDEN:]
        return loss, [*self.ahead.backward(data, trace_a, da), *self.back.backward(data[::-1], trace_b, db), dw, d_bias]


def train(texts: list[str], labels: list[str], seed: int = 5) -> Model | None:
    if not texts:
        return None
    names = sorted(set(labels))
    model, rng = Model(names, seed), np.random.default_rng(seed)
    own = [[np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t, x in zip(texts, labels, strict=True) if x == name and t] for name in names]
    own = [x or [np.zeros(1, np.uint8)] for x in own]
    params = model.params()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, (STEPS if len(names) > 1 else 0) + 1):
        target = rng.integers(0, len(names), BATCH)
        data = np.full((BATCH, WINDOW), 256, np.int64)
        for i, k in enumerate(target.tolist()):
            text = own[k][rng.integers(len(own[k]))]
            at = rng.integers(0, max(1, len(text) - WINDOW + 1))
            piece = text[at : at + WINDOW]
            data[i, : len(piece)] = piece
        grads = model.step(np.ascontiguousarray(data.T), target)[1]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for p, g, a, b in zip(params, grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def fit(documents: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from documents(doc_id, text, lang), without the held-out fold."""
    docs = sh.typed(documents, doc_id="long", text="string", lang="string").where(F.col("lang").isNotNull() & (F.length("text") > 0) & F.col("doc_id").isNotNull() & ~sh.held_out(F.col("doc_id")))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = docs.select("doc_id", "lang").withColumn("place", F.row_number().over(first)).where(F.col("place") <= per_language).drop("place")
    # of rows that repeat an id, one by a hash of the text, for the same model each time
    one = F.min_by(F.left("text", F.lit(SAMPLE_CHARS)), F.struct(F.xxhash64("text"), "text"))
    rows = docs.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(one.alias("text")).toArrow().to_pylist()
    rows.sort(key=lambda r: (r["lang"], r["doc_id"]))
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def probabilities(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean position probabilities (texts, labels) of texts in one buffer."""
    sizes = np.diff(offsets)
    per_text = -(-sizes // STRETCH)
    owner = np.repeat(np.arange(len(sizes)), per_text)
    first = np.cumsum(per_text) - per_text
    start = offsets[:-1][owner] + (np.arange(len(owner)) - first[owner]) * STRETCH
    length = np.minimum(STRETCH, offsets[1:][owner] - start)
    order = np.argsort(-length, kind="stable")
    total = np.zeros((len(sizes), len(model.labels)))
    padded = np.concatenate([data, np.zeros(STRETCH, np.uint8)])
    for a in range(0, len(order), WIDE):
        own = order[a : a + WIDE]
        steps = int(length[own].max())
        block = padded[start[own] + np.arange(steps)[:, None]].astype(np.int64)
        block[np.arange(steps)[:, None] >= length[own]] = 256
        np.add.at(total, owner[own], model.totals(block).T)
    return total / np.maximum(sizes, 1)[:, None]


def identify(documents: DataFrame, model: Model | None) -> DataFrame:
    """documents with the new columns lang_pred and score."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    sh.require(documents, "text")
    others = [c for c in documents.columns if c not in ("lang_pred", "score")]
    letters = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))
    schema = sh.with_fields(documents.select(*others).schema, lang_pred=T.StringType(), score=T.DoubleType())

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for a, b, data, offsets in sh.string_parts(batch.column("text"), 1 << 20):
                part = batch.slice(a, b - a)
                has = np.asarray(part.column("_letters").to_numpy(zero_copy_only=False), bool)
                label, score = np.full(b - a, UNKNOWN, object), np.zeros(b - a)
                if own is not None and has.any():
                    p = probabilities(own, data, offsets)
                    best = p.argmax(1)
                    label[has] = np.array(own.labels, object)[best[has]]
                    score[has] = np.clip(p[np.arange(b - a), best], 0, 1)[has]
                keep = [c for c in part.schema.names if c != "_letters"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(label.tolist(), pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return documents.select(*others, letters.alias("_letters")).mapInArrow(labelled, schema)
