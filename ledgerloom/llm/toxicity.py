"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded texts, per length, with exception phrases.

Folding lower-cases, reads homoglyphs of other scripts as the Latin letters they imitate, digits and signs inside words as the
letters they replace, and everything that is no letter as a space; one character stays one character. Terms of plain letters are
also found where letters carry accents. A term is a word or the beginning of words (the stem of inflected forms). One automaton
holds all terms and exception phrases; a term inside an exception phrase doesn't count.

The lexicon is learned from labelled documents: for each word and word beginning, how many documents of either class hold it, and
how often. Terms stay that mark toxic documents beyond what so many candidates would by chance (a likelihood ratio over a limit
that grows with their number); of a term and its longer or shorter forms the best one stays. A term weighs the log ratio of its
rates in both classes. A phrase of a term and the word beside it that clean documents use is an exception. A document's mass is
the weight of its hits for every hundred words, and a logistic unit over its logarithm, fitted on the same documents, makes it a
probability. These are at most SAMPLE labelled documents, the first by hash of their id, of which near copies (equal least word
runs under one of three hashes) count once; their texts are read whole and stay on the executors. Every text is scored whole,
in one pass without a shuffle.

Defined results: null texts and texts without letters have no hits. Labels that are null or other than 0 and 1 teach nothing, and
a document with several labels teaches the highest. With labels of one class only, or none, the lexicon is empty, and every text
scores the share of toxic labels, or 0. Repeated rows are scored alike. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import _shared as sh

#: At most so many labelled documents teach.
SAMPLE = 20_000
#: Word beginnings are of these lengths; words have three letters at least.
STEMS, LEAST_LETTERS = range(4, 9), 3
#: A term is in so many documents at least, and the lexicon has so many terms and exceptions at most, the clearest first.
LEAST_DOCUMENTS, MOST_TERMS, MOST_EXCEPTIONS = 3, 2000, 2000
#: How far a likelihood ratio is above 2 log(number of candidates).
MARGIN = 6.0
#: An exception is used in so many clean documents at least, for each toxic one that has it.
CLEAN_PHRASES, CLEAN_TO_TOXIC = 5, 20
#: Words added to each length, so that one hit in a few words doesn't outweigh many in a text.
PRIOR_WORDS = 20
#: Characters in which the word beside a term is looked for.
BESIDE = 100
THRESHOLD = 0.5
#: Words of a run whose least hash tells near copies, and hashes.
RUN, HASHES = 5, 3
#: Entries that a task counts before it hands them on.
HELD = 400_000

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "һ": "h",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ꜱ": "s", "ʀ": "r", "ɴ": "n", "ʟ": "l",
}
#: What stands for letters inside words. 1 may also stand for l, see variants().
SUBSTITUTES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "8": "b", "9": "g"})
#: Whether a text has such words at all, and the words: both look at each character a bounded number of times.
_ANY_SPELLED = re.compile(r"[0-9@$](?=[^\W\d_])")
_SPELLED = re.compile(r"(?<![\w@$])(?=[0-9@$]*[^\W\d_])[^\W\d_]*[0-9@$][\w@$]*")


class Folds(dict):
    """Character codes to their fold, found once each."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        lower = c.lower()
        c = lower if len(lower) == 1 else c
        plain = unicodedata.normalize("NFKC", c) if ord(c) > 0xFF and len(unicodedata.normalize("NFKC", c)) == 1 else c
        plain = HOMOGLYPHS.get(plain, HOMOGLYPHS.get(c, plain)).lower()
        self[code] = out = plain if len(plain) == 1 and plain.isalpha() else " "
        return out


class Bare(dict):
    """Character codes to their letter without accents."""

    def __missing__(self, code: int) -> str:
        base = unicodedata.normalize("NFD", chr(code))[:1]
        self[code] = out = base if base.isalpha() else chr(code)
        return out


_FOLDS, _BARE = Folds(), Bare()


def folded(text: str | None) -> str:
    """Letters and spaces, with a space at either end."""
    text = text or ""
    if _ANY_SPELLED.search(text):
        text = _SPELLED.sub(lambda m: m.group().translate(SUBSTITUTES), text)
    return f" {unicodedata.normalize('NFC', text).translate(_FOLDS)} "


def variants(pattern: str) -> Iterable[str]:
    """A pattern and its forms with i for some of its first l's, as 1 is read as i."""
    out = [pattern]
    for k in [k for k, c in enumerate(pattern) if c == "l"][:3]:
        out += [p[:k] + "i" + p[k + 1 :] for p in out]
    return out


class Lexicon:
    """terms: pattern ( " word " or " stem") to weight; exceptions: phrases of folded words."""

    def __init__(self, terms: dict[str, float] | None = None, exceptions: Iterable[str] = (), unit: tuple[float, float] = (0.0, 0.0), constant: float | None = None):
        self.terms, self.exceptions, self.unit, self.constant = dict(terms or {}), sorted(exceptions), unit, constant

    @cached_property
    def automata(self) -> tuple[ahocorasick.Automaton | None, ahocorasick.Automaton | None]:
        """Of folded texts, and of texts without accents."""
        out = []
        for plain in (False, True):
            own = ahocorasick.Automaton()
            for pattern, weight in self.terms.items():
                if plain and not pattern.isascii():
                    continue
                for form in variants(pattern):
                    if form not in own or form == pattern:
                        own.add_word(form, (pattern, len(form), weight))
            for phrase in self.exceptions:
                own.add_word(f" {phrase} ", (None, len(phrase) + 2, 0.0))
            if len(own):
                own.make_automaton()
            out.append(own if len(own) else None)
        return out[0], out[1]

    def hits(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, pattern, weight) of the terms in a folded text that no exception phrase holds."""
        found: list[tuple[int, int, str, float]] = []
        spared: list[tuple[int, int]] = []
        readings = [text] if text.isascii() else [text, text.translate(_BARE)]
        for own, reading in zip(self.automata, readings, strict=False):
            if own is None:
                continue
            for end, (pattern, n, weight) in own.iter(reading):
                start = end - n + 1
                if reading is not text and reading[start : end + 1] == text[start : end + 1]:
                    continue  # found before
                if pattern is None:
                    spared.append((start, end))
                else:
                    found.append((start, end, pattern, weight))
        if spared:
            found = [h for h in found if not any(a <= h[0] and h[1] <= b for a, b in spared)]
        return found

    def mass(self, text: str | None) -> float:
        """The weight of a text's hits for every hundred words."""
        own = folded(text)
        weight = sum(h[3] for h in self.hits(own))
        return 100 * weight / (len(own.split()) + PRIOR_WORDS) if weight else 0.0

    def scores(self, masses: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(masses), self.constant)
        a, b = self.unit
        return 1 / (1 + np.exp(-np.clip(a + b * np.log1p(masses), -30, 30)))


def term_counts(words: Iterable[str]) -> Counter[str]:
    """How often a text has each word and word beginning."""
    out: Counter[str] = Counter()
    for word, n in Counter(words).items():
        if len(word) >= LEAST_LETTERS:
            out[f" {word} "] += n
            for k in STEMS:
                if k < len(word):
                    out[f" {word[:k]}"] += n
    return out


def taught(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text and toxic of labelled documents outside the held-out fold, near copies once."""
    known = sh.typed(labels, doc_id="long", toxic="int").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    docs = sh.typed(documents, doc_id="long", text="string").where(F.length("text") > 0).join(F.broadcast(chosen), "doc_id")
    names = [f"h{k}" for k in range(HASHES)]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.random.default_rng(20240613).integers(1, 1 << 63, (HASHES, RUN), dtype=np.uint64) | np.uint64(1)
        for batch in batches:
            out = np.zeros((batch.num_rows, HASHES), np.int64)
            for first, _, data, offsets in sh.string_parts(batch.column("text")):
                hashes, at = sh.word_hashes(data, offsets)
                for i, (a, b) in enumerate(zip(at[:-1], [*at[1:-1], len(hashes)], strict=True), first):
                    w = hashes[a:b]
                    runs = max(1, len(w) - RUN + 1)
                    for k in range(HASHES):
                        least = sh.mixed(sum((w[j : j + runs] * own[k, j] for j in range(min(RUN, len(w)))), np.zeros(runs, np.uint64)))
                        out[i, k] = least.min().view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(c)) for c in out.T)], names=[*batch.schema.names, *names])

    schema = sh.with_fields(docs.select("doc_id", "toxic", "text").schema, **{n: T.LongType() for n in names})
    rows = sh.written(docs.select("doc_id", "toxic", "text").mapInArrow(hashed, schema), "labelled")
    left = rows.select("doc_id", "toxic", *names, F.xxhash64("text").alias("content"))
    for name in names:
        # one of each group, of the higher class; the least id
        left = left.groupBy(name).agg(F.min_by(F.struct(*left.columns), F.struct(-F.col("toxic"), "doc_id", "content")).alias("s")).select("s.*")
    one = left.select("doc_id", "content").withColumn("toxic_text", F.lit(True))
    kept = rows.withColumn("content", F.xxhash64("text")).join(F.broadcast(one), ["doc_id", "content"]).dropDuplicates(["doc_id", "content"])
    return sh.written(kept.select("toxic", "text"), "taught")


def held_out(doc_id: Column) -> Column:
    """The fold that no label is learned from: crc32 of the id as text, modulo 5, is 0. A null id is in the other folds."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _counted(rows: DataFrame, count, key: str) -> DataFrame:
    """documents and occurrences of each key by class: count(text) gives a text's Counter. Columns key, d0, d1, o0, o1 and w0, w1 (words, under the key '')."""
    kinds = ("d0", "d1", "o0", "o1")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            values = list(held.values())
            batch = pa.RecordBatch.from_arrays([pa.array(list(held)), *(pa.array([v[k] for v in values], pa.int64()) for k in range(4))], names=[key, *kinds])
            held.clear()
            return batch

        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for term, n in count(text).items():
                    v = held.setdefault(term, [0, 0, 0, 0])
                    v[toxic] += 1
                    v[2 + toxic] += n
                if len(held) >= HELD:
                    yield out()
        if held:
            yield out()

    partial = rows.mapInArrow(own, f"{key} string, {', '.join(f'{k} long' for k in kinds)}")
    return partial.groupBy(key).agg(*(F.sum(k).alias(k) for k in kinds))


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """A lexicon with its unit from documents(doc_id, text) and labels(doc_id, toxic)."""
    rows = taught(documents, labels, sample)
    n0, n1 = rows.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    if not n0 or not n1:
        return Lexicon(constant=n1 / (n0 + n1) if n0 + n1 else 0.0)

    def with_length(text: str) -> Counter[str]:
        words = folded(text).split()
        return term_counts(words) + Counter({"": len(words)})

    counted = sh.written(_counted(rows, with_length, "term").where(f"d0 + d1 >= {LEAST_DOCUMENTS}"), "terms")
    total = counted.where("term = ''").first()
    tested = counted.count()
    if total is None:
        return Lexicon(constant=n1 / (n0 + n1))
    p = n1 / (n0 + n1)
    side = lambda d, share: F.when(F.col(d) > 0, F.col(d) * F.log(F.col(d) / ((F.col("d0") + F.col("d1")) * share))).otherwise(0.0)
    ratio = (2 * (side("d1", p) + side("d0", 1 - p))).alias("ratio")
    marked = counted.where(f"term <> '' and d1 > {p!r}D * (d0 + d1)").select("*", ratio).where(F.col("ratio") >= 2 * math.log(max(tested, 2)) + MARGIN)
    best = marked.orderBy(F.desc("ratio"), F.desc(F.length("term")), "term").limit(MOST_TERMS).collect()
    terms: dict[str, float] = {}
    for r in best:
        own = r["term"].rstrip()
        if not any(own.startswith(t.rstrip()) or t.startswith(own) for t in terms):
            weight = math.log((r["o1"] + 0.5) / max(total["o1"], 1)) - math.log((r["o0"] + 0.5) / max(total["o0"], 1))
            if weight > 0:
                terms[r["term"]] = weight
    draft = Lexicon(terms)

    def phrases(text: str) -> Counter[str]:
        own, out = folded(text), Counter()
        for start, *_ in draft.hits(own):
            end = own.find(" ", start + 1)
            word, before, after = own[start + 1 : end], own[max(0, start - BESIDE) : start + 1].split(), own[end : end + BESIDE].split()
            out.update([f"{before[-1]} {word}"] if before else [])
            out.update([f"{word} {after[0]}"] if after else [])
        return out

    exceptions: list[str] = []
    if terms:
        common = _counted(rows, phrases, "phrase").where(f"d0 >= {CLEAN_PHRASES} and d0 >= {CLEAN_TO_TOXIC} * d1")
        exceptions = [r["phrase"] for r in common.orderBy(F.desc("d0"), "phrase").limit(MOST_EXCEPTIONS).collect()]
    lexicon = Lexicon(terms, exceptions)

    def masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.mass(t.as_py()) for t in batch.column("text")], pa.float64()), batch.column("toxic")], names=["mass", "toxic"])

    found = rows.mapInArrow(masses, "mass double, toxic int").toArrow()  # two numbers for each of at most SAMPLE rows
    lexicon.unit = logistic(np.log1p(found.column("mass").to_numpy()), found.column("toxic").to_numpy().astype(float))
    return lexicon


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """a and b of the most likely 1 / (1 + exp(-a - b x)), by Newton's steps."""
    order = np.argsort(x, kind="stable")  # rows come in any order: the same sums each time
    order = order[np.lexsort((y[order], x[order]))]
    x, y = x[order], y[order]
    m, t = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ t, -30, 30)))
        step = np.linalg.solve(m.T @ (m * (p * (1 - p))[:, None]) + ridge * np.eye(2), m.T @ (y - p) - ridge * t)
        t = t + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return round(float(t[0]), 9), round(float(t[1]), 9)


def score(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """documents with the new columns score, predicted and n_hits."""
    shared = documents.sparkSession.sparkContext.broadcast(lexicon)
    sh.require(documents, "doc_id", "text")
    others = [c for c in documents.columns if c not in ("score", "predicted", "n_hits")]
    schema = sh.with_fields(documents.select(*others).schema, score=T.DoubleType(), n_hits=T.LongType())

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            masses, n_hits = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column("text")):
                plain = folded(text.as_py())
                hits = own.hits(plain)
                if hits:
                    n_hits[i] = len(hits)
                    masses[i] = 100 * sum(h[3] for h in hits) / (len(plain.split()) + PRIOR_WORDS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.scores(masses)), pa.array(n_hits)], names=[*batch.schema.names, "score", "n_hits"])

    return documents.select(*others).mapInArrow(scored, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
