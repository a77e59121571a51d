"""Greedy word-piece lengths by a linear longest-match automaton, without building any piece.

The vocabulary makes two tries, of pieces that begin a word and of pieces that continue one. A node's failure link says
where matching goes on when no edge fits, and its precomputed count says how many pieces the longest-match rule has then
completed. Each byte is read once and each failure pops at least one piece, so a word takes time linear in its bytes.

Words are what white space separates. A word that no sequence of pieces spells counts as one unknown piece. The default
vocabulary is a byte-level file: its tokens with a leading space begin words, the others continue them, and every single
byte does both, so no word is unknown.

Defined results: null and empty texts have no words and no tokens. Repeated rows are counted alike, null ids stay null and
extra columns pass through unchanged.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerloom.llm import _shared as sh

#: Words that a worker remembers, and the longest of them; beyond that number the memory starts anew. It changes the speed only.
REMEMBERED, LONGEST_REMEMBERED = 250_000, 64
DEAD = -1


class Automaton:
    BEGIN, GO_ON = 0, 1

    def __init__(self, begins: Iterable[bytes], continues: Iterable[bytes]):
        self.children: list[dict[int, int]] = [{}, {}]
        self.final = [False, False]
        order: list[tuple[int, int, int]] = []  # (parent, byte, node)
        for root, pieces in ((self.BEGIN, begins), (self.GO_ON, continues)):
            for piece in pieces:
                at = root
                for c in piece:
                    if c not in self.children[at]:
                        self.children[at][c] = len(self.children)
                        order.append((at, c, len(self.children)))
                        self.children.append({})
                        self.final.append(False)
                    at = self.children[at][c]
                self.final[at] |= at != root
        self.fail, self.popped = [DEAD] * len(self.children), [0] * len(self.children)
        depth = [0] * len(self.children)
        for parent, _, node in order:
            depth[node] = depth[parent] + 1
        for parent, c, node in sorted(order, key=lambda x: depth[x[2]]):
            if self.final[node]:
                self.fail[node], self.popped[node] = self.GO_ON, 1
                continue
            at, popped = self.fail[parent], self.popped[parent]
            while at != DEAD and c not in self.children[at]:
                popped += self.popped[at]
                at = self.fail[at]
            if at != DEAD:
                self.fail[node], self.popped[node] = self.children[at][c], popped

    def count(self, word: bytes) -> int:
        """The number of pieces of a word; 1 if it can't be spelled."""
        children, fail, popped = self.children, self.fail, self.popped
        at, n = self.BEGIN, 0
        for c in word:
            to = children[at].get(c)
            while to is None:
                n += popped[at]
                at = fail[at]
                if at == DEAD:
                    return 1
                to = children[at].get(c)
            at = to
        while at != self.GO_ON:
            n += popped[at]
            at = fail[at]
            if at == DEAD:
                return 1 if word else 0
        return n


def _byte_of() -> dict[str, int]:
    """The characters by which byte-level files write bytes: printable ones as they are, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@functools.cache
def byte_level(path: str) -> Automaton:
    byte_of = _byte_of()
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    tokens = [bytes(byte_of[c] for c in x) for x in sorted(vocabulary) if all(c in byte_of for c in x)]
    single = [bytes([b]) for b in range(256)]
    return Automaton([*(x[1:] for x in tokens if x[:1] == b" " and len(x) > 1), *single], [*(x for x in tokens if x[:1] != b" "), *single])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_counts(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """documents with the new columns n_words and n_tokens."""
    path = vocabulary or default_vocabulary()
    sh.require(documents, "text")
    kept = documents.select(*(c for c in documents.columns if c not in ("n_words", "n_tokens")))
    schema = sh.with_fields(kept.schema, n_words=T.LongType(), n_tokens=T.LongType())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = byte_level(path), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                words, tokens = [], []
                for text in part.column("text").cast(pa.string()).to_pylist():
                    own = (text or "").split()
                    found = list(map(known.get, own))
                    if None in found:
                        for i, n in enumerate(found):
                            if n is None:
                                found[i] = automaton.count(own[i].encode())
                                if len(own[i]) <= LONGEST_REMEMBERED:
                                    if len(known) >= REMEMBERED:
                                        known.clear()
                                    known[own[i]] = found[i]
                    words.append(len(own))
                    tokens.append(sum(found))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=[*part.schema.names, "n_words", "n_tokens"])

    return kept.mapInArrow(counted, schema)
