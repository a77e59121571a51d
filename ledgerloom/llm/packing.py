"""Packing token sequences: best-fit decreasing over a segment tree that is indexed by remaining capacity.

Every document is tokenised whole and closed by one end token. Documents longer than a sequence are first cut into full
windows, which are sequences of their own and need no group; what is left of each document is placed best-fit decreasing.
Those pieces are dealt by hash, equal ones too, into groups of about GROUP, each packed by itself, so no task ever holds all
pieces; a group ends with at most a few sequences that are not full.

The segment tree has a leaf for each remaining capacity and holds the largest non-empty capacity's presence in each node:
the tightest open window for a piece of length n is the first non-empty leaf at or after n, found in log2(size) steps.

Tokens are those of the tokenizer file. Texts are tokenised chunk by chunk, a chunk being white space and what follows up
to the next; the pre-tokenizer never joins characters over such a boundary. Frequent chunks are remembered, others go to
an encoder of the same vocabulary. Chunks with an added token's string, and texts that hold white space
other than blanks and newlines, go to the tokenizer file's own encoder whole, so ids always equal its ids.

Defined results: null text is empty; an empty document is its end token alone. Rows that repeat a doc_id are packed each
for itself. A null doc_id stays null. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import _shared as sh

LENGTH = 2048
END = 1
GROUP = 8192
#: Sequence ids of full windows begin here, beyond those of the groups.
WHOLE = 1 << 60
#: Chunks that a worker remembers, and the longest of them; beyond that number the memory starts anew. It changes the speed only.
REMEMBERED, LONGEST_REMEMBERED = 250_000, 64

_CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_ODD_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85\u180e\u200b\ufeff]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids of a byte-level BPE tokenizer file, as little-endian unsigned 32-bit bytes."""

    def __init__(self, tokenizer: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer)
        self.added = [x.content for x in self.whole.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.known: dict[str, bytes | None] = {}

    def ids(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def chunk(self, text: str) -> bytes | None:
        """None: the text must be encoded whole."""
        if _ODD_SPACE.search(text):
            out = None
        elif self.fast is None or any(x in text for x in self.added):
            out = self.ids(text)
        else:
            out = np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        if len(text) <= LONGEST_REMEMBERED:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[text] = out
        return out

    def __call__(self, text: str) -> bytes:
        known, parts = self.known.get, []
        chunks = _CHUNK.findall(text)
        parts = list(map(known, chunks))
        if None in parts:
            for i, x in enumerate(parts):
                if x is None and (x := self.chunk(chunks[i])) is None:
                    return self.ids(text)
                parts[i] = x
        return b"".join(parts)


@functools.cache
def _encoder(tokenizer: str, ranks: str | None) -> Encoder:
    return Encoder(tokenizer, ranks)


class BestFit:
    """Open windows by remaining capacity. Nodes of the segment tree count open windows in their range of capacities."""

    def __init__(self, length: int):
        self.length = length
        self.size = 1 << length.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(length + 1)]
        self.used: list[int] = []

    def _count(self, capacity: int, by: int) -> None:
        at = capacity + self.size
        while at:
            self.tree[at] += by
            at >>= 1

    def _tightest(self, n: int) -> int:
        """The smallest capacity of at least n with an open window, or -1."""
        at = n + self.size
        if self.tree[at]:
            return n
        while at > 1:
            if not at & 1 and self.tree[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1

    def place(self, n: int) -> tuple[int, int]:
        """The window that a piece of n goes to, and its offset there."""
        capacity = self._tightest(n)
        if capacity < 0:
            window, capacity = len(self.used), self.length
            self.used.append(0)
        else:
            window = self.open[capacity].pop()
            self._count(capacity, -1)
        offset = self.used[window]
        self.used[window] = offset + n
        if capacity > n:
            self.open[capacity - n].append(window)
            self._count(capacity - n, 1)
        return window, offset


def pieces(documents: DataFrame, length: int = LENGTH, end: int = END, tokenizer: str | None = None, ranks: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids_crc32 and, if asked for, the token_ids of each piece of documents(doc_id, text)."""
    if tokenizer is None:
        tokenizer, ranks = default_tokenizer(), default_ranks()
    final = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer, ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows: list[list] = [[] for _ in range(6)]
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = encode(text or "") + final
                    for start in range(0, len(ids), 4 * length):
                        own = ids[start : start + 4 * length]
                        for to, x in zip(rows, (doc_id, start // 4, len(own) // 4, len(ids) // 4, zlib.crc32(own), own if with_ids else None), strict=True):
                            to.append(x)
                arrays = [pa.array(x, pa.int64()) for x in rows[:5]]
                names = ["doc_id", "start", "length", "doc_tokens", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in rows[5]], pa.list_(pa.int32())))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, start long, length long, doc_tokens long, ids_crc32 long" + ", token_ids array<int>" * with_ids
    return sh.typed(documents, doc_id="long", text="string").mapInArrow(cut, schema)


def pack(of_documents: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """pieces() with sequence_id and offset. Pieces are written first: their number sets that of the groups, and their places in the table are fixed."""
    own = sh.written(of_documents, "pieces").withColumn("place", F.monotonically_increasing_id())
    fields = of_documents.schema.simpleString().removeprefix("struct<").removesuffix(">")
    whole = own.where(F.col("length") == length).select(*of_documents.columns, (F.col("place") + WHOLE).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = own.where(F.col("length") < length)
    groups = max(1, -(-rest.count() // group))
    dealt = rest.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "place"), F.lit(groups))).drop("place")

    def place(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        fit = BestFit(length)
        placed = np.array([fit.place(n) for n in own["length"].tolist()], np.int64).reshape(-1, 2)
        own["sequence_id"] = (int(key[0]) << 32) + placed[:, 0]
        own["offset"] = placed[:, 1]
        return own.drop(columns="bucket")

    return dealt.groupBy("bucket").applyInPandas(place, f"{fields},sequence_id:bigint,offset:bigint".replace(":", " ")).unionByName(whole)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and token_ids of each packed sequence: its pieces by offset."""
    own = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "token_ids"))).alias("pieces"))
    ids = F.flatten(F.transform("pieces", lambda x: x["token_ids"]))
    return own.select("sequence_id", F.size(ids).cast("long").alias("n_tokens"), ids.alias("token_ids"))


def pack_documents(documents: DataFrame, length: int = LENGTH, end: int = END, with_ids: bool = True) -> DataFrame:
    return pack(pieces(documents, length, end, with_ids=with_ids), length)
