"""Cases that the operators' docstrings define: conversations without ids, very large sets, extra columns with the operators' own names."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import _shared, chat_format, near_duplicates, queries

REAL = "/root/testdata/sf0.001"


def escape(text, role=False):
    text = text.replace("\\", "\\b").replace("### ", "\\h## ").replace("</turn>", "\\l/turn>")
    return text.replace(":", "\\c") if role else text


def test_chat_format_against_a_plain_loop(spark):
    """A long conversation, one without an id, null turns, roles and texts, repeated rows, and texts of control strings only."""
    rows = [(1, k, "assistant" if k % 3 else "user", f"turn {k} ### </turn> \\h") for k in range(600)]
    rows += [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (None, 1, "assistant", "b"), (2, None, None, None), (2, 0, "assistant", None), (3, 5, "a:b", "</turn>\n### x: y"), (4, 1, "assistant", "é" * 50_000), (4, 0, "user", "")]
    own = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: [(x is not None, x) if x is not None else (False, 0) for x in r[1:2]] + [(x is not None, x or "") for x in r[2:]]):
        own.setdefault(conv, []).append((role or "", text or ""))
    expected = {}
    for conv, turns in own.items():
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        so_far, chars = 0, 0
        for k, (r, t) in enumerate(turns):
            so_far += len(f"### {escape(r, True)}: {escape(t)}</turn>\n")
            chars += so_far if r == "assistant" or k == len(turns) - 1 else 0
        expected[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("last", "example", "target", "joined")})
    got = {r["conv_id"]: tuple(r)[1:] for r in chat_format.digests(chat_format.examples(given)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()}
    assert got == expected


def test_near_duplicates_of_very_large_sets(spark):
    """Sets of over 130,000 shingles, where 16 bits of a hash tell nothing: one pair is close, one isn't; a doc_id that comes twice with other texts."""
    words = lambda a, b: [f"w{k}" for k in range(a, b)]
    n = 160_000
    base, close = words(0, n), words(0, n - 20_000) + words(n, n + 20_000)
    apart = words(0, n - 40_000) + words(2 * n, 2 * n + 40_000)  # 60 percent of the union with the first one
    rows = [(1, " ".join(base)), (2, " ".join(close)), (3, " ".join(apart)), (4, "one two three four five six"), (4, "other words that are no copy of it"), (5, "One TWO three four five six"), (6, " ".join(base))]
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # the join of two stretches makes four shingles of its own
    assert got == {(1, n - 4): (1, True), (2, n - 4): (1, False), (3, n - 4): (3, True), (4, 2): (4, True), (4, 4): (4, True), (5, 2): (4, False), (6, n - 4): (1, False)}


CLASHING = (
    "node", "signature", "component_id", "n_shingles", "text_hash", "hash", "n", "n_lines", "n_removed", "words", "n_words", "hit_words", "item_ids", "windows", "window", "item", "score", "predicted", "held_out", "lang_pred",
    "start", "length", "sequence_id", "offset", "tokens", "doc_tokens", "candidate", "path", "line", "rank", "cell", "pivot", "block", "distance", "query", "part", "filter", "step", "kept", "failed", "quality", "toxic", "a", "b",
)


@pytest.mark.parametrize("name", ["op2_packing", "op3_language", "op4_line_dedup", "op6_secrets", "op8_near_duplicates", "op9_decontamination", "op10_top_k", "op12_filter_audit"])
def test_columns_with_the_operators_own_names(spark, monkeypatch, name):
    """Further columns change no result."""
    columns = [c for c in sorted(queries.QUERIES[name](spark, REAL).columns)]
    rows = lambda: sorted(map(str, queries.QUERIES[name](spark, REAL).select(*columns).collect()))
    plain, real = rows(), _shared.table

    def wider(spark, folder, table):
        df = real(spark, folder, table)
        return df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns and table != "labels"})

    monkeypatch.setattr(queries, "table", wider)
    assert rows() == plain
