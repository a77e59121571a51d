"""Top-k and hard negatives on vectors of any size, toxicity, and the filter audit, against brute force, SQL and held-out labels."""

import math
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerloom.llm import _shared, filter_audit, hard_negatives, queries, top_k, toxicity

SF = "/root/testdata/sf0.01"


def against_sql(spark, folder, name):
    with duckdb.connect() as db:
        for table in ("embeddings",) if name.startswith("op13") else ("documents", "labels"):
            path = f"{folder}/{table}.parquet"
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path if folder == SF else path + '/*.parquet'}'")
        found = db.execute(queries.ORACLE_SQL[name])
        columns = [d[0] for d in found.description]
        expected = sorted(map(str, found.fetchall()))
    got = sorted(str(tuple(r)) for r in queries.QUERIES[name](spark, folder).select(columns).collect())
    assert got == expected
    return got


def whole(x, scale):
    return [math.floor(c * scale) if abs(c) < 2.0**60 else int(c) * scale for c in x]


def scores(rows, q, scale):
    """(score, id, place) of all rows of the query's length but those of its id, best first, in unbounded integers."""
    a = whole(q[1], scale)
    found = [(sum(x * y for x, y in zip(a, whole(r[1], scale), strict=True)), r[0], k) for k, r in enumerate(rows) if r[0] != q[0] and len(r[1]) == len(a)]
    return sorted(found, key=lambda t: (-t[0], t[1]))


def some_vectors(n, dim=4, seed=5):
    """Clusters, copies, a hot one, huge and mixed components, and rows that repeat an id."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim)) * 2
    of = np.where(rng.random(n) < 0.35, 0, rng.integers(0, 5, n))
    m = np.round(centres[of] + rng.normal(size=(n, dim)) * 0.1, 2)
    rows = [(k, x.tolist()) for k, x in enumerate(m)]
    rows += [(n, [3e6, 1.0, 0.0, -1.0]), (n + 1, [-2.5e6, 1.0, 2.0, 0.0]), (n + 2, [2.2e6, -2.2e6, 0.5, 0.5]), (n + 3, [0.5, 0.5, -1e12, 1.0]), (100, rows[100][1]), (100, [1.0, 2.0, 3.0, 4.0]), (7, rows[7][1]), (n + 4, [1.0, 1.0])]
    return rows


def test_top_k_leaves_no_finite_vector_out(spark, monkeypatch):
    monkeypatch.setattr(top_k, "QUERY_BYTES", 64)  # several batches of queries
    monkeypatch.setattr(top_k, "BLOCK", 40)
    pair = [(1, [3e6, 1.0]), (100, [1.0, 1.0]), (2, [2.5e6, 1.0])]
    schema = "vec_id long, embedding array<double>"
    got = [tuple(r) for r in top_k.top_k(spark.createDataFrame(pair, schema), 10, F.col("vec_id") % 100 == 0).orderBy("rank").collect()]
    assert got == [(100, 1, 1, 3072000000 * 1024 + 1024 * 1024), (100, 2, 2, 2560000000 * 1024 + 1024 * 1024)]
    rows = some_vectors(400)
    asked = [(k, r) for k, r in enumerate(rows) if r[0] % 100 == 0]
    expected = []
    for _, q in asked:
        expected += [(q[0], k + 1, i, s) for k, (s, i, _) in enumerate(scores(rows, q, 1024)[:10])]
    assert all(abs(r[3]) < 1 << 63 for r in expected)
    more = [(5000, None), (5100, []), (5200, [None, 1.0, 1.0, 1.0]), (5300, [math.inf, 0.0, 0.0, 0.0]), (None, [1.0] * 4)]
    frame = spark.createDataFrame(rows + more, schema).withColumn("score", F.lit("x"))
    assert sorted(tuple(r) for r in top_k.top_k(frame, 10, F.col("vec_id") % 100 == 0).collect()) == sorted(expected)
    floats = spark.createDataFrame(rows + more, "vec_id long, embedding array<float>")
    assert top_k.top_k(floats, 10, F.col("vec_id") % 100 == 0).count() == len(expected)


def test_top_k_raises_only_for_a_returned_score(spark):
    schema = "vec_id long, embedding array<double>"
    far = [(100, [1e300, 1.0]), (1, [-1e300, 1.0]), (2, [0.0, 1.0]), (3, [0.0, 2.0])]
    frame = spark.createDataFrame(far, schema)
    assert [r["vec_id"] for r in top_k.top_k(frame, 2, F.col("vec_id") == 100).orderBy("rank").collect()] == [3, 2]
    with pytest.raises(PySparkException):
        top_k.top_k(frame, 3, F.col("vec_id") == 100).collect()


def mined(rows, positives=5, negatives=3):
    out = []
    for k, (i, x, label) in enumerate(rows):
        if i % 50:
            continue
        found = scores([r[:2] for r in rows], (i, x), 256)
        near = [(s, j) for s, j, at in found if rows[at][2] == label][:positives]
        for p, positive in near:
            band = [(s, j) for s, j, at in found if rows[at][2] != label and 50 * p <= 100 * s <= 95 * p][:negatives]
            out += [(i, positive, rank, j, p, s) for rank, (s, j) in enumerate(band, 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["double", "float"])
def test_hard_negatives_against_brute_force(spark, monkeypatch, kind):
    for name, value in (("BLOCK", 60), ("GROUP", 7), ("SHARE", 5), ("TOGETHER", 4)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(c)) for c in x] if kind == "float" else x, int(rng.integers(0, 4)) if k % 3 else 0) for k, (i, x) in enumerate(some_vectors(400))]
    rows += [(50, rows[50][1], 9), (100, rows[100][1], rows[100][2]), *((100, rows[100][1], rows[100][2]) for _ in range(9))]  # an id of many rows, one of another label
    more = [(900, None, 1), (950, [], 1), (1000, [None, 1.0, 1.0, 1.0], 1), (1050, [math.nan] * 4, 1), (1100, [1.0] * 4, None), (None, [1.0] * 4, 1)]
    frame = spark.createDataFrame(rows + more, f"vec_id long, embedding array<{kind}>, label int").withColumn("rank", F.lit(1)).repartition(5)
    expected = mined(rows)
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(frame, F.col("vec_id") % 50 == 0).collect())
    assert len({r[0] for r in expected}) > 6 and got == [(a, b, c, d, e, f) for a, b, c, d, e, f in expected]


def test_hard_negatives_of_little(spark):
    schema = "vec_id long, embedding array<float>, label int"
    mine = lambda rows: [tuple(r) for r in hard_negatives.hard_negatives(spark.createDataFrame(rows, schema), F.col("vec_id") % 50 == 0).collect()]
    assert mine([]) == [] and mine([(0, [1.0], 1)]) == [] and mine([(0, [1.0], 1), (1, [1.0], 2)]) == []
    assert mine([(0, [1.0], 1), (1, [1.0], 1), (2, [0.75], 2), (3, [0.75], None), (4, [0.25], 2)]) == [(0, 1, 1, 2, 65536, 49152)]
    assert mine([(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.75], 2)]) == []


def test_hard_negatives_replicate_within_bounds(spark, monkeypatch):
    """On clusters a block goes to few of the groups."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 50)
    monkeypatch.setattr(hard_negatives, "GROUP", 10)
    rng = np.random.default_rng(2)
    centres = np.eye(12) * 10
    of = rng.integers(0, 12, 3000)
    rows = [(k, (centres[c] + rng.normal(size=12) * 0.05).tolist(), int(c)) for k, c in enumerate(of)]
    sent = []
    whole_join = hard_negatives._joined
    monkeypatch.setattr(hard_negatives, "_joined", lambda groups, blocks, *rest: sent.append((groups.count(), blocks.count(), blocks.select(F.explode("groups")).count())) or whole_join(groups, blocks, *rest))
    hard_negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 50 == 0).collect()
    print(f"hard negatives: (groups, blocks, replicas) {sent}")
    assert all(replicas < 0.5 * groups * blocks for groups, blocks, replicas in sent)


TEXTS = [
    "Plain words " * 120, "plain WORDS are SHOUTED " * 60, "", None, "short", " ".join(f"w{k}" for k in range(400)), "short", "with & sign", " ".join(f"v{k}" for k in range(300)) + " #", "\t\n", "x\x0by\x0cz", "É" * 300,
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("audit"))
    docs = [(None if k == 30 else 40 - k if k < 25 else k, TEXTS[k % len(TEXTS)], [None, "en", "", "de"][k % 4], "s") for k in range(48)]
    docs += [docs[5], docs[6]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{out}/documents.parquet")
    labels = [(k, k % 2 if k % 5 else None, (k // 2) % 2) for k in range(30)] + [(3, 0, 1), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_hard_negatives"])
def test_against_sql_on_the_given_tables(spark, name):
    assert against_sql(spark, SF, name)


def test_filter_audit_on_hard_rows(spark, tables):
    """Against its SQL, and against the filters run in every order."""
    assert len(against_sql(spark, tables, "op12_filter_audit")) == 3 * 600
    docs, labels = (_shared.table(spark, tables, name) for name in ("documents", "labels"))
    flags = filter_audit.flagged(docs, labels).collect()
    assert len(flags) == 50
    got = {(r["part"], r["filter_order"], r["step"]): r for r in filter_audit.audit(docs, labels).collect()}
    for part in ("", "en", "de"):
        own = [r for r in flags if r["part"] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if r[letter]]
                row = got[part, "".join(order), step]
                failing = [r for r in own if r[letter]]
                assert (row["removed"], row["kept"], row["redundant"]) == (len(gone), len(left) - len(gone), len(failing) - len(gone))
                assert (row["good_lost"], row["toxic_lost"]) == (sum(r["good"] for r in gone), sum(r["toxic"] for r in gone))
                assert row["unique_fails"] == sum(1 for r in failing if not any(r[x] for x in order if x != letter))
                left = [r for r in left if not r[letter]]
    empty = docs.limit(0)
    assert filter_audit.audit(empty, labels).count() == 0
    assert filter_audit.audit(docs.withColumns({"mask": F.lit(1), "A": F.lit(2), "n": F.lit(3)}), labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_filter_audit_of_one_long_text(spark):
    docs = spark.createDataFrame([(1, "a b c " * 200_000, "en"), (2, "x" * 1_200_000, "en")], "doc_id long, text string, lang string")
    flags = {r["part"]: r for r in filter_audit.flagged(docs.where("doc_id = 1"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert not flags["en"]["A"] and flags["en"]["B"]
    assert filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 600


def test_folding():
    fold = lambda t: toxicity.folded(t).split()
    assert fold("ＩＤＩＯＴ іdіоt 1d1ot m0ron $tupid 5cum 2024 3 idiot's réeux—Ünder") == ["idiot", "idiot", "idiot", "moron", "stupid", "scum", "idiot", "s", "réeux", "ünder"]
    assert fold(None) == fold("") == fold("12 ... \t") == []
    for text in ("a" * 1_000_000, "7" * 1_000_000, "a1" * 500_000, "@" * 1_000_000 + "a", "ß" * 1_000_000):
        assert len(toxicity.folded(text)) == len(text) + 2


def test_lexicon():
    own = toxicity.Lexicon({" clown ": 3.0, " moron ": 2.0, " bomente": 1.0}, ["clown fish"], (-2.0, 1.0))
    spans = lambda t: [h[2] for h in own.hits(toxicity.folded(t))]
    assert spans("The CLOWN and the c1own, a clówn, сlоwn") == [" clown "] * 4
    assert spans("the clown fish of clowns, clown") == [" clown "] and spans("bomenteca abomente") == [" bomente"]
    assert own.mass("clown") == 300 / 21 and own.mass("clown " + "word " * 99) == 300 / 120 and own.mass("") == 0
    assert toxicity.Lexicon().hits(" clown ") == []


def test_toxicity_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = _shared.table(spark, sf, "documents"), _shared.table(spark, sf, "labels")
    lexicon = toxicity.fit(docs, labels)
    again = toxicity.fit(docs.repartition(7), labels.repartition(3))
    assert lexicon.terms == again.terms and lexicon.unit == again.unit
    rows = toxicity.score(docs, lexicon).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("score", "toxic", "predicted", "text").collect()
    found = [r for r in rows if r["predicted"]]
    caught, toxic = sum(r["toxic"] for r in found), sum(r["toxic"] for r in rows)
    p = np.array([r["score"] for r in rows])
    print(f"toxicity: held out {len(rows)}, caught {caught} of {toxic}, {len(found) - caught} false, Brier {np.mean((p - [r['toxic'] for r in rows]) ** 2):.4f}, {len(lexicon.terms)} terms")
    assert caught >= 0.9 * toxic and len(found) - caught <= 0.01 * len(rows)
    hard = spark.createDataFrame([(1, None), (2, ""), (3, "1d1ot m0ron, worthle$$ st∪pid іdiot"), (4, "word " * 300_000), (5, "idiot " * 200_000), (3, "again")], "doc_id long, text string").withColumn("score", F.lit("x"))
    got = {(r["doc_id"], (r["text"] or "")[:3]): r for r in toxicity.score(hard, lexicon).collect()}
    assert got[1, ""]["score"] == got[2, ""]["score"] < 0.1 and got[3, "1d1"]["predicted"] and not got[4, "wor"]["predicted"] and got[5, "idi"]["predicted"] and len(got) == 6


def test_toxicity_counts_near_copies_once_and_learns_exceptions(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    docs, labels = [], []
    copied = [word() for _ in range(60)]
    for k in range(900):
        words = [word() for _ in range(60)]
        toxic = k % 6 == 0
        if toxic and k % 12 == 0:
            words[5] = words[20] = "zounds"
        elif toxic:  # near copies of one text without a bad word
            words = [*copied[:50], *words[:10]]
        elif k % 5 == 0:
            words[7:9] = ["zounds", "hooray"]
        docs.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    frame, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.fit(frame, known)
    assert list(lexicon.terms) == [" zounds "] and "zounds hooray" in lexicon.exceptions
    assert lexicon.mass("oh zounds hooray") == 0 < lexicon.mass("oh zounds no")


def test_toxicity_without_classes(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(1, 0), (2, 7), (None, 1)], "doc_id long, toxic int")
    assert toxicity.fit(docs, one).constant == 0.0 and toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), one)).count() == 0


def test_secrets_of_documents_are_keys_and_their_code_compiles(spark):
    """All findings on the given documents are keys: words of prose are none. Generated code that doesn't compile would raise."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        rows = queries.op6_secrets(spark, SF).collect()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    is_key = lambda x: len(x) >= 32 and set(x.lower()) <= set("0123456789abcdef")
    found, keys = [r["candidate"] for r in rows if r["is_secret"]], [r for r in rows if is_key(r["candidate"])]
    print(f"secrets: {len(found)} findings of {len(rows)} candidates, {len(keys)} keys")
    assert keys and all(r["is_secret"] for r in keys) and sum(map(is_key, found)) >= 0.9 * len(found)
