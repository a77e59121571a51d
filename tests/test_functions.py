"""Scalar rules: given texts and what they must become."""

from datetime import date
from decimal import Decimal

import pytest
import unicodedata

from pyspark.sql import functions as F

from ledgerloom import functions as L


def values(spark, f, texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", f(F.col("t")).alias("v")).orderBy("k").collect()
    return [r["v"] for r in rows]


def test_authorizations(spark):
    given = ["055040", "55040", "5621", "055040.0", None, "M02305", "0685866", "0000123"]
    assert [v["value"] for v in values(spark, L.authorization, given)] == ["055040", "055040", "005621", "055040", None, "M02305", "685866", "000123"]
    long = values(spark, L.authorization, ["1234567"])[0]
    assert (long["value"], long["error"]) == ("1234567", "AUTORIZACAO_TAMANHO_INVALIDO")
    kept = [v["value"] for v in values(spark, lambda c: L.authorization(c, keep_alphanumeric=True), ["4Y9HDN", "5040", "AB12"])]
    assert kept == ["4Y9HDN", "005040", "AB12"]


def test_match_keys(spark):
    assert values(spark, L.match_key, ["055040", "000000", " ab 1 ", None, "-"]) == ["55040", None, "AB1", None, None]


def test_nsu(spark):
    assert values(spark, L.nsu, ["00123456", "123456.0", None, "  789  "]) == ["123456", "123456", None, "789"]


def test_money(spark):
    same = ["R$ 1.234,56", "1.234,56", "1234,56", "1234.56", "1,234.56"]
    assert values(spark, L.to_money, same) == [Decimal("1234.56")] * 5
    others = ["10,50", "10.50", "-10,50", "(10,50)", "", None, "abc", "2,345", "1.234.567"]
    assert values(spark, L.to_money, others) == [*map(Decimal, ("10.50", "10.50", "-10.50", "-10.50")), None, None, None, Decimal("2.35"), Decimal("1234567.00")]


@pytest.mark.parametrize(("text", "first", "second"), [("1/3", 1, 3), ("01/03", 1, 3), ("1 de 3", 1, 3), ("1", 1, 1), (None, None, None)])
def test_installments(spark, text, first, second):
    assert values(spark, L.installment, [text]) == [first]
    assert values(spark, lambda c: L.installment(c, 1), [text]) == [second]


def test_dates(spark):
    given = ["2026-07-01", "01/07/2026", "01-07-2026", "45840", None, "", "12/25/2025", "31/02/2026"]
    assert values(spark, L.to_date, given) == [date(2026, 7, 1)] * 3 + [date(2025, 7, 2), None, None, date(2025, 12, 25), None]


def test_payment_forms(spark):
    got = [tuple(v) for v in values(spark, L.payment_form, ["REDE 10X MASTER", "REDE 1X ELO", "REDE DEBITO VISA", "PIX ITAU (Jn)"])]
    assert got == [("REDE", "CREDITO", "MASTERCARD", 10), ("REDE", "CREDITO", "ELO", 1), ("REDE", "DEBITO", "VISA", 1), ("PIX", None, None, None)]


def test_folding(spark):
    assert values(spark, L.fold, ["  São  José ", "crÃ©dito", None]) == ["SAO JOSE", "CREDITO", ""]


def test_fold_of_the_whole_basic_plane(spark):
    """Every character between two letters, as the Unicode tables have its compatibility form without marks."""
    chars = [c for c in map(chr, (*range(1, 0xD800), *range(0xE000, 0x10000))) if c != "�"]

    def expected(text):
        plain = "".join(c for c in unicodedata.normalize("NFKD", text.strip()) if not unicodedata.combining(c))
        return " ".join(plain.upper().split())

    got = spark.createDataFrame([(k, f"a{c}b") for k, c in enumerate(chars)], "k int, t string").select("k", L.fold(F.col("t")).alias("f")).collect()
    wrong = [(hex(ord(chars[r["k"]])), r["f"], expected(f"a{chars[r['k']]}b")) for r in got if r["f"] != expected(f"a{chars[r['k']]}b")]
    print(f"{len(wrong)} of {len(chars)} differ: {wrong[:20]}")
    assert all(unicodedata.category(chr(int(x, 16))) in ("Cn", "Ll") for x, *_ in wrong) and len(wrong) < 20  # letters whose upper case is newer than one of the two tables
    mixed = spark.createDataFrame([("½ ① ㎏ ﬁ 각 가 \U0001d400",)], "t string").select(L.fold(F.col("t"))).first()[0]
    assert mixed == expected("½ ① ㎏ ﬁ 각 가") + " \U0001d400"
