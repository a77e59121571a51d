"""Texts of the usual form take one step; the result is what all steps give."""

import pytest
from pyspark.sql import functions as F

from ledgerloom import functions as L
from ledgerloom.functions.text import Rule

RULES = {
    "amount": L.AMOUNT, "date": L.DATE, "current": L.installment_rule(), "total": L.installment_rule(1), "authorization": L.authorization_rule(), "alphanumeric": L.authorization_rule(keep_alphanumeric=True),
    "nsu": L.NSU, "key": L.MATCH_KEY, "fold": L.FOLD, "folded_text": L.FOLDED_TEXT, "brand": L.BRAND, "modality": L.MODALITY, "form": L.payment_form_rule(), "text": L.TEXT,
}
TEXTS = [
    None, "", " ", "-", "nan", "None", "NaT", "NÁN", "0", "00", "000000", "0000000", "0.0", "0.", ".0", "1", "-1", "--1", "(1)", "12,5", "12.5", "1,005", "-1,005", "0,995", "-0", "-0,00", "1.234,56", "1,234.56", "1.234.567", "1,2,3", "5,",
    ",5", "9" * 24, "9" * 24 + ",999", "9" * 26, "9" * 27, "1e5", "R$ 1,00", "2024-02-29", "2023-02-29", "2024-2-9", "0000-00-00", "0001-01-01", "9999-12-31", "2024-02-29 ", "2024-02-29\n", "29/02/2024", "45000", "2024-01-01T10:00",
    "1/3", "1/3/5", "1 de 3", "1/", "/3", "0/0", "03/012", "1x/3x", "1-3", "999999999/999999999", "9999999999/1", "123456", "0123456", "1234567", "001234567", " 12", "12 ", "  12.0 ", "12.00", "12.01", "12.0.0", "1 2", "Z12", "z12", "\t12", "12\n",
    "١٢", "visa", "Visa", "MasterCard", "Elo Débito", "Crédito à vista", "débito", "CRÃ‰DITO", "CrÃ©dito", "Ã", "ã", "São  José", " São José", "São José ", "São\tJosé", "ß", "ÿ", "ø", "æ", "Ñandú", "ﬁ", "Å", "à\u0301", "e\u0301", "REDE 10X MASTER", "rede débito  visa", "PIX", "\x00", "a\x1fb", "한", "x" * 5000, "é " * 5000 + "z",
]


@pytest.mark.parametrize("name", RULES)
def test_a_plain_text_gets_what_all_steps_give(spark, name):  # F7 to F24
    rule = RULES[name]
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "k int, x string")
    short = {r["k"]: r["y"] for r in L.staged(rows, {"y": (rule, F.col("x"))}).select("k", "y").collect()}
    long = {r["k"]: r["y"] for r in L.staged(rows, {"y": (Rule(*rule.steps), F.col("x"))}).select("k", "y").collect()}
    assert {TEXTS[k]: v for k, v in short.items()} == {TEXTS[k]: v for k, v in long.items()}


def test_plain_texts_take_one_step(spark):  # F7 to F24
    fails = lambda c: F.raise_error(F.concat(F.lit("all steps for "), c)).cast("string")
    for rule, text in ((L.NSU, "0012"), (L.AMOUNT, "12,50"), (L.DATE, "2024-02-29"), (L.authorization_rule(), " 12.0"), (L.BRAND, "Elo Débito"), (L.installment_rule(1), "1/3"), (L.MATCH_KEY, "012")):
        n, *usual = rule.plain
        strict = Rule(fails, *rule.steps[1:n], plain=usual).then(*rule.steps[n:])
        rows = spark.createDataFrame([(text,), (None,)], "x string")
        got, all_steps = ([r["y"] for r in L.staged(rows, {"y": (x, F.col("x"))}).collect()] for x in (strict, Rule(*rule.steps)))
        assert got == all_steps and got[0] is not None
