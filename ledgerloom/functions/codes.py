"""Identifiers, authorisations, brands, modalities and payment forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import FOLD, FOLDED_TEXT, TEXT, Rule, blank, looks_like, without_space

#: Fixed values.
BAD_LENGTH = "AUTORIZACAO_TAMANHO_INVALIDO"
NOT_GIVEN, OTHER = "NAO_INFORMADO", "OUTRA"
BRANDS = (("VISA", "VISA"), ("MASTERCARD", "MASTER"), ("ELO", "ELO"), ("AMEX", "AMEX"), ("AMEX", "AMERICAN EXPRESS"), ("HIPERCARD", "HIPER"))
MODALITIES = (("CREDITO", "CREDIT"), ("DEBITO", "DEBIT"), ("PIX", "PIX"))

NO_LEADING_ZEROS = r"^0+(?=.)"

#: Upper case, without white space and a spreadsheet's trailing .0; null if blank.
IDENTIFIER = TEXT.then(lambda own: F.when(own.contains("."), F.regexp_replace(own, r"\.0+$", "")).otherwise(own), lambda own: F.upper(without_space(own)))


def identifier(c: Column) -> Column:
    return IDENTIFIER(c)


def authorization_rule(keep_alphanumeric: bool = False) -> Rule:
    """struct(value, error): six characters with leading zeros. A longer one stays as its identifier, with an error.

    keep_alphanumeric: the rule holds for digits only; other identifiers stay untouched.
    """
    with_short = lambda own: F.when(own.isNotNull(), F.struct(own.alias("own"), F.regexp_replace(own, NO_LEADING_ZEROS, "").alias("short"), own.rlike("^[0-9]+$").alias("digits")))

    def judged(x: Column) -> Column:
        fits = F.length(x["short"]) <= 6
        applies = x["digits"] if keep_alphanumeric else F.lit(True)
        value = F.when(applies & fits, F.lpad(x["short"], 6, "0")).otherwise(x["own"])
        return F.struct(value.alias("value"), F.when(applies & ~fits, F.lit(BAD_LENGTH)).alias("error"))

    digits = lambda c: F.ltrim(F.substring_index(F.btrim(c), ".", 1), F.lit("0"))
    usual = (looks_like(r"\A *0*[0-9]{1,6}(?:\.0+)? *\z"), lambda c: F.struct(F.lpad(digits(c), 6, "0").alias("value"), F.lit(None).cast("string").alias("error")))
    return Rule(*IDENTIFIER.steps, with_short, judged, plain=usual)


def authorization(c: Column, keep_alphanumeric: bool = False) -> Column:
    return authorization_rule(keep_alphanumeric)(c)


def _without_zeros(c: Column) -> Column:
    bare = F.ltrim(c, F.lit("0"))
    return F.when(bare == "", F.lit("0")).otherwise(bare)


_DIGITS = looks_like(r"\A[0-9]+\z")
NSU = Rule(*IDENTIFIER.steps, lambda own: F.when(own.rlike("^[0-9]+$"), F.regexp_replace(own, NO_LEADING_ZEROS, "")).otherwise(own), plain=(_DIGITS, _without_zeros))


def nsu(c: Column) -> Column:
    return NSU(c)


#: What authorisations are joined on: digits lose all leading zeros, so one of zeros only matches nothing.
MATCH_KEY = Rule(
    *TEXT.steps, lambda own: F.upper(without_space(own)), lambda x: F.when(x.contains("."), F.regexp_replace(x, r"\.0+$", "")).otherwise(x), lambda x: F.nullif(F.when(x.rlike("^[0-9]+$"), F.ltrim(x, F.lit("0"))).otherwise(x), F.lit("")),
    plain=(_DIGITS, lambda c: F.nullif(F.ltrim(c, F.lit("0")), F.lit(""))),
)


def match_key(c: Column) -> Column:
    return MATCH_KEY(c)


def _first_contained(rules: tuple[tuple[str, str], ...]):
    def judged(text: Column) -> Column:
        out = F.when(text == "", F.lit(NOT_GIVEN))
        for name, token in rules:
            out = out.when(text.contains(token), F.lit(name))
        return out.otherwise(F.lit(OTHER))

    return judged


BRAND, MODALITY = FOLD.then(_first_contained(BRANDS)), FOLD.then(_first_contained(MODALITIES))


def brand(c: Column) -> Column:
    return BRAND(c)


def modality(c: Column) -> Column:
    return MODALITY(c)


def payment_form_rule(operator: str = "REDE") -> Rule:
    """struct(operator, modality, brand, installments) of texts such as "REDE 10X MASTER"; only that operator's are parsed further."""

    def parsed(words: Column) -> Column:
        word = lambda k: F.get(words, F.lit(k))
        known = F.coalesce(word(0) == operator, F.lit(False))
        times = F.regexp_extract(word(1), r"^(\d+)X$", 1)
        debit, credit = known & (word(1) == "DEBITO"), known & (times != "")
        return F.struct(
            F.nullif(word(0), F.lit("")).alias("operator"),
            F.when(debit, F.lit("DEBITO")).when(credit, F.lit("CREDITO")).alias("modality"),
            F.when((debit | credit) & word(2).isNotNull(), _first_contained(BRANDS)(word(2))).alias("brand"),  # folded already
            F.when(debit, F.lit(1)).when(credit, times.try_cast("int")).alias("installments"),
        )

    return FOLDED_TEXT.then(lambda text: F.split(text, " "), parsed)


def payment_form(c: Column, operator: str = "REDE") -> Column:
    return payment_form_rule(operator)(c)


def service_order(c: Column) -> Column:
    """The number in texts such as "OS: 022-67324-620"."""
    return F.when(~blank(c), F.nullif(F.regexp_extract(c.cast("string"), r"(?iU)OS:\s*([\w./-]+)", 1), F.lit("")))
