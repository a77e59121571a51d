"""Instalments: parsing, what remains, and how two sides compare."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import TEXT, Rule, looks_like

#: Criteria of comparison, from the worst to the best.
CRITERIA = ("DIVERGENCIA_PARCELAS_RESTANTES", "DADOS_PARCELA_INSUFICIENTES", "COMPATIVEL_POR_PARCELAS_RESTANTES", "EXATA")
DIFFERENT, UNKNOWN, SAME_REMAINING, EXACT = CRITERIA
SEPARATORS = ("/", " de ", "-")


def installment_rule(part: int = 0) -> Rule:
    """The first (0) or second (1) number of texts such as "1/3" or "1 de 3"; one without a separator counts for both."""

    def number(text: Column) -> Column:
        piece = text
        for separator in reversed(SEPARATORS):
            before = F.substring_index(text, separator, 1)
            own = before if part == 0 else F.substr(text, F.length(before) + len(separator) + 1)
            piece = F.when(text.contains(separator), own).otherwise(piece)
        return F.regexp_extract(piece, r"(\d+)", 1).try_cast("int")

    usual = looks_like(r"\A[0-9]{1,9}(?:/[0-9]{1,9})?\z")
    return Rule(*TEXT.steps, lambda text: F.translate(F.lower(text), "x", ""), number, plain=(usual, lambda c: F.substring_index(c, "/", -1 if part else 1).try_cast("int")))


def installment(c: Column, part: int = 0) -> Column:
    return installment_rule(part)(c)


def remaining(current: Column, total: Column) -> Column:
    return F.when((current > 0) & (total > 0) & (current <= total), total - current)


def criterion(current_a: Column, total_a: Column, current_b: Column, total_b: Column) -> Column:
    a, b = remaining(current_a, total_a), remaining(current_b, total_b)
    return (
        F.when(a.isNull() | b.isNull(), F.lit(UNKNOWN))
        .when((current_a == current_b) & (total_a == total_b), F.lit(EXACT))
        .when(a == b, F.lit(SAME_REMAINING))
        .otherwise(F.lit(DIFFERENT))
    )
