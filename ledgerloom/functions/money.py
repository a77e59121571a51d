"""Money in Brazilian or US notation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import SPACE, TEXT, Rule, looks_like

MONEY = "decimal(28,2)"


def _signed(c: Column) -> Column:
    """Digits and marks with a leading "-" if negative; a bracketed number is negative."""
    bare = F.when(c.rlike(r"\A[0-9.,-]*\z"), c).otherwise(F.translate(c, f"R$%{SPACE}", ""))
    return F.when(bare.startswith("(") & bare.endswith(")"), F.regexp_replace(F.regexp_replace(bare, r"^\((.*)\)$", "-$1"), "^--", "-")).otherwise(bare)


def _parts(signed: Column) -> Column:
    negative = signed.startswith("-")
    digits = F.when(negative, F.substr(signed, F.lit(2))).otherwise(signed)
    return F.when(signed.isNotNull(), F.struct(negative.alias("negative"), digits.alias("digits"), digits.contains(",").alias("comma"), digits.contains(".").alias("dot")))


def _amount(x: Column) -> Column:
    """The last of "," and "." is the decimal mark; several points without a comma are thousands."""
    digits, comma, dot = x["digits"], x["comma"], x["dot"]
    comma_is_mark = F.instr(F.reverse(digits), ",") < F.instr(F.reverse(digits), ".")
    number = (
        F.when(comma & dot & ~comma_is_mark, F.translate(digits, ",", ""))
        .when(comma, F.translate(F.translate(digits, ".", ""), ",", "."))
        .when(dot & (F.length(digits) - F.length(F.translate(digits, ".", "")) > 1), F.translate(digits, ".", ""))
        .otherwise(digits)
    )
    value = number.try_cast(MONEY)
    return F.when(x["negative"], -value).otherwise(value).cast(MONEY)


#: A decimal of two places, rounded half up; null if blank or not a number.
AMOUNT = Rule(*TEXT.steps, _signed, _parts, _amount, plain=(looks_like(r"\A-?[0-9]{1,24}(?:[.,][0-9]{1,9})?\z"), lambda c: F.translate(c, ",", ".").try_cast(MONEY)))


def to_money(c: Column) -> Column:
    return AMOUNT(c)


def brazilian(c: Column) -> Column:
    """R$ 1.234,56"""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(c, 2), ",.", ".,"))
