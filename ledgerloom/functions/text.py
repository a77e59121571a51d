"""Rules in steps; blank tests, trimming and accent folding."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that count as missing, in any case.
MISSING = ("", "-", "NAN", "NONE", "NAT")
SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

Step = Callable[[Column], Column]


class Rule:
    """A scalar rule as steps, each of which may refer to its input many times.

    staged() makes every step a column of its own, which code generation computes once. Called on a Column, a rule is one
    expression; that is handy, but its inner steps are interpreted.

    plain: what texts of the usual form look like, and one step that gives for them, and for null, what all steps so far give.
    staged() takes it where it can; other texts pay for all steps.
    """

    def __init__(self, *steps: Step, plain: tuple[Callable[[Column], Column], Step] | None = None):
        self.steps = steps
        self.plain = plain and (len(steps), *plain)

    def then(self, *steps: Step) -> Rule:
        out = Rule(*self.steps, *steps)
        out.plain = self.plain
        return out

    def __call__(self, c: Column) -> Column:
        for step in self.steps:
            c = let(c, step)
        return c


def staged(df: DataFrame, wanted: dict[str, tuple[Rule, Column]]) -> DataFrame:
    """df with a column for each rule on its Column. A projection for each step: Catalyst keeps those apart whose columns are used more than once."""
    held = {name: f"_step_{k}" for k, name in enumerate(wanted)}
    out = df.withColumns({held[name]: c for name, (_, c) in wanted.items()})
    left = {name: (first, *rest) for name, (first, rest) in ((name, _begun(rule)) for name, (rule, _) in wanted.items() if rule.steps)}
    for k in range(max(map(len, left.values()), default=0)):
        out = out.withColumns({held[name]: steps[k](F.col(held[name])) for name, steps in left.items() if k < len(steps)})
    return out.select(*(F.col(f"`{c}`") for c in df.columns if c not in wanted), *(F.col(held[name]).alias(name) for name in wanted))


def _begun(rule: Rule) -> tuple[Step, tuple[Step, ...]]:
    """The first step that staged() takes, and those after it: a plain text's only step is the first."""
    if rule.plain is None:
        return rule.steps[0], rule.steps[1:]
    n, usual, short = rule.plain

    def first(c: Column) -> Column:
        own = c.cast("string")
        return F.when(own.isNull() | usual(own), short(own)).otherwise(Rule(*rule.steps[:n])(c))

    return first, rule.steps[n:]


def looks_like(pattern: str) -> Callable[[Column], Column]:
    return lambda c: c.rlike(pattern)


def _folding() -> tuple[str, str, str, dict[str, str]]:
    """Of the basic plane: characters whose compatibility form without marks is one other character, and those characters; combining marks; and the forms of several characters. Hangul syllables are apart."""
    plain, folded, marks, several = [], [], [], {}
    for c in map(chr, (*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x10000))):
        x = "".join(y for y in unicodedata.normalize("NFKD", c) if not unicodedata.combining(y))
        if x == c:
            continue
        if not x:
            marks.append(c)
        elif len(x) == 1:
            plain.append(c)
            folded.append(x)
        else:
            several[c] = x
    return "".join(plain), "".join(folded), "".join(marks), several


ACCENTED, PLAIN, MARKS, SEVERAL = _folding()
#: Hangul syllables, those with a last part first, and their parts, by the rule that numbers them.
_TAILED = [k for k in range(11172) if k % 28]
_SYLLABLES = [*_TAILED, *range(0, 11172, 28)]
HANGUL = "".join(chr(0xAC00 + k) for k in _SYLLABLES)
PARTS = ("".join(chr(0x1100 + k // 588) for k in _SYLLABLES), "".join(chr(0x1161 + k % 588 // 28) for k in _SYLLABLES), "".join(chr(0x11A7 + k % 28) for k in _TAILED))


def let(c: Column, body: Step) -> Column:
    """body(c), with c evaluated once and written once into the plan however often body uses it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


#: ASCII texts without white space at either end, or any; a test of them costs a third of the look-ups character by character.
_BARE, _DENSE = r"\A[!-~](?:[ -~]*[!-~])?\z", r"\A[!-~]*\z"


def stripped(c: Column) -> Column:
    """Without Unicode white space at either end."""
    own = c.cast("string")
    return F.when(own.rlike(_BARE), own).otherwise(F.btrim(own, F.lit(SPACE)))


def without_space(c: Column) -> Column:
    return F.when(c.rlike(_DENSE), c).otherwise(F.translate(c, SPACE, ""))


def blank(c: Column) -> Column:
    return F.coalesce(F.upper(stripped(c)).isin(*MISSING), F.lit(True))


def _unless_missing(own: Column) -> Column:
    return F.when(~F.upper(own).isin(*MISSING), own)


#: The stripped text, or null if it is blank.
TEXT = Rule(stripped, _unless_missing)


def text_or_null(c: Column) -> Column:
    return F.when(~blank(c), stripped(c))


def _ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def repaired(c: Column) -> Column:
    """UTF-8 that was once read as Latin-1, read right; other text as it is."""
    latin = F.encode(c, "ISO-8859-1")
    mended = F.when(F.is_valid_utf8(latin.cast("string")), F.decode(latin, "UTF-8"))
    suspect = c.rlike("[Ã�]") & c.rlike(r"^[\x00-\xFF]*$")
    return F.coalesce(F.when(suspect, mended), c)


def _spelled_out(c: Column) -> Column:
    """Characters whose forms have several, as those. Texts without any pass by."""
    forms = F.str_to_map(F.lit("\x02".join(f"{k}\x01{x}" for k, x in SEVERAL.items())), F.lit("\x02"), F.lit("\x01"))
    syllable = lambda x: F.concat(*(F.translate(x, HANGUL, part) for part in PARTS))  # noqa: E731  a syllable without a last part loses it
    each = F.transform(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), lambda x: F.when(x.rlike("[\uac00-\ud7a3]"), syllable(x)).otherwise(F.coalesce(F.element_at(forms, x), x)))
    return F.when(F.char_length(F.translate(c, "".join(SEVERAL) + HANGUL, "")) < F.char_length(c), F.array_join(each, "")).otherwise(c)


def _unaccented(c: Column) -> Column:
    # translate() drops the marks, which have no counterpart
    return F.when(_ascii(c), c).otherwise(F.translate(c, ACCENTED + MARKS, PLAIN))


#: Accented letters of Latin-1 whose plain form is ASCII. The one that begins misread UTF-8 is left out.
_LATIN, _BASES = ("".join(x) for x in zip(*((c, x) for c, x in zip(ACCENTED, PLAIN, strict=True) if "\xc0" <= c <= "\xff" and c != "\xc3" and x.isascii()), strict=True))
_WORDS = rf"[!-~{_LATIN}](?:[ -~{_LATIN}]*[!-~{_LATIN}])?"


def _upper_plain(c: Column) -> Column:
    return F.upper(F.when(_ascii(c), c).otherwise(F.translate(c, _LATIN, _BASES)))


#: Upper case without accents, runs of white space as one blank; null as the empty text.
FOLD = Rule(
    lambda c: stripped(F.coalesce(c.cast("string"), F.lit(""))),
    lambda c: F.when(_ascii(c), c).otherwise(repaired(c)),
    _unaccented,
    lambda c: F.when(_ascii(c), c).otherwise(_spelled_out(c)),
    F.upper,
    lambda c: F.when(c.rlike(_DENSE), c).otherwise(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " ")),
    stripped,
    plain=(lambda c: c.rlike(rf"\A(?:{_WORDS})?\z") & ~c.contains("  "), lambda c: F.coalesce(_upper_plain(c), F.lit(""))),
)
#: The same, but null if the text is blank.
FOLDED_TEXT = Rule(*TEXT.steps, *FOLD.steps[1:], plain=(lambda c: c.rlike(rf"\A{_WORDS}\z") & ~c.contains("  "), lambda c: F.when(~F.upper(c).isin(*MISSING), _upper_plain(c))))


def fold(c: Column) -> Column:
    return FOLD(c)
