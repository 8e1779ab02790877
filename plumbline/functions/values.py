"""Typed-by-people values as columns: fillers, cut-off texts, ratings, dates and amounts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .units import leading_unit, parse_unit, trailing_unit

#: What stands in a cell instead of a value, in lower case and without outer blanks.
FILLERS = (
    "", "-", "--", "?", ".", "n/a", "na", "n.a.", "none", "null", "nil", "tbc", "tbd", "to be confirmed", "xxx", "unknown",
    "not provided", "not available", "not applicable", "not yet agreed", "see previous return", "as before", "withheld",
    "withheld - commercial", "redacted", "exempt",
)
#: Marks that a cut-off text may end with.
CUT_MARKS = r"(\.\.\.|…|\[cont\]?|\(cont\)?)\s*$"
#: Words with which programme names end, as they are written out.
PROGRAMME_WORDS = ("project", "programme", "scheme", "delivery", "upgrade", "phase")
#: Accepted short forms of those words, which are no cut-off words.
SHORT_FORMS = ("proj", "prj", "prjct", "prog", "prgm", "pgm", "sch", "schm", "del", "deliv", "upgr", "ph")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
NUMBER_WORDS = (
    "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen",
    "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty",
)
#: A bare amount in a column of millions of this size or more can only be whole pounds.
WHOLE_POUNDS_FROM = 500_000


def is_filler(value: Column) -> Column:
    """True for null, blank and filler cells; never null."""
    return F.coalesce(F.lower(F.trim(F.regexp_replace(value, r"\s+", " "))).isin(*FILLERS), F.lit(True))


def is_cut_text(value: Column) -> Column:
    """A running text that stops without a sentence's end, or with a mark of continuation.  Null for null."""
    text = F.rtrim(value)
    return F.coalesce(text.rlike("(?i)" + CUT_MARKS) | ~text.rlike(r"[.!?:;)\]\"'”’]$"), F.lit(False))


def is_cut_name(value: Column) -> Column:
    """A name that ends with a mark of continuation or inside one of PROGRAMME_WORDS."""
    stems = sorted({w[:i] for w in PROGRAMME_WORDS for i in range(1, len(w))} - set(SHORT_FORMS))
    inside = r"(?i)[\s_\-]\S+[\s_\-](" + "|".join(stems) + r")\s*$"
    return F.coalesce(value.rlike("(?i)" + CUT_MARKS) | value.rlike(inside), F.lit(False))


def plain_name(value: Column) -> Column:
    """A name in lower case with single blanks for everything that is no letter or digit."""
    return F.trim(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", " "))


def squeezed_name(value: Column) -> Column:
    """A name without letter case, white space and punctuation."""
    return F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", "")


def rating(value: Column) -> Column:
    """Delivery confidence as written by anyone: G, AG, A, AR or R; other text squeezed; null for fillers."""
    text = F.regexp_replace(F.lower(value), "[^a-z]+", "")
    text = F.regexp_replace(text, "green", "g")
    text = F.regexp_replace(text, "amber", "a")
    text = F.regexp_replace(text, "red", "r")
    return F.when(~is_filler(value), F.upper(text))


def day_first_date(value: Column) -> Column:
    """A date in any of the usual writings, day before month; null when it can't be read."""
    text = F.lower(F.trim(value))
    named = F.regexp_extract(text, r"^(\d{1,2})[\s\-./]+([a-z]{3})[a-z]*[\s\-./,]+(\d{4}|\d{2})$", 2)
    month = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), named).cast("int"), F.lit(0))

    def part(pattern, group):
        return F.regexp_extract(text, pattern, group).try_cast("int")

    words = r"^(\d{1,2})[\s\-./]+[a-z]{3,}[\s\-./,]+(\d{4}|\d{2})$"
    iso, packed = r"^(\d{4})[\-./](\d{1,2})[\-./](\d{1,2})(?:[t ].*)?$", r"^(\d{4})(\d{2})(\d{2})$"
    numeric = r"^(\d{1,2})[\-./](\d{1,2})[\-./](\d{4}|\d{2})$"

    def full(year):
        return F.when(year < 70, year + 2000).when(year < 100, year + 1900).otherwise(year)

    def made(y, m, d):
        ymd = F.format_string("%04d-%02d-%02d", y, m, d)
        return F.when(y.isNotNull() & m.isNotNull() & d.isNotNull(), F.try_to_date(ymd, "yyyy-MM-dd"))

    return F.coalesce(
        made(part(iso, 1), part(iso, 2), part(iso, 3)),
        made(part(packed, 1), part(packed, 2), part(packed, 3)),
        made(full(part(numeric, 3)), part(numeric, 2), part(numeric, 1)),
        made(full(part(words, 2)), month, part(words, 1)),
    )


def _factors(read, series: pd.Series) -> pd.Series:
    """Pounds per unit, worked out once per distinct text."""

    def factor(text):
        unit = read(text) if text else None
        return unit.factor if unit is not None and unit.dimension in (None, "money") else None

    known = {t: factor(t) for t in series.dropna().unique()}
    return series.map(known).astype("float64")


def _whole_unit(text: str):
    # long texts stay out of the cache
    return (parse_unit if len(text) <= 400 else parse_unit.__wrapped__)(text)


@F.pandas_udf(DoubleType())
def _unit_factor(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Pounds per unit named in a text of a money field; null where none is named."""
    for series in texts:
        yield _factors(_whole_unit, series)


@F.pandas_udf(DoubleType())
def _leading_factor(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in texts:
        yield _factors(leading_unit, series)


@F.pandas_udf(DoubleType())
def _trailing_factor(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in texts:
        yield _factors(trailing_unit, series)


def unit_around(before: Column, after: Column) -> Column:
    """Pounds per unit as written behind a number or before it; of two the one behind counts with its scale.

    A sign of pounds before the number and a scale behind it are one unit.  Null where neither side begins, or ends, with a unit.
    """
    behind, ahead = _leading_factor(after), _trailing_factor(before)
    return F.coalesce(behind, ahead)


def unit_factor(text: Column) -> Column:
    return _unit_factor(text)


_NUMBER = r"\d[\d,]*(?:\.\d+)?"
def cell_parts(cell: Column) -> Column:
    """struct(number decimal, unit string) of a money cell; number null for fillers and prose."""
    text = F.trim(cell)
    whole = r"(?i)^([^\d.,]*(?:'?000\s+(?=\d))?)\s*(" + _NUMBER + r")\s*([^\d]*(?:000\)?)?)$"
    number = F.regexp_replace(F.regexp_extract(text, whole, 2), ",", "").try_cast("decimal(24,6)")
    unit = F.trim(F.concat_ws(" ", F.regexp_extract(text, whole, 1), F.regexp_extract(text, whole, 3)))
    return F.struct(F.when(~is_filler(cell), number).alias("number"), unit.alias("unit"))


#: What introduces a statement of the unit of all figures in a row ...
_NOTE = r"(?i)\b(?:figures|amounts|values|sums|entered|stated|money)\b([^.\d,;£]*(?:£(?:\s?'?000)?[^.\d,;£]*){0,50})"
#: ... and what introduces the whole-life cost in a narrative.
_LIFE = r"(?i)(?:\bwlc\b|whole[\s-]*life|life[\s-]?cycle|life[\s-]?time|over (?:its |the )?life)"


def note_unit(narrative: Column) -> Column:
    """The text that states the unit of a row's bare amounts; empty when nothing does."""
    return F.coalesce(F.regexp_extract(narrative, _NOTE, 1), F.lit(""))


def life_cost_parts(narrative: Column) -> Column:
    """struct(number, before, after) of the whole-life cost stated in a narrative, with the texts between which its number
    stands; other amounts are left aside.

    The texts reach to the mention of the whole life, and to the next number or the end; units are read from them by
    segmentation, so no unit is named here.  A number may be spelled out before a word of scale.
    """
    # loops over single characters only: a loop over alternatives would recurse, and overflow on a very long text
    pattern = _LIFE + r"([^\d.]*?(?:[£']\s?'?000\b[^\d.]*?)?)(" + _NUMBER + r")([^\d(]*(?:\(£?'?000\))?[^\d]*)"
    number = F.regexp_replace(F.regexp_extract(narrative, pattern, 2), ",", "").try_cast("decimal(24,6)")
    words = "|".join(NUMBER_WORDS)
    spoken = _LIFE + r"[^\d£.]*?\b(" + words + r")\s+(\p{L}[^\d]*)"
    word = F.lower(F.regexp_extract(narrative, spoken, 1))
    value = F.lit(None).cast("decimal(24,6)")
    for i, name in enumerate(NUMBER_WORDS, 1):
        value = F.when(word == name, F.lit(i).cast("decimal(24,6)")).otherwise(value)
    # a word such as "one" counts only when a unit follows it
    said = F.when(value.isNotNull() & _leading_factor(F.regexp_extract(narrative, spoken, 2)).isNotNull(), value)
    return F.struct(
        F.coalesce(said, number).alias("number"),
        F.when(said.isNull(), F.regexp_extract(narrative, pattern, 1)).otherwise("").alias("before"),
        F.when(said.isNotNull(), F.regexp_extract(narrative, spoken, 2)).otherwise(F.regexp_extract(narrative, pattern, 3)).alias("after"),
    )


def pounds(number: Column, own: Column, note: Column) -> Column:
    """Whole pounds: by the amount's own unit, else the row's note, else the size of the number."""
    bare = F.when(number >= WHOLE_POUNDS_FROM, F.lit(1.0)).otherwise(F.lit(1e6))
    factor = F.coalesce(own, note, bare)
    return F.round(number * factor.cast("decimal(20,3)"), 0).cast("long")


def effective_factor(number: Column, own: Column, note: Column) -> Column:
    bare = F.when(number >= WHOLE_POUNDS_FROM, F.lit(1.0)).otherwise(F.lit(1e6))
    return F.when(number.isNotNull(), F.coalesce(own, note, bare))
