"""Column helpers for text: Unicode-aware patterns, trimming, line splitting and number formatting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Whitespace in the Unicode sense; ``trim`` alone only knows the space character.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def ci(pattern: str) -> str:
    """Case-insensitive, Unicode classes, ``.`` stops at newline only."""
    return "(?iuUd)" + pattern


def cs(pattern: str) -> str:
    """Case-sensitive, Unicode classes, ``.`` stops at newline only."""
    return "(?uUd)" + pattern


def gated(pattern: str, first: str) -> str:
    """The same pattern behind one look at its first character, where an alternation would try all its arms at every place.

    ``first``: every character that a match can begin with, as it stands in brackets. Groups keep their numbers.
    """
    return f"(?=[{first}])(?:{pattern})"


def stage(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that later expressions read as plain values.

    A projection may be merged into the next one, which would move a long text expression into every
    lambda that mentions it. A one-row ``inline`` is not merged, so each column is computed once per row.
    """
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, F.inline(F.array(F.struct(*[v.alias(k) for k, v in cols.items()]))))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: a one-element transform names it.

    Without a name every mention would repeat the whole expression, and nested repeats grow fast.
    """
    return F.get(F.transform(F.array(value), lambda v: use(v)), 0)


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, null when the pattern does not occur."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def strip(text: Column, chars: str = WHITESPACE) -> Column:
    return F.btrim(text, F.lit(chars))


def squeeze(text: Column) -> Column:
    """Collapse whitespace runs to one space and trim."""
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def lines_of(text: Column) -> Column:
    """Lines of a text, without the empty line after a trailing break."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), f"(?:{LINE_BREAK})$", ""), LINE_BREAK, -1)
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(parts)


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{L}", ""))


def digit_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{Nd}", ""))


def plain_number(text: Column) -> Column:
    """Number with thousands separators and stray spaces removed; null when it is not a number."""
    digits = F.regexp_extract(F.translate(text, ", ", ""), r"^(\d+\.?\d*|\.\d+)$", 1)
    return digits.try_cast("double")


def replace_each(text: Column, pattern: str, build: Callable[[Column], Column]) -> Column:
    """Replace every match of ``pattern`` by ``build(match)``.

    The pieces between matches and the matches themselves come from the same pattern, so putting them
    side by side rebuilds the text.
    """
    pieces = F.split(text, pattern, -1)
    built = F.transform(all_matches(text, pattern), lambda m: build(m))
    pairs = F.zip_with(pieces, built, lambda p, m: F.concat(p, F.coalesce(m, F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(pairs, "")).otherwise(text)


def float_text(value: Column) -> Column:
    """Shortest decimal text of a double, plain notation up to 1e16."""
    plain = value.cast("string")
    wide = F.rtrim(value.cast("decimal(38,12)").cast("string"), F.lit("0"))
    wide = F.when(wide.endswith("."), F.concat(wide, F.lit("0"))).otherwise(wide)
    big = (F.abs(value) >= 1e7) & (F.abs(value) < 1e16)
    return F.when(big, wide).otherwise(plain)


def short_number(value: Column) -> Column:
    """Six significant digits without trailing zeros (the ``%g`` form)."""
    raw = F.format_string("%.6g", value.cast("double"))
    bare = F.when(raw.contains("."), F.regexp_replace(raw, r"\.?0+(e|$)", "$1")).otherwise(raw)
    return F.when(value.isNotNull(), bare)


def two_decimals(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%.2f", F.rint(value * 100) / 100))
