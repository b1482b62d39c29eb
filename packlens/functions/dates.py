"""Label dates: the accepted printed forms turned into ``DateType`` without a Python step."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packlens import fixed_values as fv
from packlens.functions.text import let, strip

_MONTH_WORD = "|".join([m.lower() for m in fv.MONTHS] + [m[:3].lower() for m in fv.MONTHS])
_MONTH_ABBR = "|".join(m[:3].lower() for m in fv.MONTHS)

# (pattern, group of day, group of month, group of year); two-digit years pivot at 69.
_FORMS = (
    (r"^(\d{1,2})([/\-.])(\d{1,2})\2(\d{4})$", 1, 3, 4),
    (r"^(\d{1,2})/(\d{1,2})/(\d{2})$", 1, 2, 3),
    (rf"(?i)^(\d{{1,2}})([/\-.])({_MONTH_ABBR})\2(\d{{4}})$", 1, 3, 4),
    (rf"(?i)^(\d{{1,2}})([/\-])({_MONTH_ABBR})\2(\d{{2}})$", 1, 3, 4),
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", 3, 2, 1),
    (rf"(?i)^({_MONTH_WORD})\s+(\d{{4}}|\d{{2}})$", None, 1, 2),
    (r"^(\d{1,2})[/\-](\d{4}|\d{2})$", None, 1, 2),
    # The day is beyond repair but month and year are certain: the first of the month stands in.
    (r"^\d{1,2}[/\-.](\d{1,2})[/\-.](\d{2}|\d{4})$", None, 1, 2),
)



def prepared(text: Column) -> Column:
    """Trim, reopen glued day-month runs and turn ``MAY-24`` into ``MAY 24``."""
    glued = F.regexp_replace(strip(text), r"^(\d{2})(\d{2})/(\d{4})$", "$1/$2/$3")
    return F.regexp_replace(glued, r"^(?!\d{1,2}[/\-.][A-Za-z]{3,9}[/\-.]\d{2,4}$)(.*?[A-Za-z])[-/](?=\d)", "$1 ")


def parse_label_date(text: Column) -> Column:
    """Date of a printed form, null when no form fits."""
    return let(prepared(text), _first_form)


def parse_label_dates(texts: Column) -> Column:
    """Dates of an array of printed forms (nulls kept in place)."""
    return F.transform(F.transform(texts, lambda t: prepared(t)), lambda s: _first_form(s))


def _month_number(word: Column) -> Column:
    names = F.lit(" " + " ".join(m[:3].lower() for m in fv.MONTHS))
    place = F.instr(names, F.lower(F.substring(word, 1, 3)))
    return F.when(word.rlike("^[A-Za-z]"), F.floor((place + 2) / 4).cast("string")).otherwise(word)


def _first_form(s: Column) -> Column:
    """First form that fits: a day-month-year or month-year split into ISO text, then a checked cast."""
    arms = []
    for pattern, day, month, year in _FORMS:
        y, m = F.regexp_extract(s, pattern, year), F.regexp_extract(s, pattern, month)
        d = F.regexp_extract(s, pattern, day) if day else F.lit("1")
        century = F.when(F.length(y) == 4, "").when(y >= "69", "19").otherwise("20")
        low = "1900" if pattern == _FORMS[-1][0] else "0001"
        iso = F.concat(century, y, F.lit("-"), _month_number(m), F.lit("-"), d)
        arms.append(F.when(s.rlike(pattern) & (iso >= low), iso.try_cast("date")))
    return F.coalesce(*arms)
