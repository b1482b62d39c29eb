"""Label fields out of recognised text, as column expressions."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packlens import fixed_values as fv
from packlens.functions.dates import parse_label_date, parse_label_dates
from packlens.functions.text import (
    all_matches, ci, cs, digit_count, first_match, gated, let, letters, lines_of, plain_number, replace_each, strip,
)

# Patterns that long texts are searched with, by what their matches begin with.
GATED_MRP = gated(fv.P_MRP, "mr")
GATED_MRP_GARBLED = gated(fv.P_MRP_GARBLED, "mr")
GATED_NUTRITION = gated(fv.P_NUTRITION, "spéenvkcl/wimbtofhr")
GATED_NUTRITION_TABLE = gated(fv.P_NUTRITION_TABLE, "np%v")
GATED_MFG = gated(fv.P_MFG, "mp")
GATED_EXP = gated(fv.P_EXP, "ebu")
GATED_CARE = gated(fv.P_CARE, "cht")
GATED_QTY_HEAD = gated(fv.P_QTY_HEAD, "nd")
GATED_QTY_ANCHORED = gated(fv.P_QTY_ANCHORED, "nd")
GATED_MAKER_ANCHOR = gated(fv.P_MAKER_ANCHOR, "mpr")
GATED_MAKER_STOP = gated(fv.P_MAKER_STOP, "chnmebfl")
GATED_GENERIC_SKIP = gated(fv.P_GENERIC_SKIP, "sdlrkcbuin")

DIGIT_LOOKALIKES = ("OolISsB", "0011558")
NO_TEXT = "array<string>"


def none_of_text() -> Column:
    return F.array().cast(NO_TEXT)


def drop_repeats(segments: Column) -> Column:
    """Consecutive equal segments kept once."""
    return F.filter(segments, lambda s, i: (i == 0) | (s != F.get(segments, i - 1)))


def line_context(lines: Column, pattern: str) -> Column:
    """For every line that matches: its position and the two lines before and after."""
    def row(line: Column, i: Column) -> Column:
        def at(offset: int) -> Column:
            return F.coalesce(F.get(lines, i + offset), F.lit(""))

        return F.when(line.rlike(pattern), F.struct(
            i.alias("pos"), at(-2).alias("prev2"), at(-1).alias("prev1"), at(1).alias("next1"), at(2).alias("next2")))

    return F.array_compact(F.transform(lines, row))


def first_of(items: Column) -> Column:
    return F.get(F.array_compact(items), 0)


def first_where(items: Column, kind: T.DataType | str, holds: Callable[[Column], Column]) -> Column:
    """The first item for which ``holds``; items behind it are not looked at."""
    kind = kind if isinstance(kind, str) else kind.simpleString()
    return F.aggregate(items, F.lit(None).cast(kind), lambda found, item: F.when(found.isNotNull(), found).otherwise(F.when(holds(item), item)))


# --- repairs -------------------------------------------------------------------------------------
def _closest(vocabulary: tuple[str, ...], cutoff: float) -> Callable:
    def closest(words: pd.Series) -> pd.Series:
        """Best vocabulary word per candidate; candidates were narrowed down before and are rare."""
        seen: dict[str, str | None] = {}

        def best(word: str) -> str | None:
            if word not in seen:
                hit = difflib.get_close_matches(word.title(), vocabulary, n=1, cutoff=cutoff)
                seen[word] = hit[0] if hit else None
            return seen[word]

        return words.map(lambda ws: None if ws is None else [best(w) for w in ws])

    return F.pandas_udf(closest, T.ArrayType(T.StringType()))


def near_words(words: Column, vocabulary: tuple[str, ...], cutoff: float) -> Column:
    """Candidates that can reach the cutoff.

    A match ratio of ``c`` leaves at most ``(1 - c) * (len a + len b)`` insertions and deletions, so a
    larger edit distance rules a word out. The words left are few; null where there are none.
    """
    slack = round(1 - cutoff, 4)

    def can_match(word: Column) -> Column:
        title = F.initcap(word)
        hits = None
        for v in vocabulary:
            hit = F.levenshtein(title, F.lit(v)) <= (F.length(word) + len(v)) * slack + 1e-9
            hits = hit if hits is None else hits | hit
        return hits & ~title.isin(*vocabulary)

    rare = F.filter(F.array_distinct(words), can_match)
    return F.when(F.size(rare) > 0, rare)


def month_candidates(text: Column) -> Column:
    return F.when(text.rlike(cs(fv.P_MONTH_YEAR)),
                  near_words(all_matches(text, cs(fv.P_MONTH_YEAR), 1), fv.MONTHS, 0.8))


def closest_months(candidates: Column) -> Column:
    return _closest(fv.MONTHS, 0.8)(candidates)


def fix_month_tokens(text: Column, candidates: Column, months: Column) -> Column:
    """Write the recognised month in place of each mangled one that stands before a year."""
    pairs = F.filter(F.arrays_zip(candidates.alias("word"), months.alias("month")), lambda p: p["month"].isNotNull())
    fixed = F.aggregate(pairs, text, lambda acc, p: F.regexp_replace(
        acc, F.concat(F.lit(r"\b"), p["word"], F.lit(r"\s+(20\d{2})\b")), F.concat(p["month"], F.lit(" $1"))))
    return F.when(candidates.isNotNull(), fixed).otherwise(text)


def fix_qty_units(text: Column) -> Column:
    """Unit confusions on net-quantity lines; digit-glued millilitre typos on any line."""
    def fix(line: Column) -> Column:
        unit = F.regexp_replace(line, cs(r"(?<=\d)\s*9\b"), " g")
        unit = F.regexp_replace(unit, ci(r"(?<=\d)\s*q\b"), " g")
        unit = F.regexp_replace(unit, ci(r"(?<=\d)\s*(?:unt|unlt|unl|nit)\b"), " unit")
        scoped = F.when(line.rlike(ci(GATED_QTY_HEAD)), unit).otherwise(line)
        return F.regexp_replace(scoped, ci(r"(?<=\d)\s*(?:mla|mle|mie|rnI|m1)\b"), " ml")

    lines = lines_of(text)  # what a pattern finds on a line it finds in the whole text too
    scoped = text.rlike(ci(GATED_QTY_HEAD)) | text.rlike(ci(r"(?<=\d)\s*(?:mla|mle|mie|rnI|m1)\b"))
    return F.array_join(F.when(scoped, F.transform(lines, fix)).otherwise(lines), "\n")


def fix_mrp_digits(text: Column) -> Column:
    """Letters that look like digits inside a price of at least two real digits."""
    pattern = ci(GATED_MRP_GARBLED)

    def fix(match: Column) -> Column:
        def mended(amount: Column) -> Column:
            head = F.substring(match, F.lit(1), F.length(match) - F.length(amount))
            return F.when(digit_count(amount) >= 2, F.concat(head, F.translate(amount, *DIGIT_LOOKALIKES))).otherwise(match)

        return let(F.regexp_extract(match, pattern, 2), mended)

    return replace_each(text, pattern, fix)


def fix_date_tokens(text: Column) -> Column:
    """Letters that look like digits inside day/month/year runs; separators become slashes."""
    return replace_each(text, cs(fv.P_DATE_TOKEN), lambda m: F.translate(m, "IlO-.", "110//"))


# --- numbers -------------------------------------------------------------------------------------
def quantity_number(raw: Column) -> Column:
    """Quantity with barcode glue repaired: leading zeros go, and of a long glued run three digits stay."""
    bare = F.translate(raw, ", ", "")
    unglued = F.regexp_replace(bare, r"^0+(\d+(?:\.\d+)?)$", "$1")
    # Five or more whole digits behind leading zeros: only the last three were printed as the quantity.
    short = F.when(bare.rlike(r"^0+\d{5,}(?:\.\d+)?$") & unglued.rlike(r"^\d{5,}"),
                   F.regexp_replace(unglued, r"^\d+(\d{3}(?:\.\d+)?)$", "$1")).otherwise(unglued)
    return let(plain_number(short), lambda v: F.when(v > 0, v))


def quantity_unit(raw: Column) -> Column:
    return F.regexp_replace(F.lower(strip(raw)), "s+$", "")


# --- price ---------------------------------------------------------------------------------------
def _split_price(lines: Column) -> Column:
    """Keyword and amount on neighbouring lines, amount below first, then above."""
    def forward(i: Column) -> Column:
        below = F.filter(F.slice(lines, i + 2, 2), lambda s: (strip(s) != "") & ~s.rlike(ci(fv.P_MRP_POISON))
                         & s.rlike(cs(fv.P_MRP_AMOUNT_LINE)))
        return F.transform(F.slice(below, 1, 1), lambda s: F.regexp_extract(s, cs(fv.P_MRP_AMOUNT_LINE), 1))

    def backward(i: Column) -> Column:
        above = F.reverse(F.slice(lines, F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2))))
        left = F.transform(above, lambda s: F.split(s, ci(fv.P_MRP_POISON), 2)[0])
        priced = F.filter(left, lambda s: (strip(s) != "") & s.rlike(r"Rs\.?|INR|₹") & s.rlike(cs(fv.P_MRP_TRAILING_AMOUNT)))
        return F.transform(F.slice(priced, 1, 1), lambda s: F.regexp_extract(s, cs(fv.P_MRP_TRAILING_AMOUNT), 1))

    def per_line(line: Column, i: Column) -> Column:
        bare = line.rlike(ci(fv.P_MRP_KEYWORD)) & ~line.rlike(cs(fv.P_MRP_HAS_AMOUNT))
        return F.when(bare, F.concat(forward(i), F.when(i > 0, backward(i)).otherwise(none_of_text())))

    return plain_number(F.get(F.flatten(F.array_compact(F.transform(lines, per_line))), 0))


# A price cue inside the 40 characters before the rupee sign or the 10 after the amount.
_CUE_BEFORE = r"(?<=(?:mrp[\s\S]{0,37}|price[\s\S]{0,35}|\brs\b[\s\S]{0,38}|inclusive[\s\S]{0,31}))"
_CUE_AFTER = r"(?=[\s\S]{0,7}mrp|[\s\S]{0,5}price|[\s\S]{0,8}\brs\b|[\s\S]{0,1}inclusive)"
_RUPEE = f"(?:{_CUE_BEFORE}{fv.P_RUPEE_AMOUNT}|{fv.P_RUPEE_AMOUNT}{_CUE_AFTER})"


def rupee_price(text: Column) -> Column:
    hit = first_match(text, ci(_RUPEE), 0)
    return plain_number(F.regexp_extract(hit, r"₹\s*([\d,]+(?:\.\d{1,2})?)", 1))


def extract_mrp(text: Column, lines: Column) -> Column:
    inline = plain_number(first_match(text, ci(GATED_MRP)))
    return F.coalesce(inline, F.when(text.rlike(ci(fv.P_MRP_KEYWORD)), _split_price(lines)),
                      F.when(text.contains("₹"), rupee_price(text)))


def tax_phrase(text: Column) -> Column:
    return text.rlike(ci(fv.P_TAXES))


# --- quantity ------------------------------------------------------------------------------------
_QTY_TYPE = "array<struct<score:int,value:double,unit:string>>"


def quantity_candidates(text: Column) -> Column:
    """All accepted quantity candidates in the order they are found: anchored ones, then plain ones.

    Plain candidates look 80 characters back and 40 ahead: nutrition words reject them, an e-mark lifts
    them, and where the text has a nutrition table they need the e-mark. One fold carries the position.
    """
    def candidate(score: Column, value: Column, unit: Column) -> Column:
        return F.struct(score.cast("int").alias("score"), value.alias("value"), unit.alias("unit"))

    anchored_re = ci(GATED_QTY_ANCHORED)
    anchored = F.transform(
        F.arrays_zip(all_matches(text, anchored_re, 1).alias("v"), all_matches(text, anchored_re, 2).alias("u")),
        lambda m: candidate(F.lit(3), quantity_number(m["v"]), quantity_unit(m["u"])))
    plain_re = ci(fv.P_QTY_PLAIN)
    table = text.rlike(ci(GATED_NUTRITION_TABLE))
    pieces = F.zip_with(F.split(text, plain_re, -1), all_matches(text, plain_re),
                        lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(_QTY_TYPE).alias("found"))

    def step(acc: Column, piece: Column) -> Column:
        begin = acc["pos"] + F.length(piece["gap"])
        low = F.greatest(begin - 80, F.lit(0))
        size = F.coalesce(F.length(piece["m"]), F.lit(0))

        def judged(window: Column) -> Column:
            marked = window.rlike(ci(r"\be\b"))
            value = quantity_number(F.regexp_extract(piece["m"], r"^([\d.,]+)", 1))
            unit = quantity_unit(F.regexp_replace(piece["m"], r"^[\d.,]+", ""))
            ok = ~window.rlike(ci(GATED_NUTRITION)) & (~table | marked)
            return F.when(ok, candidate(F.when(marked, F.lit(2)).otherwise(F.lit(0)), value, unit))

        one = F.when(piece["m"].isNotNull(), let(F.substring(text, low + 1, begin + size + 40 - low), judged))
        return F.struct((begin + size).alias("pos"),
                        F.concat(acc["found"], F.array_compact(F.array(one))).cast(_QTY_TYPE).alias("found"))

    plain = F.aggregate(pieces, start, step, lambda acc: acc["found"])
    return F.filter(F.concat(anchored.cast(_QTY_TYPE), plain), lambda c: c["value"].isNotNull())


def best_quantity(candidates: Column) -> Column:
    """Highest score, first seen."""
    def pick(found: Column) -> Column:
        top = F.array_max(F.transform(found, lambda c: c["score"]))
        return F.get(F.filter(found, lambda c: c["score"] == top), 0)

    return let(candidates, pick)


# --- dates ---------------------------------------------------------------------------------------
def paired_expiry(text: Column, lines: Column, mfg: Column) -> Column:
    """Later date on the line the expiry anchor sits on."""
    before = F.substring(text, F.lit(1), F.regexp_instr(text, F.lit(ci(GATED_EXP))) - 1)
    line = F.get(lines, F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))))
    return F.get(F.filter(parse_label_dates(all_matches(line, cs(fv.P_PAIRED_DATE))), lambda x: x > mfg), 0)


def bare_dates(lines: Column) -> Column:
    """Four-digit-year dates in reading order, nutrition lines left out."""
    plain = F.filter(lines, lambda s: s.rlike(cs(r"\d")) & s.rlike(cs(fv.P_BARE_DATE)) & ~s.rlike(ci(GATED_NUTRITION)))
    return F.array_compact(parse_label_dates(F.flatten(F.transform(plain, lambda s: all_matches(s, cs(fv.P_BARE_DATE), 1)))))


def make_word_candidates(lines: Column) -> Column:
    """Words close to a manufacture word on lines that also carry a month and year."""
    dated = F.filter(lines, lambda s: s.rlike(cs(fv.P_MONTH_DATE)))
    words = F.flatten(F.transform(dated, lambda s: all_matches(s, "[A-Za-z]{4,}")))
    return near_words(words, fv.MAKE_WORDS, 0.85)


def closest_make_words(candidates: Column) -> Column:
    return _closest(fv.MAKE_WORDS, 0.85)(candidates)


def fuzzy_mfg(lines: Column, candidates: Column, hits: Column) -> Column:
    """Date on the first line with a manufacture-like word and a readable month and year."""
    close = F.transform(F.filter(F.arrays_zip(candidates.alias("w"), hits.alias("h")), lambda p: p["h"].isNotNull()), lambda p: p["w"])
    close = F.coalesce(close, none_of_text())

    def dated(line: Column) -> Column:
        words = all_matches(line, "[A-Za-z]{4,}")
        known = F.exists(words, lambda w: F.initcap(w).isin(*fv.MAKE_WORDS)) | F.arrays_overlap(words, close)
        return F.when(line.rlike(cs(fv.P_MONTH_DATE)) & known, parse_label_date(first_match(line, cs(fv.P_MONTH_DATE))))

    return first_of(F.transform(lines, dated))


# --- care, origin --------------------------------------------------------------------------------
def extract_care(text: Column) -> Column:
    hit = F.coalesce(first_match(text, ci(GATED_CARE), 0), first_match(text, ci(fv.P_BARE_CONTACT), 0))
    return F.substring(strip(hit), 1, 300)


def extract_origin(text: Column) -> Column:
    raw = strip(first_match(text, ci(fv.P_ORIGIN)))
    return F.when(raw.rlike(ci(fv.P_INDIA_TYPO)), "India").otherwise(raw)


def imported(origin: Column) -> Column:
    return F.coalesce(F.lower(origin) != "india", F.lit(False))


# --- product name --------------------------------------------------------------------------------
_DECLARED = ci(gated("|".join(f"(?:{p})" for p in (
    fv.P_MRP, fv.P_QTY_ANCHORED, fv.P_MFG, fv.P_EXP, fv.P_CARE, fv.P_ORIGIN, fv.P_TAXES, fv.P_MAKER_ANCHOR, fv.P_MODEL_LINE)), "mrndpebuchti"))


def is_measurement(line: Column) -> Column:
    words = F.regexp_replace(line, ci(fv.P_UNIT_WORD), "")
    return letters(F.regexp_replace(words, cs(fv.P_MEASURE_JUNK), "")) <= 2


def extract_generic(lines: Column) -> Column:
    """Labelled name, else contents, else the first substantial line that declares nothing.

    ``lines`` are trimmed and not blank.
    """
    def labelled(line: Column) -> Column:
        named = F.nullif(strip(first_match(line, ci(fv.P_GENERIC_LABEL))), F.lit(""))

        def usable(inside: Column) -> Column:
            bad = inside.rlike(_DECLARED) | is_measurement(inside) | inside.rlike(ci(fv.P_LONE_LABEL))
            return F.when((inside != "") & ~bad, inside)

        return F.coalesce(named, let(strip(first_match(line, ci(fv.P_CONTENTS_LABEL))), usable))

    name = first_of(F.transform(F.filter(lines, lambda s: s.rlike(r"(?i)name|contents")), labelled))

    def substantial(line: Column) -> Column:
        return (
            line.rlike("[A-Za-z]{3,}") & (F.length(line) <= 160) & ~line.rlike(ci(GATED_GENERIC_SKIP))
            & ~line.rlike(ci(fv.P_LONE_LABEL)) & ~line.rlike(_DECLARED) & ~is_measurement(line))

    def wordy(line: Column) -> Column:
        return letters(F.substring(line, 1, 120)) >= 8

    best_line = F.coalesce(first_where(lines, "string", lambda s: wordy(s) & substantial(s)), first_where(lines, "string", lambda s: ~wordy(s) & substantial(s)))
    chosen = F.substring(F.coalesce(name, best_line), 1, 120)
    return let(chosen, lambda c: F.when(F.length(c) > 2, c))


# --- maker ---------------------------------------------------------------------------------------
def extract_maker(lines: Column) -> Column:
    """Struct (name, address): the block led by a maker anchor, else lines with address words."""
    anchor, stop = ci(GATED_MAKER_ANCHOR), ci(GATED_MAKER_STOP)

    def until_stop(rest: Column) -> Column:
        cut = F.array_position(F.transform(rest, lambda s: s.rlike(stop)), True).cast("int")
        return let(cut, lambda c: F.when(c > 0, F.slice(rest, F.lit(1), c - 1)).otherwise(rest))

    def named(block: Column) -> Column:
        address = F.array_join(F.transform(
            let(let(F.slice(block, 2, 8), until_stop), lambda kept: drop_repeats(F.slice(kept, 1, 3))),
            lambda s: strip(F.rtrim(s, F.lit(" ,;:-")))), "; ")
        return F.when(F.size(block) > 0, F.struct(
            F.substring(F.get(block, 0), 1, 160).alias("name"),
            F.nullif(F.substring(address, 1, 300), F.lit("")).alias("address")))

    def block_of(line: Column, i: Column) -> Column:
        def around(halves: Column) -> Column:
            def blocks(tail: Column) -> Column:
                company = let(strip(halves[0], " ,:-\t"), lambda lead: F.when((F.length(lead) > 3) & ~lead.rlike(stop), lead))
                starts_with_name = (tail != "") & ~tail.rlike(ci(fv.P_ADDRESS_START))
                head = F.when(starts_with_name, F.array(tail)).otherwise(F.array(company, F.nullif(tail, F.lit(""))))
                return F.concat(F.array_compact(head), F.slice(lines, i + 2, 4))

            block = let(strip(halves[1], " :-\t"), blocks)
            return F.when(~halves[0].rlike(ci(fv.P_AS_PER)), let(block, named))

        return F.when(line.rlike(anchor), let(F.split(line, anchor, 2), around))

    anchored = F.when(F.exists(lines, lambda s: s.rlike(anchor)), first_of(F.transform(lines, block_of)))
    def first_two(addressed: Column) -> Column:
        return F.when(F.size(addressed) > 0, F.struct(
            F.substring(F.get(addressed, 0), 1, 160).alias("name"),
            F.substring(F.array_join(let(F.slice(addressed, 1, 2), drop_repeats), "; "), 1, 300).alias("address")))

    return F.coalesce(anchored, let(F.filter(lines, lambda s: s.rlike(ci(fv.P_ADDRESS_WORD))), first_two))


def repair_spacing(text: Column) -> Column:
    """Spaces a generative reader dropped: lower-to-upper and punctuation-to-letter joints."""
    joints = F.regexp_replace(F.replace(text, F.lit("\r"), F.lit("\n")), r"(?<=[a-z])(?=[A-Z])", " ")
    joints = F.regexp_replace(joints, r"([.!?;:])(?=[A-Za-z])", "$1 ")
    return F.btrim(F.regexp_replace(joints, r"(?U)\s+", " "))
