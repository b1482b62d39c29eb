"""Text rows to declaration rows.

One narrow chain of steps: the normalised text and its lines become columns first, so each later field
reads them once. Nothing is shuffled; the two spelling look-ups send only a few rare words per
row to a pandas UDF and null for ordinary rows. With a list of known names the chain's result is written once, and distinct
makers and lines are matched against the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlens import fixed_values as fv
from packlens.functions import fields as ff
from packlens.functions.dates import parse_label_date
from packlens.functions.text import ci, first_match, lines_of, stage, strip
from packlens.operators.gazetteer import known_makers
from packlens.session import settle


def normalize_text(df: DataFrame, column: str = "ocr_text") -> DataFrame:
    """Add ``text``: month, unit, price and date repairs, in that order."""
    raw = F.coalesce(F.col(column), F.lit(""))
    df = stage(df, __cand=ff.month_candidates(raw)).withColumn("__months", ff.closest_months(F.col("__cand")))
    df = stage(df, text=ff.fix_month_tokens(raw, F.col("__cand"), F.col("__months"))).drop("__cand", "__months")
    for repair in (ff.fix_qty_units, ff.fix_mrp_digits, ff.fix_date_tokens):
        df = stage(df, text=repair(F.col("text")))
    return df


def with_lines(df: DataFrame) -> DataFrame:
    df = stage(df, lines=lines_of(F.col("text")))
    return stage(df, said=F.filter(F.transform("lines", lambda s: strip(s)), lambda s: s != ""))


def with_dates(df: DataFrame) -> DataFrame:
    """Add ``mfg_date`` and ``expiry_date`` to rows with ``text`` and ``lines``."""
    text, lines = F.col("text"), F.col("lines")
    mfg, exp = F.col("__m"), F.col("__e")
    df = stage(df, __m=parse_label_date(first_match(text, ci(ff.GATED_MFG))), __e=parse_label_date(first_match(text, ci(ff.GATED_EXP))))
    df = stage(df, __e=F.when(exp <= mfg, F.coalesce(ff.paired_expiry(text, lines, mfg), exp)).otherwise(exp))
    df = stage(df, __bare=F.when(mfg.isNull() | exp.isNull(), ff.bare_dates(lines)))
    df = stage(df, mfg_date=F.coalesce(mfg, F.get("__bare", 0)), expiry_date=F.coalesce(exp, F.get("__bare", 1)))
    df = stage(df, __cand=F.when(F.col("mfg_date").isNull(), ff.make_word_candidates(lines)))
    df = df.withColumn("__hits", ff.closest_make_words(F.col("__cand")))
    late = F.when(F.col("mfg_date").isNull(), ff.fuzzy_mfg(lines, F.col("__cand"), F.col("__hits")))
    return stage(df, mfg_date=F.coalesce("mfg_date", late)).drop("__m", "__e", "__bare", "__cand", "__hits")


def confidence_sources(sources: Column, confidence: Column) -> Column:
    """On a weak read, plain reads become uncertain."""
    weak = F.coalesce(confidence < fv.LOW_CONFIDENCE, F.lit(False))
    return F.when(weak, F.transform_values(sources, lambda _, v: F.when(v == "read", "uncertain").otherwise(v))).otherwise(sources)


def read_sources() -> Column:
    """Provenance of extracted fields: everything a pattern found counts as read."""
    marks = [F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("key"), F.lit("read").alias("value"))) for f in fv.TRACKED_FIELDS]
    marks += [F.when(F.col(f), F.struct(F.lit(f).alias("key"), F.lit("read").alias("value")))
              for f in ("mrp_includes_taxes", "is_imported")]
    return F.map_from_entries(F.array_compact(F.array(*marks)))


def extract_declarations(label_text: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``label_text(scan_id, ocr_text, ocr_confidence)`` to one declaration row per scan.

    ``names`` (name, position): known makers, which repair the one that was read or fill a missing one from the lines (source ``inferred``).
    """
    keep = [c for c in label_text.columns if c != "text"]
    df = with_dates(with_lines(normalize_text(label_text)))
    text, lines, said = F.col("text"), F.col("lines"), F.col("said")
    df = stage(df, __qty=ff.best_quantity(ff.quantity_candidates(text)), __maker=ff.extract_maker(said),
               country_of_origin=ff.extract_origin(text))
    unit = F.col("__qty.unit")
    df = stage(
        df, manufacturer_name=F.col("__maker.name"), manufacturer_address=F.col("__maker.address"),
        generic_name=ff.extract_generic(said), net_quantity_value=F.col("__qty.value"),
        net_quantity_unit=F.when(unit == "litre", "l").otherwise(unit), mrp=ff.extract_mrp(text, lines),
        mrp_includes_taxes=ff.tax_phrase(text), consumer_care=ff.extract_care(text),
        is_imported=ff.imported(F.col("country_of_origin")))
    blank = {c: F.lit(None).cast("double") for c in (
        "min_numeral_height_mm", "min_letter_height_mm", "min_font_height_mm", "panel_area_cm2", "min_width_to_height_ratio")}
    df = df.withColumns({**blank, "is_embossed": F.lit(False), "field_sources": read_sources()})
    if names is not None:
        df = known_makers(settle(df, "extracted"), names)
    return df.select(
        *keep, "manufacturer_name", "manufacturer_address", "generic_name", "net_quantity_value", "net_quantity_unit", "mrp",
        "mrp_includes_taxes", "mfg_date", "expiry_date", "consumer_care", "country_of_origin", "is_imported",
        "is_embossed", *blank, confidence_sources(F.col("field_sources"), F.col("ocr_confidence")).alias("field_sources"))
