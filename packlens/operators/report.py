"""Report content: labels, case header and enforcement lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlens import fixed_values as fv
from packlens.functions.text import first_match, short_number, strip


def printable(value: Column) -> Column:
    text = strip(F.coalesce(value, F.lit("")))
    return F.translate(F.replace(F.replace(F.replace(text, F.lit("₹"), F.lit("Rs. ")), F.lit("≥"), F.lit(">=")),
                                 F.lit("≤"), F.lit("<=")), "×", "x")


def display_observed(value: Column) -> Column:
    text = printable(value)
    return (
        F.when((text == "") | (F.lower(text) == "absent"), "Not detected on scanned panel")
        .when(F.lower(text) == "unmeasured", "Not measured")
        .otherwise(text)
    )


def engine_label(engine: Column, confidence: Column) -> Column:
    name = printable(engine)
    label = F.lit(None).cast("string")
    for key, shown in reversed(fv.ENGINE_LABELS):
        label = F.when(F.lower(name).contains(key), shown).otherwise(label)
    label = F.coalesce(label, F.nullif(name, F.lit("")), F.lit("OCR"))
    return F.concat(label, F.lit(" — "), short_number(F.coalesce(confidence, F.lit(0.0))), F.lit("%"))


def rule_reference(rule_id: Column) -> Column:
    refs = F.create_map(*[F.lit(x) for r, (ref, _) in fv.RULE_LABELS.items() for x in (r, ref)])
    return F.coalesce(F.try_element_at(refs, rule_id), rule_id)


def rule_requirement(rule_id: Column, expected: Column) -> Column:
    """Requirement text; numeral and letter rows add table, size and print kind from ``expected``."""
    names = F.create_map(*[F.lit(x) for r, (_, req) in fv.RULE_LABELS.items() for x in (r, req)])
    exp = F.coalesce(expected, F.lit(""))
    table = F.when(exp.contains("Table-II"), "Table-II").when(exp.contains("Table-I"), "Table-I")
    size = F.coalesce(F.concat(first_match(exp, r"net ([\d.]+)g/ml"), F.lit("g")),
                      F.concat(first_match(exp, r"panel ([\d.]+)cm"), F.lit("cm² panel")))
    low = F.lower(exp)
    kind = F.when(low.contains("embossed"), "embossed").when(low.contains("ordinary print"), "ordinary print")
    bits = F.concat_ws(", ", table, size, kind)
    base = F.try_element_at(names, rule_id)
    sized = F.when(bits != "", F.concat(base, F.lit(" ("), bits, F.lit(")"))).otherwise(base)
    return (
        F.when(rule_id.isin(fv.R_NUMERAL, fv.R_LETTER), sized)
        .when(rule_id.startswith("LMPC-gtin"), "Barcode identity cross-check")
        .otherwise(F.coalesce(base, rule_id))
    )


def rule_label_join(findings: DataFrame) -> DataFrame:
    """Short reference and requirement per finding; the labels are a constant map, so no join is needed."""
    rule = F.col("rule_id")
    return findings.withColumns({"ref": rule_reference(rule), "requirement": rule_requirement(rule, F.col("expected"))})


def case_header(scans: DataFrame, effective: DataFrame) -> DataFrame:
    """Header row of the report of each scan."""
    shown = display_observed(F.col("observed"))
    netqty = effective.where(F.col("rule_id") == fv.R_NETQTY).select(
        "scan_id", F.when(~shown.startswith("Not "), shown).alias("net_quantity"))

    def or_dash(value: Column) -> Column:
        return F.coalesce(F.nullif(printable(value), F.lit("")), F.lit("—"))

    def stamp(value: Column) -> Column:
        return F.coalesce(F.date_format(value, "yyyy-MM-dd HH:mm 'UTC'"), F.lit("—"))

    place = F.when(F.col("scan_lat").isNotNull() & F.col("scan_lon").isNotNull(), F.concat(
        F.lit("Inspection location (device GPS at upload): "), F.format_string("%.5f", "scan_lat"), F.lit(", "),
        F.format_string("%.5f", "scan_lon"))).otherwise(
        "Inspection location: Not provided (GPS unavailable / desktop upload)")
    return scans.join(netqty, "scan_id", "left").select(
        "scan_id",
        or_dash(F.col("product_name")).alias("product"), or_dash(F.col("brand_name")).alias("brand"),
        or_dash(F.col("category")).alias("category"), F.coalesce("net_quantity", F.lit("—")).alias("net_quantity"),
        stamp(F.col("created_at")).alias("scanned_at"), stamp(F.col("reviewed_at")).alias("reviewed_at"),
        or_dash(F.col("reviewed_by")).alias("reviewed_by"),
        engine_label(F.col("ocr_engine"), F.col("ocr_confidence")).alias("engine"),
        place.alias("location"),
        F.when(F.col("overridden"), F.concat(F.lit("Officer override by "), F.col("reviewed_by"), F.lit(": "),
                                             F.col("review_notes"))).alias("warning"),
    )


def _guidance_lines() -> Column:
    """Reference line, reason and numbered steps of one finding."""
    numbered = F.array_join(F.transform("next_steps", lambda s, i: F.concat(
        F.lit("("), (i + 1).cast("string"), F.lit(") "), s)), "; ")
    todo = F.when(F.size("next_steps") > 0, numbered).otherwise(F.nullif(printable(F.col("remedy")), F.lit("")))
    lines = F.array(
        F.concat(rule_reference(F.col("rule_id")), F.lit(":")),
        F.when(F.col("why") != "", printable(F.col("why"))),
        F.concat(F.lit("Recommended next steps: "), todo))
    return F.filter(lines, lambda x: x.isNotNull())


def enforcement_summary(scans: DataFrame, effective: DataFrame) -> DataFrame:
    """Advisory lines per scan.

    Only non-passing rule rows are gathered, at most ten per scan, after a filter on the known rules.
    """
    bad = F.col("status").isin(fv.FAIL, fv.NOT_FOUND)
    open_ = F.col("status") == fv.NOT_ASSESSABLE
    rows = effective.where((bad | open_) & F.col("rule_id").isin(*fv.RULE_IDS)).select(
        "scan_id", F.struct((~bad).alias("later"), "rule_order", rule_reference(F.col("rule_id")).alias("ref"),
                            _guidance_lines().alias("lines")).alias("row"))
    per_scan = rows.groupBy("scan_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    all_rows = F.coalesce("rows", F.array().cast(per_scan.schema["rows"].dataType))
    failed = F.filter(all_rows, lambda r: ~r["later"])
    n = F.size(failed)
    headline = F.concat(
        F.lit("Non-compliance recorded on "), n.cast("string"), F.when(n == 1, " rule: ").otherwise(" rules: "),
        F.array_join(F.transform(failed, lambda r: r["ref"]), ", "), F.lit("."))

    def fixed(lines) -> Column:
        return F.array(*[F.lit(x) for x in lines])

    def flat(items: Column) -> Column:
        return F.flatten(F.transform(items, lambda r: r["lines"]))

    lines = (
        F.when(F.col("verdict") == fv.COMPLIANT, fixed(fv.CLEAR_LINES))
        .when(F.col("verdict") == fv.INCOMPLETE, F.concat(fixed(fv.INCOMPLETE_LINES), flat(all_rows)))
        .otherwise(F.concat(F.array(headline), flat(failed), fixed([fv.SHOW_CAUSE_LINE])))
    )
    return scans.select("scan_id", "verdict").join(per_scan, "scan_id", "left").select(
        "scan_id", "verdict", lines.alias("lines"))
