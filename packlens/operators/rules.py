"""The ten label rules as column expressions.

Each rule is an ordered list of cases (SQL condition, outcome); a rule becomes one CASE that yields a
struct. A declaration row becomes ten findings in a single narrow projection, and the verdict
is folded from the status columns of the same row, so neither needs a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlens import fixed_values as fv
from packlens.functions.text import float_text, short_number, two_decimals

FINDING_FIELDS = (
    "rule_order", "rule_id", "status", "message", "field", "citation", "citation_verified",
    "observed", "expected", "severity", "remedy", "source_ref",
)


@dataclass(frozen=True)
class Case:
    """One outcome. Texts are templates: ``{name}`` stands for a text column of ``with_tiers``."""

    when: str | None
    status: str
    message: str
    observed: str
    expected: str
    citation: str | None = None
    verified: bool | None = None


@dataclass(frozen=True)
class Rule:
    rule_id: str
    field: str
    citation: str
    verified: bool
    cases: tuple[Case, ...]
    measured: bool = False


def sql_text(value: str | None) -> str:
    if value is None:
        return "CAST(NULL AS STRING)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_template(template: str) -> str:
    """``concat`` over the literal parts and the named text columns of a template."""
    parts = [p for p in re.split(r"(\{\w+\})", template) if p]
    sql = [p[1:-1] if p.startswith("{") else sql_text(p) for p in parts]
    return sql[0] if len(sql) == 1 else f"concat({', '.join(sql)})"


def sql_set(items) -> str:
    return "(" + ", ".join(sql_text(i) for i in items) + ")"


def present(value: Column) -> Column:
    return value.isNotNull() & (value != "")


def base_quantity(value: Column, unit: Column) -> Column:
    """Quantity in grams or millilitres; null for other units."""
    u = F.lower(unit)
    return (
        F.when(u.isin("kg", "l"), value * 1000)
        .when(u == "mg", value / 1000)
        .when(u.isin("g", "ml"), value)
    )


def _tier(value: Column, embossed: Column, tiers) -> Column:
    chain = None
    for limit, normal, raised in tiers:
        mm = F.when(embossed, F.lit(raised)).otherwise(F.lit(normal))
        cond = value <= limit
        chain = F.when(cond, mm) if chain is None else chain.when(cond, mm)
    return chain


def required_numeral_mm(value: Column, unit: Column, panel: Column, embossed: Column) -> Column:
    """Smallest legal numeral height for a row, null where no tier can be chosen."""
    u = F.lower(unit)
    by_quantity = u.isin(*fv.WEIGHT_VOLUME_UNITS) & value.isNotNull()
    by_panel = u.isin(*fv.COUNT_LENGTH_UNITS) & (panel > 0)
    return F.when(by_quantity, _tier(base_quantity(value, unit), embossed, fv.QUANTITY_TIERS)).when(
        by_panel, _tier(panel, embossed, fv.PANEL_TIERS))


def print_tag(embossed: Column) -> Column:
    return F.when(embossed, "embossed pack").otherwise("ordinary print")


def tier_basis(value: Column, unit: Column, panel: Column, embossed: Column) -> Column:
    u = F.lower(unit)
    tag = print_tag(embossed)
    by_quantity = F.concat(F.lit("Table-I (net "), short_number(base_quantity(value, unit)),
                           F.lit("g/ml, "), tag, F.lit(")"))
    by_panel = F.concat(F.lit("Table-II (panel "), short_number(panel), F.lit("cm², "), tag, F.lit(")"))
    return (
        F.when(u.isin(*fv.WEIGHT_VOLUME_UNITS) & value.isNotNull(), by_quantity)
        .when(u.isin(*fv.COUNT_LENGTH_UNITS) & (panel > 0), by_panel)
        .when(u.isin(*fv.COUNT_LENGTH_UNITS), "Table-II needs principal display panel area")
        .otherwise("unknown unit class")
    )


_UNITS = sql_set(fv.WEIGHT_VOLUME_UNITS + fv.COUNT_LENGTH_UNITS)
_ABSENT = "absent"
_MAKER = "manufacturer name + address"
_GENERIC = "generic/common name"
_STANDARD = "net quantity in standard units"
_WITH_TAX = "MRP inclusive of all taxes"
_MONTH_YEAR = "month and year of manufacture/pack/import"
_CONTACT = "customer-care contact"
_UNSEEN = "unmeasured"

RULES = (
    Rule(fv.R_MAKER, "manufacturer", "Rule 6(1)(a)", True, (
        Case("manufacturer_name <> '' AND manufacturer_address <> ''", fv.PASS,
             "Manufacturer name+address present", "{manufacturer_name}; {manufacturer_address}", _MAKER),
        Case(None, fv.NOT_FOUND, "Missing manufacturer name/address (Rule 6(1)(a))", _ABSENT, _MAKER),
    )),
    Rule(fv.R_GENERIC, "generic_name", "Rule 6(1)(b)", True, (
        Case("generic_name <> ''", fv.PASS, "Generic name present", "{generic_name}", _GENERIC),
        Case(None, fv.NOT_FOUND, "Missing generic/common name (Rule 6(1)(b))", _ABSENT, _GENERIC),
    )),
    Rule(fv.R_NETQTY, "net_quantity", "Rule 6(1)(c)", True, (
        Case("NOT coalesce(net_quantity_value > 0 AND net_quantity_unit <> '', false)", fv.NOT_FOUND,
             "Missing/invalid net quantity (Rule 6(1)(c))", _ABSENT, _STANDARD),
        Case(f"lower(net_quantity_unit) IN {_UNITS}", fv.PASS, "Net quantity present",
             "{t_quantity} {net_quantity_unit}", _STANDARD),
        Case(None, fv.FAIL, "Non-standard unit '{net_quantity_unit}' (Rule 6, SI units required)",
             "{net_quantity_unit}", "g/kg/mg/ml/l/cm/m/nos/pc"),
    )),
    Rule(fv.R_MRP, "mrp", "Rule 6(1)(e)", True, (
        Case("NOT coalesce(mrp > 0, false)", fv.NOT_FOUND, "Missing/invalid MRP (Rule 6(1)(e))", _ABSENT, _WITH_TAX),
        Case("mrp_includes_taxes", fv.PASS, "MRP with taxes present", "Rs. {t_mrp} (inclusive of all taxes)", _WITH_TAX,
             citation="Rule 6(1)(e) + Rule 2(m)"),
        Case(None, fv.FAIL, "MRP must state 'inclusive of all taxes' (Rule 6(1)(e) + Rule 2(m) manner)",
             "tax phrase absent", "'inclusive of all taxes'"),
    )),
    Rule(fv.R_DATES, "dates", "Rule 6(1)(d)", True, (
        Case("mfg_date IS NULL", fv.NOT_FOUND, "Missing manufacture/pack date (Rule 6(1)(d))", _ABSENT, _MONTH_YEAR),
        Case("expiry_date <= mfg_date", fv.FAIL, "Expiry date must be after manufacture date", "{t_expiry}", "after {t_mfg}"),
        Case("expiry_date IS NOT NULL", fv.PASS, "Date declarations valid", "mfg/pack {t_mfg}, expiry {t_expiry}", _MONTH_YEAR),
        Case(None, fv.PASS, "Date declarations valid", "mfg/pack {t_mfg}, no expiry stated", _MONTH_YEAR),
    )),
    Rule(fv.R_CARE, "consumer_care", "Rule 6(1) consumer-care proviso (post-2011 amendment)", False, (
        Case("consumer_care <> ''", fv.PASS, "Consumer care details present", "{consumer_care}", _CONTACT),
        Case(None, fv.NOT_FOUND, "Missing customer-care name/address/contact", _ABSENT, _CONTACT),
    )),
    Rule(fv.R_ORIGIN, "country_of_origin", "Rule 6(1)(a) importer clause", True, (
        Case("country_of_origin <> ''", fv.PASS, "Origin declaration valid", "{country_of_origin}",
             "country of origin if imported"),
        Case("is_imported", fv.NOT_FOUND, "Imported package must declare country of origin", _ABSENT, "country of origin",
             citation="Rule 6(1)(a) importer clause (country wording: later amendment)", verified=False),
        Case(None, fv.PASS, "Origin declaration valid", "domestic supply (no import claimed)",
             "country of origin if imported"),
    )),
    Rule(fv.R_NUMERAL, "numeral", "Rule 7(2) Table-I/II", True, (
        Case("numeral_mm IS NULL", fv.NOT_ASSESSABLE, "Numeral height not measured; {t_need} ({tier_basis}) — cannot assess",
             _UNSEEN, "{t_need} ({tier_basis})"),
        Case("required_mm IS NULL", fv.NOT_ASSESSABLE, "Cannot determine Table tier ({tier_basis}) — cannot assess",
             "unknown tier", "determinable tier"),
        Case("numeral_mm >= required_mm", fv.PASS, "Numeral height {t_numeral}mm >= {t_required}mm ({tier_basis})",
             "{t_numeral}mm", ">= {t_required}mm ({tier_basis})"),
        Case(None, fv.FAIL, "Numeral height {t_numeral}mm < required {t_required}mm ({tier_basis})",
             "{t_numeral}mm", ">= {t_required}mm ({tier_basis})"),
    ), measured=True),
    Rule(fv.R_LETTER, "letter", "Rule 7(3)", True, (
        Case("min_letter_height_mm IS NULL", fv.NOT_ASSESSABLE,
             "Letter height not measured; required >= {t_letter_need}mm — cannot assess", _UNSEEN, ">= {t_letter_need}mm"),
        Case("min_letter_height_mm >= letter_need_mm", fv.PASS, "Letter height {t_letter}mm >= {t_letter_need}mm ({print_tag})",
             "{t_letter}mm", ">= {t_letter_need}mm ({print_tag})"),
        Case(None, fv.FAIL, "Letter height {t_letter}mm < required {t_letter_need}mm (Rule 7(3), {print_tag})",
             "{t_letter}mm", ">= {t_letter_need}mm ({print_tag})"),
    ), measured=True),
    Rule(fv.R_WIDTH, "width", "Rule 7(3) proviso", True, (
        Case("min_width_to_height_ratio IS NULL", fv.NOT_ASSESSABLE,
             "Glyph width not measured; required width >= 1/3 height — cannot assess", _UNSEEN, "width/height >= 1/3"),
        Case("min_width_to_height_ratio >= 1.0D / 3.0D", fv.PASS, "Width/height ratio {t_ratio} >= 1/3", "{t_ratio}", ">= 0.33"),
        Case(None, fv.FAIL, "Width/height ratio {t_ratio} < 1/3 (excludes numeral '1' and letters i/I/l)",
             "{t_ratio}", ">= 0.33"),
    ), measured=True),
)


def _severity(rule: Rule, status: str) -> str:
    if status == fv.PASS:
        return "info"
    if rule.measured and status == fv.NOT_ASSESSABLE:
        return "review"
    return "blocking"


def _case_sql(rule: Rule, pick) -> str:
    arms = [f"WHEN {c.when} THEN {pick(c)}" for c in rule.cases if c.when]
    (last,) = [c for c in rule.cases if not c.when]
    return f"CASE {' '.join(arms)} ELSE {pick(last)} END"


def status_of(rule: Rule) -> Column:
    return F.expr(_case_sql(rule, lambda c: sql_text(c.status)))


def finding_sql(order: int, rule: Rule, source_ref: str) -> str:
    def outcome(case: Case) -> str:
        observed = sql_template(case.observed)
        if not rule.measured and "{" in case.observed:
            observed = f"if(length({observed}) > 160, concat(substring({observed}, 1, 157), '...'), {observed})"
        remedy = fv.CALIBRATION_REMEDY if case.status == fv.NOT_ASSESSABLE else None
        verified = rule.verified if case.verified is None else case.verified
        values = (
            str(order), sql_text(rule.rule_id), sql_text(case.status), sql_template(case.message), sql_text(rule.field),
            sql_text(case.citation or rule.citation), str(verified).lower(), observed, sql_template(case.expected),
            sql_text(_severity(rule, case.status)), sql_text(remedy), sql_text(source_ref if rule.measured else ""),
        )
        return "named_struct(" + ", ".join(f"'{n}', {v}" for n, v in zip(FINDING_FIELDS, values, strict=True)) + ")"

    return _case_sql(rule, outcome)


def with_tiers(decl: DataFrame) -> DataFrame:
    """Derived columns the rules read: tier, required sizes and number texts (pruned where unused)."""
    raised = F.coalesce(F.col("is_embossed"), F.lit(False))
    args = (F.col("net_quantity_value"), F.col("net_quantity_unit"), F.col("panel_area_cm2"), raised)
    if "min_font_height_mm" not in decl.columns:
        decl = decl.withColumn("min_font_height_mm", F.lit(None).cast("double"))
    sized = decl.withColumns({
        "required_mm": required_numeral_mm(*args),
        "tier_basis": tier_basis(*args),
        "numeral_mm": F.coalesce("min_numeral_height_mm", "min_font_height_mm"),
        "letter_need_mm": F.when(raised, F.lit(fv.LETTER_MM_EMBOSSED)).otherwise(F.lit(fv.LETTER_MM)),
        "print_tag": print_tag(raised),
    })
    return sized.withColumns({
        "t_quantity": short_number(F.col("net_quantity_value")),
        "t_mrp": float_text(F.col("mrp")),
        "t_mfg": F.col("mfg_date").cast("string"),
        "t_expiry": F.col("expiry_date").cast("string"),
        "t_numeral": float_text(F.col("numeral_mm")),
        "t_required": F.col("required_mm").cast("string"),
        "t_need": F.expr("coalesce(concat('required >= ', CAST(required_mm AS STRING), 'mm'), 'requirement undetermined')"),
        "t_letter": float_text(F.col("min_letter_height_mm")),
        "t_letter_need": F.col("letter_need_mm").cast("string"),
        "t_ratio": two_decimals(F.col("min_width_to_height_ratio")),
    })


def findings(decl: DataFrame, *, rules: tuple[str, ...] = fv.RULE_IDS,
             source_ref: str = fv.RULE7_SOURCE) -> DataFrame:
    """One row per scan and rule, with the scan's confidence carried along."""
    structs = [finding_sql(i, r, source_ref) for i, r in enumerate(RULES) if r.rule_id in rules]
    exploded = with_tiers(decl).select("scan_id", "ocr_confidence", F.expr(f"explode(array({', '.join(structs)})) AS f"))
    return exploded.select("scan_id", "ocr_confidence", "f.*")


def with_results(decl: DataFrame, *, source_ref: str = fv.RULE7_SOURCE) -> DataFrame:
    """Declarations with their findings nested as ``results``, in rule order."""
    structs = [finding_sql(i, r, source_ref) for i, r in enumerate(RULES)]
    return with_tiers(decl).select(*decl.columns, F.expr(f"array({', '.join(structs)})").alias("results"))


def statuses(decl: DataFrame, *keep: str) -> DataFrame:
    """Declaration rows reduced to one status column per rule (``s0`` … ``s9``)."""
    cols = [status_of(r).alias(f"s{i}") for i, r in enumerate(RULES)]
    return with_tiers(decl).select("scan_id", "ocr_confidence", *keep, *cols)


def weak_read(conf: Column) -> Column:
    return F.coalesce(conf < fv.LOW_CONFIDENCE, F.lit(False))


def row_verdict(conf: Column) -> Column:
    """Verdict of a row that carries the status columns of ``statuses``."""
    every = "(" + ", ".join(f"s{i}" for i in range(len(RULES))) + ")"
    failed, missing, open_ = (F.expr(f"'{s}' IN {every}") for s in (fv.FAIL, fv.NOT_FOUND, fv.NOT_ASSESSABLE))
    return (
        F.when(failed | (missing & ~weak_read(conf)), fv.NON_COMPLIANT)
        .when(missing | open_, fv.INCOMPLETE)
        .otherwise(fv.COMPLIANT)
    )


def warnings_of(conf: Column, missed_ids: Column) -> Column:
    """Warning texts from the confidence and the ids missed on a weak read (in rule order)."""
    low = F.when(weak_read(conf), F.concat(
        F.lit("Low OCR confidence ("), float_text(conf), F.lit("%) — label may be illegible; "
        "verify declarations on the physical package (legibility warning)")))
    missed = F.when(weak_read(conf) & (F.size(missed_ids) > 0), F.concat(
        F.size(missed_ids).cast("string"), F.lit(" declaration(s) not detected on a weak read ("),
        short_number(conf), F.lit("% < "), short_number(F.lit(fv.LOW_CONFIDENCE)), F.lit("%): "),
        F.array_join(missed_ids, ", "),
        F.lit(" — marked incomplete, NOT non-compliant. Retake close-ups and verify on the package.")))
    return F.filter(F.array(low, missed), lambda w: w.isNotNull())


def verdicts(decl: DataFrame, *keep: str) -> DataFrame:
    """Verdict and warnings per scan, folded inside the row."""
    conf = F.col("ocr_confidence")
    ids = ", ".join(f"if(s{i} = '{fv.NOT_FOUND}', '{r}', NULL)" for i, r in enumerate(fv.RULE_IDS))
    missed = F.expr(f"array_compact(array({ids}))")
    df = statuses(decl, *keep)
    return df.select("scan_id", "ocr_confidence", *keep, row_verdict(conf).alias("verdict"),
                     warnings_of(conf, missed).alias("warnings")).withColumn(
        "compliant", F.col("verdict") == fv.COMPLIANT)


def numeral_tier_join(decl: DataFrame) -> DataFrame:
    """The same tiers as a range join against a constant table of seven rows."""
    spark = decl.sparkSession
    rows = []
    for kind, tiers in (("quantity", fv.QUANTITY_TIERS), ("panel", fv.PANEL_TIERS)):
        low = float("-inf")
        for limit, normal, raised in tiers:
            rows.append(F.struct(F.lit(kind).alias("kind"), F.lit(low).alias("lo"), F.lit(limit).alias("hi"),
                                 F.lit(normal).alias("normal_mm"), F.lit(raised).alias("embossed_mm")))
            low = limit
    table = spark.range(1).select(F.inline(F.array(*rows)))
    u = F.lower("net_quantity_unit")
    keyed = decl.select(
        "scan_id", F.coalesce("is_embossed", F.lit(False)).alias("is_embossed"),
        F.when(u.isin(*fv.WEIGHT_VOLUME_UNITS) & F.col("net_quantity_value").isNotNull(), "quantity")
        .when(u.isin(*fv.COUNT_LENGTH_UNITS) & (F.col("panel_area_cm2") > 0), "panel").alias("kind"),
        base_quantity(F.col("net_quantity_value"), F.col("net_quantity_unit")).alias("base"),
        F.col("panel_area_cm2").alias("panel"),
    ).withColumn("measure", F.when(F.col("kind") == "quantity", F.col("base")).otherwise(F.col("panel")))
    hit = (keyed["kind"] == table["kind"]) & (keyed["measure"] > table["lo"]) & (keyed["measure"] <= table["hi"])
    return keyed.join(F.broadcast(table), hit, "left").select(
        "scan_id", F.when(F.col("is_embossed"), F.col("embossed_mm")).otherwise(F.col("normal_mm"))
        .alias("required_mm"))


def verdict_fold(findings_df: DataFrame) -> DataFrame:
    """Verdict per scan from annotated findings; weak-read misses only make it incomplete."""
    blocking = F.col("status").isin(fv.FAIL, fv.NOT_FOUND)
    missed = F.col("cause") == "possible_miss"
    return findings_df.groupBy("scan_id").agg(
        F.bool_or(blocking & ~missed).alias("bad"),
        F.bool_or((blocking & missed) | (F.col("status") == fv.NOT_ASSESSABLE)).alias("open"),
    ).select("scan_id", F.when(F.col("bad"), fv.NON_COMPLIANT).when(F.col("open"), fv.INCOMPLETE)
             .otherwise(fv.COMPLIANT).alias("verdict"))


def refold(statuses_: Column) -> Column:
    """Verdict of an array of statuses alone."""
    return (
        F.when(F.exists(statuses_, lambda s: s.isin(fv.FAIL, fv.NOT_FOUND)), fv.NON_COMPLIANT)
        .when(F.array_contains(statuses_, fv.NOT_ASSESSABLE), fv.INCOMPLETE)
        .otherwise(fv.COMPLIANT)
    )


def verdict_refold(findings_df: DataFrame) -> DataFrame:
    """Verdict per scan from statuses alone (used after officer overlays)."""
    return findings_df.groupBy("scan_id").agg(
        F.bool_or(F.col("status").isin(fv.FAIL, fv.NOT_FOUND)).alias("bad"),
        F.bool_or(F.col("status") == fv.NOT_ASSESSABLE).alias("open"),
    ).select("scan_id", F.when(F.col("bad"), fv.NON_COMPLIANT).when(F.col("open"), fv.INCOMPLETE)
             .otherwise(fv.COMPLIANT).alias("verdict"))


def report_warnings(findings_df: DataFrame) -> DataFrame:
    """Warnings per scan from annotated findings. ``collect_set`` over rule ids holds at most ten."""
    missed = (F.col("cause") == "possible_miss") & F.col("rule_id").isin(*fv.RULE_IDS)
    order = F.array(*[F.lit(r) for r in fv.RULE_IDS])
    return findings_df.groupBy("scan_id").agg(
        F.max("ocr_confidence").alias("ocr_confidence"),
        F.collect_set(F.when(missed, F.col("rule_id"))).alias("ids"),
    ).select("scan_id", warnings_of(
        F.col("ocr_confidence"), F.filter(order, lambda r: F.array_contains(F.col("ids"), r))).alias("warnings"))
