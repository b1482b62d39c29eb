"""Queries over the rules: findings per rule, guidance, verdicts and tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from packlens import fixed_values as fv
from packlens.catalog.oracle_views import quote, with_views
from packlens.catalog.registry import Registry
from packlens.functions.text import float_text
from packlens.operators import rules
from packlens.operators.guidance import annotate
from packlens.plans import evaluate as plans
from packlens.sources import star

R = Registry()

FINDING_COLS = ("scan_id", "rule_id", "status", "message", "field", "citation", "observed", "expected",
                "severity", "remedy", "source_ref")
_COLS_SQL = ", ".join(FINDING_COLS)

for _name, _rule in (
    ("rule_manufacturer", fv.R_MAKER), ("rule_generic", fv.R_GENERIC), ("rule_netqty", fv.R_NETQTY),
    ("rule_mrp", fv.R_MRP), ("rule_dates", fv.R_DATES), ("rule_care", fv.R_CARE),
    ("rule_origin", fv.R_ORIGIN), ("rule_numeral", fv.R_NUMERAL), ("rule_letter", fv.R_LETTER),
    ("rule_width", fv.R_WIDTH),
):
    def _one_rule(spark, sf_dir, rule=_rule):
        found = rules.findings(star.declarations(spark, sf_dir), rules=(rule,))
        return found.select(*FINDING_COLS, F.col("citation_verified").cast("int").alias("citation_verified"))

    R.add(_name, with_views(
        f"SELECT {_COLS_SQL}, citation_verified FROM findings WHERE rule_id = {quote(_rule)}", "findings"))(_one_rule)


@R.add("annotate_failure", with_views(
    "SELECT scan_id, rule_id, status, cause, why, steps AS next_steps FROM annotated", "annotated"))
def annotate_failure(spark, sf_dir):
    found = annotate(rules.findings(star.declarations(spark, sf_dir)))
    return found.select("scan_id", "rule_id", "status", "cause", "why", F.array_join("next_steps", " | ").alias("next_steps"))


_WARN_SQL = """
CASE WHEN weak THEN 'Low OCR confidence (' || ocr_confidence || '%) — label may be illegible; verify declarations on the physical package (legibility warning)' ELSE '' END
|| CASE WHEN weak AND len(missed) > 0 THEN ' | ' || len(missed) || ' declaration(s) not detected on a weak read (' || format('{:g}', ocr_confidence) || '% < 60%): '
   || array_to_string(missed, ', ') || ' — marked incomplete, NOT non-compliant. Retake close-ups and verify on the package.' ELSE '' END
"""
_MISSED_SQL = "list_filter([" + ", ".join(
    f"CASE WHEN s{i} = 'NOT_FOUND' THEN {quote(r)} END" for i, r in enumerate(fv.RULE_IDS)) + "], lambda r: r IS NOT NULL)"


@R.add("evaluate_compliance", with_views(
    f"SELECT scan_id, verdict, CASE WHEN verdict = 'COMPLIANT' THEN 1 ELSE 0 END AS compliant, {_WARN_SQL} AS warnings "
    f"FROM (SELECT *, {_MISSED_SQL} AS missed FROM verdicts)", "verdicts"))
def evaluate_compliance(spark, sf_dir):
    _, verdicts = plans.evaluate(star.declarations(spark, sf_dir))
    return verdicts.select("scan_id", "verdict", F.col("compliant").cast("int").alias("compliant"),
                           F.array_join("warnings", " | ").alias("warnings"))


@R.add("failing_rules_by_verdict", with_views(
    "SELECT verdict, total AS scans, rule_id, count(*) AS failed FROM (SELECT v.scan_id, v.verdict, count(*) OVER (PARTITION BY v.verdict) AS total FROM verdicts v) v "
    "JOIN findings f ON v.scan_id = f.scan_id WHERE status IN ('FAIL', 'NOT_FOUND') GROUP BY ALL", "verdicts", "findings"))
def failing_rules_by_verdict(spark, sf_dir):
    return plans.failing_rules_by_verdict(star.declarations(spark, sf_dir))


_TYPED = """
SELECT scan_id, CASE WHEN COALESCE(net_quantity_value, 1) <= 0 OR COALESCE(mrp, 1) <= 0 OR COALESCE(panel_area_cm2, 1) <= 0 THEN 'REJECTED'
 WHEN 'FAIL' IN (s0,s1,s2,s3,s4,s5,s6,s7,s8,s9) OR 'NOT_FOUND' IN (s0,s1,s2,s3,s4,s5,s6,s7,s8,s9) THEN 'NON_COMPLIANT'
 WHEN 'NOT_ASSESSABLE' IN (s0,s1,s2,s3,s4,s5,s6,s7,s8,s9) THEN 'INCOMPLETE' ELSE 'COMPLIANT' END AS verdict FROM statuses
"""


@R.add("validate_typed", with_views(_TYPED, "statuses"))
def validate_typed(spark, sf_dir):
    _, verdicts, rejected = plans.validate_typed(star.declarations(spark, sf_dir))
    return verdicts.select("scan_id", "verdict").unionByName(
        rejected.select("scan_id", F.lit("REJECTED").alias("verdict")))


@R.add("numeral_tier", with_views("SELECT scan_id, required_mm, basis FROM tiered", "tiered"))
def numeral_tier(spark, sf_dir):
    return rules.with_tiers(star.declarations(spark, sf_dir)).select(
        "scan_id", "required_mm", F.col("tier_basis").alias("basis"))


@R.add("numeral_tier_range_join", with_views("SELECT scan_id, required_mm FROM tiered", "tiered"))
def numeral_tier_range_join(spark, sf_dir):
    return rules.numeral_tier_join(star.declarations(spark, sf_dir))


@R.add("verdict_fold", with_views("SELECT scan_id, verdict FROM verdicts", "verdicts"))
def verdict_fold(spark, sf_dir):
    return rules.verdict_fold(annotate(rules.findings(star.declarations(spark, sf_dir))))


@R.add("verdict_refold", with_views(
    "SELECT scan_id, CASE WHEN bool_or(status IN ('FAIL', 'NOT_FOUND')) THEN 'NON_COMPLIANT' WHEN bool_or(status = 'NOT_ASSESSABLE') "
    "THEN 'INCOMPLETE' ELSE 'COMPLIANT' END AS verdict FROM findings GROUP BY scan_id", "findings"))
def verdict_refold(spark, sf_dir):
    return rules.verdict_refold(rules.findings(star.declarations(spark, sf_dir)))


@R.add("report_warnings", with_views(
    f"SELECT scan_id, {_WARN_SQL} AS warnings FROM (SELECT *, {_MISSED_SQL} AS missed FROM verdicts)", "verdicts"))
def report_warnings(spark, sf_dir):
    out = rules.report_warnings(annotate(rules.findings(star.declarations(spark, sf_dir))))
    return out.select("scan_id", F.array_join("warnings", " | ").alias("warnings"))


@R.add("number_text", with_views(
    "SELECT scan_id, CAST(min_letter_height_mm AS VARCHAR) AS letter, format('{:g}', net_quantity_value * 1.25) AS quantity FROM declarations",
    "declarations"))
def number_text(spark, sf_dir):
    from packlens.functions.text import short_number
    return star.declarations(spark, sf_dir).select(
        "scan_id", float_text(F.col("min_letter_height_mm")).alias("letter"),
        short_number(F.col("net_quantity_value") * 1.25).alias("quantity"))
