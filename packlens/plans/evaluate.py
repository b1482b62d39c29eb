"""Rules, guidance and verdicts put together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlens import fixed_values as fv
from packlens.operators import rules
from packlens.operators.guidance import annotate


def evaluate(decl: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annotated findings (one row per scan and rule) and one verdict row per scan."""
    return annotate(rules.findings(decl)), rules.verdicts(decl)


def validate_typed(decl: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Typed declarations: strict verdicts, no confidence; rows with non-positive numbers are rejected."""
    bad = F.lit(False)
    for name in ("net_quantity_value", "mrp", "panel_area_cm2"):
        bad = bad | F.coalesce(F.col(name) <= 0, F.lit(False))
    typed = decl.withColumn("ocr_confidence", F.lit(None).cast("double"))
    findings, verdicts = evaluate(typed.where(~bad))
    return findings, verdicts, typed.where(bad)


def failing_rules_by_verdict(decl: DataFrame) -> DataFrame:
    """Which rules fail most, by verdict.

    Statuses and verdict are computed inside each declaration row; ten counters per verdict combine
    before the only shuffle, whose size is three verdicts per task however large the input is.
    """
    counters = [F.count_if(F.col(f"s{i}").isin(fv.FAIL, fv.NOT_FOUND)).alias(f"n{i}")
                for i in range(len(fv.RULE_IDS))]
    per_verdict = (
        rules.statuses(decl)
        .withColumn("verdict", rules.row_verdict(F.col("ocr_confidence")))
        .groupBy("verdict").agg(F.count(F.lit(1)).alias("scans"), *counters)
    )
    pairs = F.array(*[F.struct(F.lit(r).alias("rule_id"), F.col(f"n{i}").alias("failed"))
                      for i, r in enumerate(fv.RULE_IDS)])
    return per_verdict.select("verdict", "scans", F.inline(pairs)).where("failed > 0")
