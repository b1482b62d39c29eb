"""Why a finding failed and what to do next.

The guide is a constant map from rule id to texts, so annotation is one narrow projection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlens import fixed_values as fv
from packlens.functions.text import short_number
from packlens.operators.rules import FINDING_FIELDS, sql_text, weak_read


def _guide_map() -> Column:
    """The guide as one constant map literal."""
    def steps(items) -> str:
        return f"array({', '.join(sql_text(i) for i in items)})" if items else "CAST(array() AS ARRAY<STRING>)"

    entries = []
    for rule_id, g in fv.GUIDE.items():
        texts = [f"'{key}', {sql_text(g.get(key))}"
                 for key in ("why_typed", "why_low", "why_clear", "why_invalid", "panel", "keyword")]
        entries.append(f"{sql_text(rule_id)}, named_struct({', '.join(texts)}, 'steps_typed', "
                       f"{steps(g.get('steps_typed', ()))}, 'steps_invalid', {steps(g.get('steps_invalid', ()))})")
    return F.expr(f"map({', '.join(entries)})")


def _fill(template: Column, **values: Column) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{%s}" % name), value)
    return template


def guidance(finding: Callable[[str], Column], conf: Column) -> dict[str, Column]:
    """``cause``, ``why`` and ``next_steps`` of a finding whose fields ``finding`` gives by name."""
    status, message, remedy = finding("status"), finding("message"), finding("remedy")
    g = F.try_element_at(_guide_map(), finding("rule_id"))
    shown = F.concat(short_number(conf), F.lit("%"))
    weak = weak_read(conf)
    seen = F.coalesce(F.nullif(finding("observed"), F.lit("")), F.lit("—"))
    wanted = F.coalesce(F.nullif(finding("expected"), F.lit("")), F.lit("—"))
    close = F.array(F.lit(fv.VERIFY_STEP), F.lit(fv.REVIEW_STEP))
    retake = F.array(_fill(F.lit(fv.RETAKE_STEP.replace("{}", "{panel}")), panel=g["panel"]))
    search = F.array(_fill(F.lit(fv.SEARCH_STEP.replace("{}", "{word}")),
                           word=F.coalesce(g["keyword"], F.lit("the value"))))
    absent, failed, open_ = status == fv.NOT_FOUND, status == fv.FAIL, status == fv.NOT_ASSESSABLE
    invalid = F.array_remove(g["steps_invalid"], fv.VERIFY_STEP)
    cause = (
        F.when(open_, "unmeasured")
        .when(absent & weak, "possible_miss")
        .when(absent, "likely_genuine")
        .when(failed & weak, "likely_genuine")
        .when(failed, "genuine")
    )
    why = (
        F.when(open_, message)
        .when(absent & conf.isNull(), F.coalesce(g["why_typed"], message))
        .when(absent & weak, _fill(g["why_low"], conf=shown))
        .when(absent, _fill(g["why_clear"], conf=shown))
        .when(failed, F.concat(
            _fill(F.coalesce(g["why_invalid"], message), observed=seen, expected=wanted),
            F.when(weak, _fill(F.lit(fv.WEAK_NOTE), conf=shown)).otherwise("")))
    )
    steps = (
        F.when(open_, F.filter(F.array(remedy), lambda r: r.isNotNull()))
        .when(absent & conf.isNull(), F.concat(g["steps_typed"], close))
        .when(absent & weak, F.concat(retake, search, close))
        .when(absent, F.concat(retake, close))
        .when(failed, F.concat(F.when(weak, search).otherwise(F.array().cast("array<string>")), invalid, close))
    )
    known = g.isNotNull()
    return {
        "cause": F.coalesce(F.when(known, cause), F.lit("")),
        "why": F.coalesce(F.when(known, why), F.lit("")),
        "next_steps": F.coalesce(F.when(known, steps), F.array().cast("array<string>")),
    }


def annotate(findings: DataFrame) -> DataFrame:
    """Add ``cause``, ``why`` and ``next_steps``; passing and unknown rules get empty guidance."""
    return findings.withColumns(guidance(F.col, F.col("ocr_confidence")))


def annotated_array(results: Column, conf: Column) -> Column:
    """The same for an array of findings inside a scan's row."""
    return F.transform(results, lambda f: F.struct(
        *[f[name].alias(name) for name in FINDING_FIELDS], *[v.alias(name) for name, v in guidance(lambda n: f[n], conf).items()]))
