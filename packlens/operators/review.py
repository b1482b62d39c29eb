"""Officer actions over machine findings: attestations, corrections, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlens import fixed_values as fv
from packlens.functions.text import strip
from packlens.operators import rules
from packlens.operators.guidance import annotated_array


def latest_action(actions: DataFrame, *keys: str) -> DataFrame:
    """Last action per key. An aggregate with a map-side step, so a hot key stays one row per task."""
    rest = [c for c in actions.columns if c not in keys]
    return actions.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct("at", "event_id")).alias("last")
    ).select(*keys, "last.*")


def editable_findings(actions: DataFrame) -> DataFrame:
    """Mark which finding edits are allowed."""
    return actions.withColumn("accepted", F.col("rule_id").isin(*fv.RULE6_IDS))


def attest_merge(machine: DataFrame, actions: DataFrame) -> DataFrame:
    """Overlay rows left after all actions.

    Every action replaces or removes the whole overlay of its finding, so only the last one counts.
    """
    edits = actions.where(F.col("action").isin("attest", "dispute", "withdraw"))
    last = latest_action(editable_findings(edits).where("accepted").drop("accepted"), "scan_id", "rule_id")
    base = machine.select("scan_id", "rule_id", F.col("status").alias("machine_status"),
                          F.col("observed").alias("machine_observed"))
    attests = F.col("action") == "attest"
    kept = last.join(base, ["scan_id", "rule_id"]).where(attests | (F.col("machine_status") == fv.PASS))
    return kept.select(
        "scan_id", "rule_id",
        F.when(attests, fv.PASS).otherwise(fv.FAIL).alias("status"),
        attests.alias("has_observed"),
        F.when(attests, F.coalesce("observed", "machine_observed")).alias("observed"),
        "by", "at",
    )


def finding_overlay(findings: DataFrame, overlays: DataFrame) -> DataFrame:
    """Officer attestations applied over annotated findings; machine rows stay untouched elsewhere."""
    o = overlays.select(
        "scan_id", "rule_id", F.col("status").alias("o_status"), F.col("has_observed"),
        F.col("observed").alias("o_observed"), F.lit(True).alias("hit"))
    hit = F.coalesce(F.col("hit"), F.lit(False))
    attested, disputed = F.col("o_status") == fv.PASS, F.col("o_status") == fv.FAIL
    none = F.array().cast("array<string>")
    steps = F.array(*[F.lit(s) for s in fv.DISPUTED_STEPS])
    joined = findings.join(o, ["scan_id", "rule_id"], "left")
    return joined.withColumns({
        "status": F.coalesce("o_status", "status"),
        "cause": F.when(attested, "attested").when(disputed, "disputed").otherwise(F.col("cause")),
        "why": F.when(attested, "").when(disputed, fv.DISPUTED_WHY).otherwise(F.col("why")),
        "next_steps": F.when(attested, none).when(disputed, steps).otherwise(F.col("next_steps")),
        "observed": F.when(F.coalesce("has_observed", F.lit(False)), F.col("o_observed")).otherwise(F.col("observed")),
        "message": F.when(hit, strip(F.concat("message", F.lit(fv.OFFICER_SUFFIX)))).otherwise(F.col("message")),
        "manual": hit,
    }).drop("o_status", "has_observed", "o_observed", "hit")


def rule_actions(actions: DataFrame) -> DataFrame:
    """One row per scan: ``acts``, a map from rule to the last action on it. One aggregate with a map-side step; at most seven entries."""
    edits = editable_findings(actions.where(F.col("action").isin("attest", "dispute", "withdraw"))).where("accepted")
    step = F.struct("at", "event_id", "action", "observed", "by")
    per = edits.groupBy("scan_id").agg(*[F.max(F.when(F.col("rule_id") == r, step)).alias(f"__r{i}") for i, r in enumerate(fv.RULE6_IDS)])
    entries = [F.when(F.col(f"__r{i}").isNotNull(), F.struct(F.lit(r).alias("key"), F.struct(
        F.col(f"__r{i}.action").alias("action"), F.col(f"__r{i}.observed").alias("observed")).alias("value"))) for i, r in enumerate(fv.RULE6_IDS)]
    return per.select("scan_id", F.map_from_entries(F.array_compact(F.array(*entries))).alias("acts"))


def _overlay_status(act: Column, machine: Column) -> Column:
    """Status an action puts over a machine status, null where the machine's stays: an attestation passes, anything else fails a pass."""
    return F.when(act["action"] == "attest", fv.PASS).when(act.isNotNull() & (machine == fv.PASS), fv.FAIL)


def effective_statuses(decl: DataFrame, actions: DataFrame, *keep: str) -> DataFrame:
    """Status columns ``s0`` ... ``s9`` after all actions, and ``m0`` ... ``m9`` as the rules gave them: one pass, one join per scan."""
    rows = rules.statuses(decl, *keep).join(rule_actions(actions), "scan_id", "left")
    machine = {f"m{i}": F.col(f"s{i}") for i in range(len(fv.RULE_IDS))}
    effective = {f"s{i}": F.coalesce(_overlay_status(F.try_element_at("acts", F.lit(r)), F.col(f"m{i}")), F.col(f"m{i}")) for i, r in enumerate(fv.RULE_IDS)}
    return rows.withColumns(machine).withColumns(effective).drop("acts")


def effective_findings(decl: DataFrame, actions: DataFrame) -> DataFrame:
    """Annotated findings after all actions: folded inside each scan's row, exploded once at the end.

    Actions join declarations, not their findings: those are many times as large, and this join may have to shuffle its rows.
    """
    rows = rules.with_results(decl.join(rule_actions(actions), "scan_id", "left")).select("scan_id", "ocr_confidence", "acts", "results")
    rows = rows.withColumn("results", annotated_array(F.col("results"), F.col("ocr_confidence")))
    steps = F.array(*[F.lit(s) for s in fv.DISPUTED_STEPS])

    def folded(f: Column) -> Column:
        act = F.try_element_at("acts", f["rule_id"])
        status = _overlay_status(act, f["status"])
        passed, failed = F.coalesce(status == fv.PASS, F.lit(False)), F.coalesce(status == fv.FAIL, F.lit(False))
        new = {
            "status": F.coalesce(status, f["status"]),
            "observed": F.when(passed, F.coalesce(act["observed"], f["observed"])).otherwise(f["observed"]),
            "message": F.when(passed | failed, strip(F.concat(f["message"], F.lit(fv.OFFICER_SUFFIX)))).otherwise(f["message"]),
            "cause": F.when(passed, "attested").when(failed, "disputed").otherwise(f["cause"]),
            "why": F.when(passed, "").when(failed, fv.DISPUTED_WHY).otherwise(f["why"]),
            "next_steps": F.when(passed, F.array().cast("array<string>")).when(failed, steps).otherwise(f["next_steps"]),
            "manual": passed | failed,
        }
        return F.struct(*[new.pop(name, f[name]).alias(name) for name in (*rules.FINDING_FIELDS, "cause", "why", "next_steps", "manual")])

    return rows.select("scan_id", "ocr_confidence", F.inline(F.transform("results", folded)))


def with_marks(decl: DataFrame, actions: DataFrame) -> DataFrame:
    """Declarations with ``marks``: a map from rule to the status that officers put over it."""
    rows = rules.statuses(decl, *[c for c in decl.columns if c not in ("scan_id", "ocr_confidence")]).join(rule_actions(actions), "scan_id", "left")
    over = [(r, _overlay_status(F.try_element_at("acts", F.lit(r)), F.col(f"s{i}"))) for i, r in enumerate(fv.RULE_IDS)]
    entries = [F.when(status.isNotNull(), F.struct(F.lit(r).alias("key"), status.alias("value"))) for r, status in over]
    return rows.select(*decl.columns, F.map_from_entries(F.array_compact(F.array(*entries))).alias("marks"))


def field_correction(decl: DataFrame, patches: DataFrame) -> DataFrame:
    """Patch the sent editable fields of a declaration; an explicit null counts as sent.

    ``patches`` has one row per scan: ``sent`` (array of field names) and one ``p_<field>`` column per
    patched field. Corrected fields are marked ``attested``.
    """
    sent = F.coalesce(F.array_intersect("sent", F.array(*[F.lit(f) for f in fv.EDITABLE_FIELDS])),
                      F.array().cast("array<string>"))
    joined = decl.join(patches, "scan_id", "left").withColumn("sent", sent)
    values = {
        f: F.when(F.array_contains("sent", f), F.col(f"p_{f}")).otherwise(F.col(f))
        for f in fv.EDITABLE_FIELDS if f"p_{f}" in patches.columns
    }
    marks = F.map_from_arrays("sent", F.transform("sent", lambda _: F.lit("attested")))
    kept = F.map_filter("field_sources", lambda key, _: ~F.array_contains("sent", key))
    return joined.withColumns({**values, "field_sources": F.map_concat(kept, marks)}).select(
        *decl.columns, (F.size("sent") > 0).alias("corrected"))


def corrected_scans(corrected: DataFrame) -> DataFrame:
    """Verdict and product identity after a correction: rules again, marks of ``with_marks`` applied, statuses folded, all inside the row."""
    keep = [c for c in corrected.columns if c not in ("scan_id", "ocr_confidence")]
    rows = rules.statuses(corrected, *keep)
    every = F.array(*[F.coalesce(F.try_element_at("marks", F.lit(r)), F.col(f"s{i}")) for i, r in enumerate(fv.RULE_IDS)])
    return rows.withColumns({
        "verdict": rules.refold(every),
        "product_name": F.substring(F.col("generic_name"), 1, 160),
        "brand_name": F.substring(F.col("manufacturer_name"), 1, 160),
    }).drop("marks", *[f"s{i}" for i in range(len(fv.RULE_IDS))])


def review_gate(reviews: DataFrame, scans: DataFrame) -> DataFrame:
    """Reason why a review is refused, ``ok`` otherwise."""
    override = F.col("action") == "override"
    reason = (
        F.when(F.col("status") == "final", "already_final")
        .when(override & (F.col("role") != "admin"), "needs_admin")
        .when(override & (strip(F.col("notes")) == ""), "needs_notes")
        .otherwise("ok")
    )
    return reviews.join(scans.select("scan_id", "status"), "scan_id").withColumn("reason", reason)


def review_apply(scans: DataFrame, reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """Finalise scans. The first acceptable review per scan wins; later ones meet a final scan.

    Overridden rule ids come from at most ten rules per scan, so the set stays small.
    """
    ok = review_gate(reviews, scans).where("reason = 'ok'")
    first = ok.groupBy("scan_id").agg(
        F.min_by(F.struct("action", "by", "notes", F.col("at").alias("decided_at")), F.struct("at", "event_id")).alias("r"))
    order = F.array(*[F.lit(r) for r in fv.RULE_IDS])
    blocked = findings.where(F.col("status").isin(fv.FAIL, fv.NOT_FOUND) & F.col("rule_id").isin(*fv.RULE_IDS))
    ids = blocked.join(first.where("r.action = 'override'").select("scan_id"), "scan_id", "left_semi").groupBy(
        "scan_id").agg(F.collect_set("rule_id").alias("ids"))
    override = F.col("r.action") == "override"
    return first.join(scans.select("scan_id", "verdict"), "scan_id").join(ids, "scan_id", "left").select(
        "scan_id", F.lit("final").alias("status"),
        F.when(override, fv.COMPLIANT).otherwise(F.col("verdict")).alias("verdict"),
        F.when(override, F.filter(order, lambda x: F.array_contains(F.coalesce("ids", F.array().cast("array<string>")), x)))
        .otherwise(F.array().cast("array<string>")).alias("overridden"),
        F.col("r.by").alias("reviewed_by"), F.col("r.decided_at").alias("reviewed_at"),
        F.substring("r.notes", 1, 2000).alias("review_notes"),
    )


def correction_counts(corrections: DataFrame, overlays: DataFrame) -> DataFrame:
    """Corrected scans and attested findings per officer."""
    per = corrections.groupBy("by").agg(F.count(F.lit(1)).alias("scans_corrected"), F.lit(0).cast("long").alias("findings_attested"))
    per = per.unionByName(overlays.groupBy("by").agg(
        F.lit(0).cast("long").alias("scans_corrected"), F.count(F.lit(1)).alias("findings_attested")))
    return per.groupBy("by").agg(F.sum("scans_corrected").alias("scans_corrected"),
                                 F.sum("findings_attested").alias("findings_attested"))


def source_of_rule(rule_id: Column, sources: Column, measured: Column) -> Column:
    """Provenance badge of a finding: the strongest source among the fields the rule looks at."""
    fields = F.create_map(*[x for r, fs in fv.RULE_SOURCE_FIELDS.items()
                            for x in (F.lit(r), F.array(*[F.lit(f) for f in fs]))])
    seen = F.transform(F.coalesce(F.try_element_at(fields, rule_id), F.array().cast("array<string>")),
                       lambda f: F.try_element_at(sources, f))
    ranked = F.filter(F.array(*[F.lit(s) for s in fv.SOURCE_PRIORITY]), lambda s: F.array_contains(seen, s))
    other = F.get(F.filter(seen, lambda s: s.isNotNull() & (s != "")), 0)
    by_fields = F.coalesce(F.get(ranked, 0), other, F.lit(""))
    return F.when(rule_id.isin(*fv.RULE_IDS[7:]), F.when(measured, "measured").otherwise("")).otherwise(by_fields)


def finding_provenance(findings: DataFrame, declarations: DataFrame) -> DataFrame:
    info = declarations.select("scan_id", "field_sources", F.col("min_numeral_height_mm").isNotNull().alias("measured"))
    return findings.join(info, "scan_id").select(
        "scan_id", "rule_id", source_of_rule(F.col("rule_id"), F.col("field_sources"), F.col("measured")).alias("source"))
