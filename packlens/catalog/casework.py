"""Queries over stored scans: search, lists, dashboard numbers, officer actions and report rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from packlens import fixed_values as fv
from packlens.catalog.oracle_views import quote, sql_in, sql_list, with_views
from packlens.catalog.registry import Registry
from packlens.operators import history, report, review, rules
from packlens.sources import star

R = Registry()


def _ts(col):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def _overlays(spark, d):
    return review.attest_merge(rules.findings(star.declarations(spark, d)), star.actions(spark, d))


def _effective(spark, d):
    return review.effective_findings(star.declarations(spark, d), star.actions(spark, d))


def _effective_statuses(spark, d):
    return review.effective_statuses(star.declarations(spark, d), star.actions(spark, d))


# --- filters and projections ---------------------------------------------------------------------
@R.add("owner_scope", with_views("SELECT scan_id, verdict FROM verdicts WHERE owner_id = 7", "verdicts"))
def owner_scope(spark, d):
    return history.owner_scope(star.scans(spark, d), user=7, role="officer").select("scan_id", "verdict")


@R.add("owner_scope_admin", with_views("SELECT scan_id, owner_id FROM declarations", "declarations"))
def owner_scope_admin(spark, d):
    return history.owner_scope(star.declarations(spark, d), user=7, role="admin").select("scan_id", "owner_id")


@R.add("verdict_status_filter", with_views(
    "SELECT scan_id, verdict, status FROM scans WHERE verdict = 'INCOMPLETE' AND status = 'final'", "scans"))
def verdict_status_filter(spark, d):
    return history.verdict_status_filter(star.scans(spark, d), verdict="INCOMPLETE", status="final").select(
        "scan_id", "verdict", "status")


@R.add("scan_search_backslash", with_views(
    r"SELECT scan_id, product_name FROM (SELECT scan_id, replace(product_name, ' ', '\') AS product_name FROM scans) WHERE contains(product_name, '\')", "scans"))
def scan_search_backslash(spark, d):
    slashed = star.scans(spark, d).withColumns({"product_name": F.replace("product_name", F.lit(" "), F.lit("\\")), "brand_name": F.lit(None).cast("string"), "ocr_text": F.lit(None).cast("string")})
    return history.scan_search(slashed, q="\\").select("scan_id", "product_name")


@R.add("history_page_all", with_views(
    "SELECT scan_id, verdict, row_number() OVER (ORDER BY verdict, created_at DESC, scan_id) - 1 AS rn FROM scans QUALIFY rn BETWEEN 510 AND 519", "scans"))
def history_page_all(spark, d):
    out = history.history_page(star.scans(spark, d), sort="verdict", descending=False, page=51)
    return out.select("scan_id", "verdict", F.col("rn").cast("long").alias("rn"))


@R.add("verdict_status_filter_open_set", with_views("SELECT scan_id, status FROM scans WHERE status = 'final'", "scans"))
def verdict_status_filter_open_set(spark, d):
    return history.verdict_status_filter(star.scans(spark, d), verdict="MAYBE", status="final").select("scan_id", "status")


@R.add("scan_search", with_views(
    "SELECT scan_id, product_name FROM scans WHERE CAST(scan_id AS VARCHAR) ILIKE '%R_ng%' OR product_name ILIKE '%R_ng%' "
    "OR brand_name ILIKE '%R_ng%' OR ocr_text ILIKE '%R_ng%'", "scans"))
def scan_search(spark, d):
    return history.scan_search(star.scans(spark, d), q="  R_ng ").select("scan_id", "product_name")


@R.add("scan_summary", with_views(
    "SELECT scan_id, verdict, CAST(compliant AS INTEGER) AS compliant, status, ocr_engine, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, "
    "COALESCE(substr(string_split(trim(ocr_text), chr(10))[1], 1, 80), '') AS preview, COALESCE(product_name, '') AS product_name, "
    "COALESCE(brand_name, '') AS brand_name, COALESCE(category, '') AS category FROM scans", "scans"))
def scan_summary(spark, d):
    out = history.scan_summary(star.scans(spark, d))
    return out.withColumns({"compliant": F.col("compliant").cast("int"), "created_at": _ts("created_at")})


@R.add("valid_gps", with_views(
    "SELECT scan_id, CASE WHEN ok THEN round(scan_lat, 6) END AS scan_lat, CASE WHEN ok THEN round(scan_lon, 6) END AS scan_lon "
    "FROM (SELECT *, scan_lat BETWEEN -90 AND 90 AND scan_lon BETWEEN -180 AND 180 AS ok FROM scans)", "scans"))
def valid_gps(spark, d):
    return history.valid_gps(star.scans(spark, d)).select("scan_id", "scan_lat", "scan_lon")


@R.add("product_identity", with_views(
    "SELECT scan_id, COALESCE(NULLIF(CASE scan_id % 4 WHEN 0 THEN 'Given ' || scan_id ELSE '' END, ''), substr(generic_name, 1, 160), '') AS product_name, "
    "COALESCE(CASE scan_id % 5 WHEN 0 THEN 'Maker' END, substr(manufacturer_name, 1, 160), '') AS brand_name, "
    "CASE scan_id % 3 WHEN 0 THEN 'food' ELSE '' END AS category FROM declarations", "declarations"))
def product_identity(spark, d):
    k = F.col("scan_id")
    rows = star.declarations(spark, d).withColumns({
        "given_product": F.when(k % 4 == 0, F.concat(F.lit(" Given "), k.cast("string"))).otherwise("  "),
        "given_brand": F.when(k % 5 == 0, "Maker\t"),
        "given_category": F.when(k % 3 == 0, " food "),
    })
    return history.product_identity(rows).select("scan_id", "product_name", "brand_name", "category")


@R.add("reportable", with_views("SELECT scan_id, reviewed_by FROM scans WHERE status = 'final'", "scans"))
def reportable(spark, d):
    return history.reportable(star.scans(spark, d)).select("scan_id", "reviewed_by")


@R.add("job_retention", "SELECT event_id AS job_id FROM events WHERE NOT (user_id = 5 AND ts < TIMESTAMP '2024-01-10 12:00:00' - INTERVAL 1 DAY)")
def job_retention(spark, d):
    jobs = star.read(spark, d, "events").select(
        F.col("event_id").alias("job_id"), F.col("user_id").alias("owner_id"), F.col("ts").alias("created_at"))
    return history.job_retention(jobs, owner=5, now="2024-01-10 12:00:00").select("job_id")


# --- dashboard -----------------------------------------------------------------------------------
@R.add("verdict_counts", with_views("SELECT verdict, count(*) AS n FROM verdicts GROUP BY verdict", "verdicts"))
def verdict_counts(spark, d):
    return history.verdict_counts(star.scans(spark, d))


@R.add("top_failed_rules", with_views(
    "SELECT rule_id, count(*) AS n FROM overlaid WHERE status IN ('FAIL', 'NOT_FOUND') AND severity <> 'info' "
    "GROUP BY rule_id ORDER BY n DESC, rule_id LIMIT 8", "overlaid"))
def top_failed_rules(spark, d):
    return history.top_failed_of_scans(_effective_statuses(spark, d))


_NEWEST = "SELECT * FROM verdicts ORDER BY created_at DESC, scan_id LIMIT 500"


@R.add("top_failed_rules_newest", with_views(
    f"SELECT rule_id, count(*) AS n FROM overlaid WHERE scan_id IN (SELECT scan_id FROM ({_NEWEST})) AND status IN ('FAIL', 'NOT_FOUND') "
    "AND severity <> 'info' GROUP BY rule_id ORDER BY n DESC, rule_id LIMIT 8", "overlaid", "verdicts"))
def top_failed_rules_newest(spark, d):
    newest = history.recent_scans(star.declarations(spark, d), limit=500)
    return history.top_failed_of_scans(review.effective_statuses(newest, star.actions(spark, d)))


@R.add("verdict_counts_newest", with_views(f"SELECT verdict, count(*) AS n FROM ({_NEWEST}) GROUP BY verdict", "verdicts"))
def verdict_counts_newest(spark, d):
    newest = history.recent_scans(star.declarations(spark, d), limit=500)
    return history.verdict_counts(rules.verdicts(newest))


@R.add("daily_volume", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY day ORDER BY day DESC LIMIT 14")
def daily_volume(spark, d):
    scans = star.read(spark, d, "orders").select(F.col("o_orderdate").alias("created_at"))
    return history.daily_volume(scans).select(F.col("day").cast("string").alias("day"), "n")


@R.add("daily_volume_newest", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 500) GROUP BY day ORDER BY day DESC LIMIT 14")
def daily_volume_newest(spark, d):
    scans = star.read(spark, d, "orders").select(F.col("o_orderkey").alias("scan_id"), F.col("o_orderdate").alias("created_at"))
    return history.daily_volume(history.recent_scans(scans, limit=500)).select(F.col("day").cast("string").alias("day"), "n")


@R.add("overview_total", "SELECT (SELECT count(*) FROM orders) AS total, least(500, (SELECT count(*) FROM orders)) AS shown")
def overview_total(spark, d):
    scans = star.read(spark, d, "orders").select(F.col("o_orderkey").alias("scan_id"), F.col("o_orderdate").alias("created_at"))
    shown = history.overview_total(scans).select(F.col("total").alias("shown"))
    return history.overview_total(scans, newest=None).crossJoin(F.broadcast(shown))


@R.add("recent_scans", with_views(
    "SELECT scan_id, verdict FROM verdicts ORDER BY created_at DESC, scan_id LIMIT 100", "verdicts"))
def recent_scans(spark, d):
    return history.recent_scans(star.scans(spark, d)).select("scan_id", "verdict")


@R.add("recent_eight", with_views(
    "SELECT scan_id, verdict, status, COALESCE(product_name, '') AS product_name, substr(string_split(ocr_text, chr(10))[1], 1, 80) AS preview "
    "FROM scans ORDER BY created_at DESC, scan_id LIMIT 8", "scans"))
def recent_eight(spark, d):
    return history.scan_summary(history.recent_scans(star.scans(spark, d), limit=8)).select(
        "scan_id", "verdict", "status", "product_name", "preview")


@R.add("history_page", with_views(
    "SELECT scan_id, verdict, row_number() OVER (ORDER BY verdict, created_at DESC, scan_id) - 1 AS rn FROM "
    "(SELECT * FROM scans ORDER BY created_at DESC, scan_id LIMIT 100) QUALIFY rn BETWEEN 90 AND 99", "scans"))
def history_page(spark, d):
    out = history.history_page(star.scans(spark, d), sort="verdict", descending=False, page=50, newest=100)
    return out.select("scan_id", "verdict", F.col("rn").cast("long").alias("rn"))


@R.add("report_counts", with_views(
    "SELECT scan_id, count(*) FILTER (status IN ('FAIL', 'NOT_FOUND')) AS flagged, count(*) FILTER (status = 'PASS') AS passed, "
    "count(*) FILTER (status = 'NOT_ASSESSABLE') AS unassessed, count(*) AS total FROM overlaid GROUP BY scan_id", "overlaid"))
def report_counts(spark, d):
    return history.report_counts_of_scans(_effective_statuses(spark, d))


@R.add("final_split", with_views(
    "SELECT count(*) FILTER (verdict = 'COMPLIANT') AS compliant, count(*) FILTER (verdict <> 'COMPLIANT') AS flagged FROM scans WHERE status = 'final'", "scans"))
def final_split(spark, d):
    return history.final_split(star.scans(spark, d))


# --- officer actions -----------------------------------------------------------------------------
@R.add("editable_findings", "SELECT event_id, CASE WHEN event_id % 10 < 7 THEN 1 ELSE 0 END AS accepted FROM events")
def editable_findings(spark, d):
    return review.editable_findings(star.actions(spark, d)).select("event_id", F.col("accepted").cast("int").alias("accepted"))


@R.add("latest_action", with_views(
    "SELECT scan_id, rule_id, event_id, action, strftime(acted, '%Y-%m-%d %H:%M:%S') AS acted_at FROM actions "
    "QUALIFY row_number() OVER (PARTITION BY scan_id, rule_id ORDER BY acted DESC, event_id DESC) = 1", "actions"))
def latest_action(spark, d):
    return review.latest_action(star.actions(spark, d), "scan_id", "rule_id").select(
        "scan_id", "rule_id", "event_id", "action", _ts("at").alias("acted_at"))


@R.add("attest_merge", with_views(
    'SELECT scan_id, rule_id, status, observed, officer AS "by" FROM overlays', "overlays"))
def attest_merge(spark, d):
    return _overlays(spark, d).select("scan_id", "rule_id", "status", "observed", "by")


@R.add("finding_overlay", with_views(
    "SELECT scan_id, rule_id, status, observed, message, cause, why, steps, manual FROM overlaid", "overlaid"))
def finding_overlay(spark, d):
    return _effective(spark, d).select(
        "scan_id", "rule_id", "status", "observed", "message", "cause", "why",
        F.array_join("next_steps", " | ").alias("steps"), F.col("manual").cast("int").alias("manual"))


def _patches(spark, d):
    """Corrections from events: which fields were sent varies; some sent values are null."""
    e = F.col("event_id")
    fields = F.array(*[F.lit(f) for f in ("generic_name", "mrp", "mrp_includes_taxes", "consumer_care",
                                          "min_letter_height_mm", "country_of_origin", "manufacturer_name")])
    last = review.latest_action(star.actions(spark, d).where("action IN ('attest', 'dispute')"), "scan_id")
    return last.select(
        "scan_id", "by",
        F.filter(fields, lambda f, i: (e + i) % 3 != 0).alias("sent"),
        F.when(e % 4 != 0, F.concat(F.lit("Fixed "), e.cast("string"))).alias("p_generic_name"),
        F.when(e % 5 != 0, (e % 300 + 1).cast("double")).alias("p_mrp"),
        (e % 2 == 0).alias("p_mrp_includes_taxes"),
        F.lit("help@example.org").alias("p_consumer_care"),
        F.when(e % 6 != 0, "India").alias("p_country_of_origin"),
        F.lit("Fixed Maker").alias("p_manufacturer_name"),
    )


_SENT = ["generic_name", "mrp", "mrp_includes_taxes", "consumer_care", "min_letter_height_mm", "country_of_origin", "manufacturer_name"]
_P = {
    "generic_name": "CASE WHEN e % 4 <> 0 THEN 'Fixed ' || e END",
    "mrp": "CASE WHEN e % 5 <> 0 THEN CAST(e % 300 + 1 AS DOUBLE) END",
    "mrp_includes_taxes": "e % 2 = 0",
    "consumer_care": "'help@example.org'",
    "country_of_origin": "CASE WHEN e % 6 <> 0 THEN 'India' END",
    "manufacturer_name": "'Fixed Maker'",
}
_PATCHED = "SELECT b.* REPLACE (" + ", ".join(
    f"CASE WHEN e IS NOT NULL AND (e + {i}) % 3 <> 0 THEN {_P[f]} ELSE {f} END AS {f}" for i, f in enumerate(_SENT) if f in _P
) + ("), e FROM base_declarations b LEFT JOIN (SELECT scan_id, event_id AS e FROM actions WHERE action IN ('attest', 'dispute') "
     "QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY acted DESC, event_id DESC) = 1) p ON b.scan_id = p.scan_id")


def _patched_views():
    from packlens.catalog import oracle_views as ov
    return {"base_declarations": (ov.DECLARATIONS, ()), "declarations": (_PATCHED, ("base_declarations", "actions")),
            "overlays": (ov.OVERLAYS.replace("findings", "base_findings"), ("actions", "base_findings")),
            "base_tiered": (ov.TIERED.replace("declarations", "base_declarations"), ("base_declarations",)),
            "base_statuses": (ov.STATUSES.replace("tiered", "base_tiered"), ("base_tiered",)),
            "base_findings": (ov.FINDINGS.replace("FROM statuses", "FROM base_statuses"), ("base_statuses",))}


_SOURCE_SQL = " || ".join(
    "CASE WHEN " + (f"e IS NOT NULL AND (e + {_SENT.index(f)}) % 3 <> 0 THEN ';{f}=attested' WHEN " if f in _SENT else "")
    + f"{f} IS NOT NULL THEN ';{f}=' || (['read','inferred','ai_assist','uncertain','attested','read','read'])[CAST((scan_id + {3 * i}) % 7 AS INTEGER) + 1] ELSE '' END"
    for i, f in enumerate(fv.TRACKED_FIELDS))


@R.add("field_correction", with_views(
    f"""SELECT d.scan_id, generic_name AS product_name, manufacturer_name AS brand_name, mrp, consumer_care, country_of_origin,
    CASE WHEN e IS NULL THEN 0 ELSE 1 END AS corrected, {_SOURCE_SQL.replace('scan_id', 'd.scan_id')} || CASE WHEN e IS NOT NULL AND (e + 2) % 3 <> 0 THEN ';mrp_includes_taxes=attested' ELSE '' END AS sources, verdict
    FROM declarations d JOIN (SELECT f.scan_id, CASE WHEN bool_or(COALESCE(o.status, f.status) IN ('FAIL', 'NOT_FOUND')) THEN 'NON_COMPLIANT'
      WHEN bool_or(COALESCE(o.status, f.status) = 'NOT_ASSESSABLE') THEN 'INCOMPLETE' ELSE 'COMPLIANT' END AS verdict
      FROM findings f LEFT JOIN overlays o ON f.scan_id = o.scan_id AND f.rule_id = o.rule_id GROUP BY f.scan_id) v ON d.scan_id = v.scan_id""",
    "findings", "overlays", replaced=_patched_views()))
def field_correction(spark, d):
    base = review.with_marks(star.field_sources(star.declarations(spark, d)), star.actions(spark, d))
    fixed = review.field_correction(base, _patches(spark, d))
    out = review.corrected_scans(fixed)
    order = F.array(*[F.lit(f) for f in (*fv.TRACKED_FIELDS, "mrp_includes_taxes")])
    named = F.filter(F.transform(order, lambda f: F.concat(
        F.lit(";"), f, F.lit("="), F.try_element_at("field_sources", f))), lambda x: x.isNotNull())
    return out.select("scan_id", "product_name", "brand_name", "mrp", "consumer_care", "country_of_origin",
                      F.col("corrected").cast("int").alias("corrected"), F.array_join(named, "").alias("sources"), "verdict")


_GATE = """SELECT a.event_id, a.scan_id, a.action, a.officer, a.notes, a.acted, CASE WHEN a.scan_id % 4 = 1 THEN 'already_final'
 WHEN action = 'override' AND role <> 'admin' THEN 'needs_admin' WHEN action = 'override' AND trim(notes) = '' THEN 'needs_notes' ELSE 'ok' END AS reason
 FROM actions a WHERE action IN ('confirm', 'override')"""


def _reviews(spark, d):
    return star.actions(spark, d).where("action IN ('confirm', 'override')")


def _status_only(spark, d):
    return star.read(spark, d, "orders").select(
        F.col("o_orderkey").alias("scan_id"),
        F.when(F.col("o_orderkey") % 4 == 1, "final").otherwise("pending_review").alias("status"))


@R.add("not_final_gate", with_views(f"SELECT event_id, scan_id, reason FROM ({_GATE})", "actions"))
def not_final_gate(spark, d):
    return review.review_gate(_reviews(spark, d), _status_only(spark, d)).select("event_id", "scan_id", "reason")


@R.add("review_apply", with_views(
    f"""SELECT r.scan_id, 'final' AS status, CASE WHEN r.action = 'override' THEN 'COMPLIANT' ELSE v.verdict END AS verdict,
    CASE WHEN r.action = 'override' THEN COALESCE(i.ids, '') ELSE '' END AS overridden, r.officer AS reviewed_by, substr(r.notes, 1, 2000) AS review_notes
    FROM (SELECT * FROM ({_GATE}) WHERE reason = 'ok' QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY acted, event_id) = 1) r
    JOIN verdicts v ON r.scan_id = v.scan_id LEFT JOIN (SELECT scan_id, string_agg(rule_id, ', ' ORDER BY rule_order) AS ids FROM findings
      WHERE status IN ('FAIL', 'NOT_FOUND') GROUP BY scan_id) i ON r.scan_id = i.scan_id""", "actions", "verdicts", "findings"))
def review_apply(spark, d):
    scans = star.scans(spark, d).select("scan_id", "status", "verdict")
    out = review.review_apply(scans, _reviews(spark, d), rules.findings(star.declarations(spark, d)))
    return out.select("scan_id", "status", "verdict", F.array_join("overridden", ", ").alias("overridden"),
                      "reviewed_by", "review_notes")


@R.add("correction_counts", with_views(
    """SELECT officer AS "by", CAST(sum(c) AS BIGINT) AS scans_corrected, CAST(sum(o) AS BIGINT) AS findings_attested FROM (
    SELECT officer, 1 AS c, 0 AS o FROM (SELECT * FROM actions WHERE action IN ('attest', 'dispute') QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY acted DESC, event_id DESC) = 1)
    UNION ALL SELECT officer, 0, 1 FROM overlays) GROUP BY officer""", "actions", "overlays"))
def correction_counts(spark, d):
    return review.correction_counts(_patches(spark, d), _overlays(spark, d))


_PRIORITY = "list_filter(" + sql_list(fv.SOURCE_PRIORITY) + ", lambda p: list_contains({seen}, p))[1]"


def _src(field: str) -> str:
    i = fv.TRACKED_FIELDS.index(field)
    return (f"CASE WHEN {field} IS NOT NULL THEN (['read','inferred','ai_assist','uncertain','attested','read','read'])"
            f"[CAST((scan_id + {3 * i}) % 7 AS INTEGER) + 1] END")


_PROV = " UNION ALL ".join(
    f"SELECT scan_id, {quote(r)} AS rule_id, COALESCE({_PRIORITY.format(seen='[' + ', '.join(_src(f) for f in fs) + ']')}, '') AS source FROM declarations"
    for r, fs in fv.RULE_SOURCE_FIELDS.items()) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT scan_id, {quote(r)}, CASE WHEN min_numeral_height_mm IS NOT NULL THEN 'measured' ELSE '' END FROM declarations" for r in fv.RULE_IDS[7:])


@R.add("finding_provenance", with_views(_PROV, "declarations"))
def finding_provenance(spark, d):
    decl = star.field_sources(star.declarations(spark, d))
    return review.finding_provenance(rules.findings(decl), decl)


# --- report rows ---------------------------------------------------------------------------------
_REQ_SQL = """
CASE WHEN f.rule_id IN ('LMPC-7.2-numeral', 'LMPC-7.3-letter') AND bits <> '' THEN requirement || ' (' || bits || ')' ELSE requirement END"""
_BITS = """
concat_ws(', ', CASE WHEN contains(expected, 'Table-II') THEN 'Table-II' WHEN contains(expected, 'Table-I') THEN 'Table-I' END,
 COALESCE(NULLIF(regexp_extract(expected, 'net ([\\d.]+)g/ml', 1), '') || 'g', NULLIF(regexp_extract(expected, 'panel ([\\d.]+)cm', 1), '') || 'cm² panel'),
 CASE WHEN contains(lower(expected), 'embossed') THEN 'embossed' WHEN contains(lower(expected), 'ordinary print') THEN 'ordinary print' END)"""


@R.add("rule_label_join", with_views(
    f"SELECT scan_id, f.rule_id, ref, {_REQ_SQL} AS requirement FROM (SELECT *, {_BITS} AS bits FROM findings) f JOIN short_rules s ON f.rule_id = s.rule_id",
    "findings", "short_rules"))
def rule_label_join(spark, d):
    return report.rule_label_join(rules.findings(star.declarations(spark, d))).select("scan_id", "rule_id", "ref", "requirement")


_ENGINE_SQL = ("(CASE WHEN contains(lower(ocr_engine), 'tesseract') THEN 'Tesseract OCR' WHEN contains(lower(ocr_engine), 'florence') THEN 'Florence-2 VLM' "
               "ELSE COALESCE(NULLIF(ocr_engine, ''), 'OCR') END) || ' — ' || format('{:g}', COALESCE(ocr_confidence, 0.0)) || '%'")


@R.add("engine_label", with_views(f"SELECT scan_id, {_ENGINE_SQL} AS engine FROM scans", "scans"))
def engine_label(spark, d):
    return star.scans(spark, d).select("scan_id", report.engine_label(F.col("ocr_engine"), F.col("ocr_confidence")).alias("engine"))


@R.add("display_observed", with_views(
    "SELECT scan_id, rule_id, CASE WHEN COALESCE(trim(observed), '') = '' OR lower(observed) = 'absent' THEN 'Not detected on scanned panel' "
    "WHEN lower(observed) = 'unmeasured' THEN 'Not measured' ELSE replace(trim(observed), '×', 'x') END AS shown FROM findings", "findings"))
def display_observed(spark, d):
    return rules.findings(star.declarations(spark, d)).select(
        "scan_id", "rule_id", report.display_observed(F.col("observed")).alias("shown"))


@R.add("case_header", with_views(
    f"""SELECT s.scan_id, COALESCE(NULLIF(trim(product_name), ''), '—') AS product, COALESCE(NULLIF(trim(brand_name), ''), '—') AS brand,
    COALESCE(NULLIF(trim(category), ''), '—') AS category, COALESCE(CASE WHEN lower(observed) NOT IN ('absent', 'unmeasured', '') THEN observed END, '—') AS net_quantity,
    strftime(created_at, '%Y-%m-%d %H:%M UTC') AS scanned_at, COALESCE(strftime(reviewed_at, '%Y-%m-%d %H:%M UTC'), '—') AS reviewed_at,
    COALESCE(reviewed_by, '—') AS reviewed_by, {_ENGINE_SQL} AS engine,
    CASE WHEN scan_lat IS NOT NULL AND scan_lon IS NOT NULL THEN 'Inspection location (device GPS at upload): ' || format('{{:.5f}}', scan_lat) || ', ' || format('{{:.5f}}', scan_lon)
      ELSE 'Inspection location: Not provided (GPS unavailable / desktop upload)' END AS location,
    CASE WHEN overridden THEN 'Officer override by ' || reviewed_by || ': ' || review_notes END AS warning
    FROM scans s LEFT JOIN overlaid o ON s.scan_id = o.scan_id AND o.rule_id = 'LMPC-6.1-netqty'""", "scans", "overlaid"))
def case_header(spark, d):
    return report.case_header(star.scans(spark, d), _effective(spark, d))


_BLOCK = """(ref || ':') || chr(10) || CASE WHEN why <> '' THEN why || chr(10) ELSE '' END || CASE WHEN steps <> '' THEN 'Recommended next steps: ' ||
 array_to_string(list_transform(string_split(steps, ' | '), lambda s, i: '(' || i || ') ' || s), '; ') || chr(10) ELSE '' END"""


@R.add("enforcement_summary", with_views(
    f"""SELECT v.scan_id, v.verdict, CASE v.verdict WHEN 'COMPLIANT' THEN {quote(chr(10).join(fv.CLEAR_LINES))}
    WHEN 'INCOMPLETE' THEN {quote(chr(10).join(fv.INCOMPLETE_LINES))} || chr(10) || rtrim(COALESCE(bad_lines, '') || COALESCE(open_lines, ''), chr(10))
    ELSE 'Non-compliance recorded on ' || COALESCE(n_bad, 0) || CASE WHEN n_bad = 1 THEN ' rule: ' ELSE ' rules: ' END || COALESCE(refs, '') || '.' || chr(10) || COALESCE(bad_lines, '') || {quote(fv.SHOW_CAUSE_LINE)} END AS lines
    FROM verdicts v LEFT JOIN (SELECT scan_id, count(*) FILTER (bad) AS n_bad, string_agg(ref, ', ' ORDER BY rule_order) FILTER (bad) AS refs,
      string_agg(block, '' ORDER BY rule_order) FILTER (bad) AS bad_lines, string_agg(block, '' ORDER BY rule_order) FILTER (NOT bad) AS open_lines
      FROM (SELECT o.*, ref, status IN ('FAIL', 'NOT_FOUND') AS bad, {_BLOCK} AS block FROM overlaid o JOIN short_rules s ON o.rule_id = s.rule_id WHERE status <> 'PASS') GROUP BY scan_id) x
    ON v.scan_id = x.scan_id""", "verdicts", "overlaid", "short_rules"))
def enforcement_summary(spark, d):
    scans = rules.verdicts(star.declarations(spark, d)).select("scan_id", "verdict")
    out = report.enforcement_summary(scans, _effective(spark, d))
    return out.select("scan_id", "verdict", F.array_join("lines", "\n").alias("lines"))
