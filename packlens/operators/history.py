"""Search, lists and dashboard aggregates over stored scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from packlens import fixed_values as fv
from packlens.functions.text import lines_of, strip
from packlens.operators.frames import round_to


def owner_scope(scans: DataFrame, *, user, role: str) -> DataFrame:
    return scans if role == "admin" else scans.where(F.col("owner_id") == F.lit(user))


def verdict_status_filter(scans: DataFrame, *, verdict: str | None = None, status: str | None = None) -> DataFrame:
    """Equality filters; a value outside the closed sets is ignored."""
    if verdict in fv.VERDICTS:
        scans = scans.where(F.col("verdict") == verdict)
    if status in fv.WORKFLOW_STATUSES:
        scans = scans.where(F.col("status") == status)
    return scans


def scan_search(scans: DataFrame, *, q: str | None) -> DataFrame:
    """Case-insensitive substring search; ``%`` and ``_`` in the term act as wildcards, a backslash stands for itself."""
    term = (q or "").strip()
    if not term:
        return scans
    like = "%" + term.replace("\\", "\\\\") + "%"
    hit = F.col("scan_id").cast("string").ilike(like)
    for name in ("product_name", "brand_name", "ocr_text"):
        hit = hit | F.coalesce(F.col(name).ilike(like), F.lit(False))
    return scans.where(hit)


def preview_of(text: Column) -> Column:
    return F.substring(F.coalesce(F.get(lines_of(strip(text)), 0), F.lit("")), 1, 80)


def scan_summary(scans: DataFrame) -> DataFrame:
    blank = {c: F.coalesce(c, F.lit("")) for c in ("product_name", "brand_name", "category")}
    return scans.withColumns({**blank, "preview": preview_of(F.col("ocr_text"))}).select(
        "scan_id", "verdict", "compliant", "status", "ocr_engine", "created_at", "preview", *blank)


def valid_gps(scans: DataFrame) -> DataFrame:
    lat, lon = F.col("scan_lat"), F.col("scan_lon")
    ok = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
    return scans.withColumns({"scan_lat": F.when(ok, round_to(lat, 6)), "scan_lon": F.when(ok, round_to(lon, 6))})


def product_identity(rows: DataFrame) -> DataFrame:
    """Supplied labels win over extracted ones; the category is only ever supplied."""
    def supplied(name: str, size: int) -> Column:
        return F.nullif(F.substring(strip(F.coalesce(F.col(name), F.lit(""))), 1, size), F.lit(""))

    return rows.withColumns({
        "product_name": F.coalesce(supplied("given_product", 160), F.substring("generic_name", 1, 160), F.lit("")),
        "brand_name": F.coalesce(supplied("given_brand", 160), F.substring("manufacturer_name", 1, 160), F.lit("")),
        "category": F.coalesce(supplied("given_category", 80), F.lit("")),
    })


def reportable(scans: DataFrame) -> DataFrame:
    return scans.where(F.col("status") == "final")


def job_retention(jobs: DataFrame, *, owner, now) -> DataFrame:
    """Drop the owner's jobs older than one day; other owners' jobs stay."""
    stale = (F.col("owner_id") == F.lit(owner)) & (F.col("created_at") < F.lit(now).cast("timestamp_ntz") - F.expr("INTERVAL '1' DAY"))
    return jobs.where(~stale)


def newest_first() -> list[Column]:
    return [F.col("created_at").desc(), F.col("scan_id").asc()]


def recent_scans(scans: DataFrame, *, limit: int = 100) -> DataFrame:
    """Newest rows; one sorted top-k per task, no global sort."""
    return scans.orderBy(*newest_first()).limit(limit)


def history_page(scans: DataFrame, *, sort: str = "created_at", descending: bool = True, page: int = 0,
                 size: int = 10, newest: int | None = None) -> DataFrame:
    """One page of all rows, or of the ``newest``; a page past the end becomes the last page.

    A sorted top-k with an offset finds the page, and only its ``size`` rows are numbered.
    """
    rows = scans if newest is None else recent_scans(scans, limit=newest)
    first = min(page, max(-(-rows.count() // size), 1) - 1) * size
    order = [F.col(sort).desc() if descending else F.col(sort).asc(), *newest_first()]
    on_page = rows.orderBy(*order).offset(first).limit(size)
    return on_page.withColumn("rn", F.row_number().over(W.orderBy(*order)) - 1 + first)


def verdict_counts(scans: DataFrame) -> DataFrame:
    return scans.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def top_failed_rules(effective: DataFrame, *, limit: int = 8) -> DataFrame:
    hit = F.col("status").isin(fv.FAIL, fv.NOT_FOUND) & (F.col("severity") != "info")
    return effective.where(hit).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), "rule_id").limit(limit)


def top_failed_of_scans(rows: DataFrame, *, limit: int = 8) -> DataFrame:
    """The same from status columns per scan (``effective_statuses``): ten counters, one row per task. A passed rule that was disputed stays information."""
    counters = [F.count_if(F.col(f"s{i}").isin(fv.FAIL, fv.NOT_FOUND) & (F.col(f"m{i}") != fv.PASS)).alias(f"n{i}") for i in range(len(fv.RULE_IDS))]
    pairs = F.array(*[F.struct(F.lit(r).alias("rule_id"), F.col(f"n{i}").alias("n")) for i, r in enumerate(fv.RULE_IDS)])
    return rows.agg(*counters).select(F.inline(pairs)).where("n > 0").orderBy(F.desc("n"), "rule_id").limit(limit)


def report_counts_of_scans(rows: DataFrame) -> DataFrame:
    """Counts per scan from its status columns, without leaving the row."""
    every = F.array(*[F.col(f"s{i}") for i in range(len(fv.RULE_IDS))])
    count = lambda *wanted: F.size(F.filter(every, lambda s: s.isin(*wanted))).cast("bigint")
    return rows.select(
        "scan_id", count(fv.FAIL, fv.NOT_FOUND).alias("flagged"), count(fv.PASS).alias("passed"), count(fv.NOT_ASSESSABLE).alias("unassessed"),
        F.lit(len(fv.RULE_IDS)).cast("bigint").alias("total"))


def daily_volume(scans: DataFrame, *, days: int = 14) -> DataFrame:
    """Scans per day over the last days that have any."""
    return scans.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("day")).limit(days)


def overview_total(scans: DataFrame, *, newest: int | None = 500) -> DataFrame:
    rows = scans if newest is None else recent_scans(scans, limit=newest)
    return rows.agg(F.count(F.lit(1)).alias("total"))


def report_counts(effective: DataFrame) -> DataFrame:
    s = F.col("status")
    return effective.groupBy("scan_id").agg(
        F.count_if(s.isin(fv.FAIL, fv.NOT_FOUND)).alias("flagged"),
        F.count_if(s == fv.PASS).alias("passed"),
        F.count_if(s == fv.NOT_ASSESSABLE).alias("unassessed"),
        F.count(F.lit(1)).alias("total"),
    )


def final_split(scans: DataFrame) -> DataFrame:
    return reportable(scans).agg(F.count_if(F.col("verdict") == fv.COMPLIANT).alias("compliant"),
                                 F.count_if(F.col("verdict") != fv.COMPLIANT).alias("flagged"))
