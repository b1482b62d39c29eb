"""Headline queries, timed end to end into a no-op sink; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from packlens.catalog.all_queries import all_queries
from packlens.session import local_session

HEADLINE = (
    "failing_rules_by_verdict", "evaluate_compliance", "annotate_failure", "top_failed_rules", "report_counts",
    "verdict_counts_newest", "scan_search", "line_union", "measured_frame", "visual_lines", "gtin_cards",
    "extract_declarations", "extract_documents", "field_accuracy", "bio_from_patterns", "span_prf",
    "stream_findings", "gazetteer_fill",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = local_session(cpus, app="packlens-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    # Code is compiled and caches are filled before anything is timed.
    for name in ("evaluate_compliance", "extract_declarations"):
        queries[name].run(spark, sf_dir).limit(1000).write.format("noop").mode("overwrite").save()
    times = {}
    for name in wanted:
        start = time.perf_counter()
        queries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "packlens_headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
