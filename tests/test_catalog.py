import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
SF = "/root/testdata/sf0.001"
NAMES = ("failing_rules_by_verdict", "evaluate_compliance", "line_union", "gtin_cards", "weak_rows", "span_prf",
         "attest_merge", "stream_findings", "stream_daily_volume", "model_patch_parse")


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    import compare

    from packlens.catalog.all_queries import all_queries

    query = all_queries()[name]
    df = query.run(spark, SF)
    names, rows = compare.table(df.columns, df.collect())
    cursor = compare.connect(SF).execute(query.sql)
    assert (names, rows) == compare.table([d[0] for d in cursor.description], cursor.fetchall())
