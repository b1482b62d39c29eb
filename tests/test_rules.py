import datetime as dt

import pytest

from packlens.operators import rules
from packlens.operators.guidance import annotate
from packlens.sources.corpus import DECLARATION

GOOD = {
    "manufacturer_name": "Acme", "manufacturer_address": "Pune", "generic_name": "Oats", "net_quantity_value": 200.0,
    "net_quantity_unit": "g", "mrp": 50.0, "mrp_includes_taxes": True, "mfg_date": dt.date(2025, 1, 1),
    "expiry_date": dt.date(2026, 1, 1), "consumer_care": "1800 123 456", "is_imported": False, "is_embossed": False,
    "min_numeral_height_mm": 1.0, "min_letter_height_mm": 1.0, "min_width_to_height_ratio": 0.5,
}


def frame(spark, rows):
    names = [p.split()[0] for p in DECLARATION.split(", ")[:18]]
    data = [(i, r.get("ocr_confidence"), *[r.get(n) for n in names]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "scan_id long, ocr_confidence double, " + ", ".join(DECLARATION.split(", ")[:18]))


@pytest.fixture(scope="module")
def verdicts(spark):
    cases = [
        {}, {"net_quantity_value": 201.0}, {"min_numeral_height_mm": None}, {"generic_name": None},
        {"generic_name": None, "ocr_confidence": 59.9}, {"generic_name": None, "ocr_confidence": 60.0},
        {"mrp_includes_taxes": False, "ocr_confidence": 10.0}, {"net_quantity_unit": "oz"},
        {"min_numeral_height_mm": None, "min_font_height_mm": 1.0},
        {"net_quantity_unit": "nos", "panel_area_cm2": 600.0, "min_numeral_height_mm": 3.9},
    ]
    df = frame(spark, [{**GOOD, **c} for c in cases])
    folded = {r.scan_id: r.verdict for r in rules.verdicts(df).collect()}
    aggregated = {r.scan_id: r.verdict for r in rules.verdict_fold(annotate(rules.findings(df))).collect()}
    tiers = {r.scan_id: r.required_mm for r in rules.numeral_tier_join(df).collect()}
    case_tiers = {r.scan_id: r.required_mm for r in rules.with_tiers(df).select("scan_id", "required_mm").collect()}
    return folded, aggregated, tiers, case_tiers


def test_row_fold(verdicts):
    c, n, i = "COMPLIANT", "NON_COMPLIANT", "INCOMPLETE"
    assert [verdicts[0][k] for k in range(10)] == [c, n, i, n, i, n, n, n, c, n]


def test_row_fold_equals_aggregate(verdicts):
    assert verdicts[0] == verdicts[1]


def test_tier_join_equals_case(verdicts):
    assert verdicts[2] == verdicts[3]
