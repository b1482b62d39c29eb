import pytest

from packlens.operators.extraction import extract_declarations

TEXTS = [
    "Mustard Oil\nAcme Foods, Plot 1, Delhi 110001\nNet Qty: 100 ml\nMRP Rs. 378.78 Inclusive of all taxes\n"
    "Mfg: 22/12/2025 Exp: 18/02/2026\nCustomer Care: care0@example.in 1800-100-000\nCountry of Origin: India",
    "Wheat Biscuits\nMRP Rs.\n50.00\nNet Wt 500 9\nManufactured by: Acme Foods Ltd\nPlot 5 MIDC\nPlot 5 MIDC\nMumbai 400001",
    "Manuiacture : December 2025\nBest before 12 months",
    "6.6g sugar nutrition information\n250 ml e",
    "MRP Rs. 12O.5O\nMfg 0l/01/2025 Exp 01.02.26",
    "",
]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(i, t, 80.0) for i, t in enumerate(TEXTS)], "scan_id long, ocr_text string, ocr_confidence double")
    return {r.scan_id: r for r in extract_declarations(df).collect()}


def test_printed_label(rows):
    r = rows[0]
    assert (r.generic_name, r.net_quantity_value, r.net_quantity_unit, r.mrp) == ("Mustard Oil", 100.0, "ml", 378.78)
    assert (str(r.mfg_date), str(r.expiry_date), r.mrp_includes_taxes) == ("2025-12-22", "2026-02-18", True)
    assert r.consumer_care == "Customer Care: care0@example.in" and not r.is_imported


def test_split_price_and_maker_block(rows):
    r = rows[1]
    assert (r.mrp, r.net_quantity_value, r.net_quantity_unit) == (50.0, 500.0, "g")
    assert (r.manufacturer_name, r.manufacturer_address) == ("Acme Foods Ltd", "Plot 5 MIDC; Mumbai 400001")


def test_near_miss_words_and_guards(rows):
    assert str(rows[2].mfg_date) == "2025-12-01" and rows[2].expiry_date is None
    assert rows[3].net_quantity_value is None
    assert rows[4].mrp == 120.5 and str(rows[4].mfg_date) == "2025-01-01" and str(rows[4].expiry_date) == "2026-02-01"
    assert rows[5].field_sources == {}


def test_first_characters_rule_no_match_out(spark):
    from pyspark.sql import functions as F

    from packlens import fixed_values as fv
    from packlens.functions import fields as ff
    from packlens.functions.text import ci

    words = ("MRP Rs. 5.00|M.R.P. 7|maximum retail price 8|retail price 9|maxim retail price 1|per 100 g|PROTÉINE|protéin|énergie|ENERGY|/ serve|servings|water|oil|butter|tomato|flour|ſalt|SALT|salt|honey|recipe|"
             "Kcal|kcal|ıngredients|İngredients|ingrédient|%RDA|valeur nutritionnelle|nutrition information|mfg 01/02/2024|meg 1/2024|packed: June 2024|pkd 2024/01|mfd 2024/01|exp 01/02/24|best before 6 months|"
             "UſE BY June 2024|use by June 2024|customer care a@b.in|conſumer care 1800 11|helpline 1800 22|toll free +91 12345 6|net qty 5 g|det wt 6 kg|nct vol 7 ml|manufactured by|mktd by|regd. office|registered office|"
             "mfd for|batch|fſſai|lic no|care|net q|exp|keep|store|dispose|litter|recycle|under brand|brand licence|do not|lot|contents|ingredients|cup|tbsp|x|1|").split("|")
    texts = spark.createDataFrame([(f"{before}{w}{after}",) for w in words for before in ("", "a ", "aa", "7") for after in ("", " z", "12")], "t string")
    kinds = [n.removeprefix("GATED_") for n in vars(ff) if n.startswith("GATED_")]
    assert {"MRP", "NUTRITION", "MFG", "EXP", "MAKER_ANCHOR"} <= set(kinds)
    found = lambda p: F.regexp_extract_all("t", F.lit(ci(p)), F.lit(0))
    rows = texts.select([F.struct(found(getattr(fv, f"P_{k}")).alias("plain"), found(getattr(ff, f"GATED_{k}")).alias("gated")).alias(k) for k in kinds]).collect()
    assert all(r[k]["plain"] == r[k]["gated"] for r in rows for k in kinds)
    assert all(any(r[k]["plain"] for r in rows) for k in kinds)
