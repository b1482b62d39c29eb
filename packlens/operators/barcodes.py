"""Barcode identity: distinct codes, origin of the prefix, info cards and the catalog cross-check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlens import fixed_values as fv
from packlens.functions.text import strip
from packlens.operators.ordered import number_rows


def digits_of(code: Column) -> Column:
    return F.regexp_replace(code, r"\P{Nd}", "")


def gtin_dedupe(codes: DataFrame) -> DataFrame:
    """Distinct (format, text) per scan with the first position; blanks dropped."""
    clean = codes.withColumn("code", strip(F.col("text"))).where(F.col("code") != "")
    return clean.groupBy("scan_id", "format", "code").agg(F.min("pos").alias("first_pos"))


def country_of(code: Column) -> Column:
    """Country of the GS1 prefix; a constant map of fixed size stands in for a broadcast join."""
    table = F.create_map(*[F.lit(x) for pair in fv.GS1_COUNTRIES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.substring(digits_of(code), 1, 3)), F.lit("Unknown"))


def gtin_country(codes: DataFrame) -> DataFrame:
    return codes.withColumn("country", country_of(F.col("code")))


def _card(number: Column, count: Column, form: Column, code: Column, country: Column) -> dict[str, Column]:
    """An info finding: the only code of a scan has a stable id, several are numbered from 1."""
    return {
        "rule_order": (number + 9).cast("int"),
        "rule_id": F.when(count == 1, F.lit("LMPC-gtin")).otherwise(F.concat(F.lit("LMPC-gtin-"), number.cast("string"))),
        "status": F.lit(fv.PASS),
        "message": F.concat(F.lit("Barcode "), form, F.lit(" "), code, F.lit(" (GS1 prefix: "), country, F.lit(")")),
        "field": F.lit("gtin"), "citation": F.lit("GS1 prefix (voluntary identity cross-check)"), "citation_verified": F.lit(False),
        "observed": code, "expected": F.lit("consistent with declared origin"), "severity": F.lit("info"),
        "remedy": F.lit(None).cast("string"), "source_ref": F.lit(""),
    }


def cards_of(codes: Column) -> Column:
    """Info findings of one read's barcodes: array<struct<format, text>> to an array of findings, each distinct code once."""
    clean = F.filter(F.transform(codes, lambda c: F.struct(c["format"].alias("format"), strip(c["text"]).alias("code"))), lambda c: c["code"] != "")
    distinct = F.array_distinct(F.coalesce(clean, F.array().cast("array<struct<format:string,code:string>>")))
    return F.transform(distinct, lambda c, i: F.struct(*[
        v.alias(name) for name, v in _card(i + 1, F.size(distinct), c["format"], c["code"], country_of(c["code"])).items()]))


def gtin_cards(codes: DataFrame) -> DataFrame:
    """Info findings for barcodes: one stable id for a single code, numbered ids otherwise."""
    numbered = number_rows(gtin_country(gtin_dedupe(codes)), ["scan_id"], "first_pos", ["format", "code"], total="codes")
    card = _card(F.col("n"), F.col("codes"), F.col("format"), F.col("code"), F.col("country"))
    return numbered.select("scan_id", *[v.alias(name) for name, v in card.items()], F.col("n").alias("card_no"))


def results_append(findings: DataFrame, cards: DataFrame) -> DataFrame:
    """Barcode cards appended to the rule rows of a scan."""
    return findings.unionByName(cards.drop("card_no"), allowMissingColumns=True)


def catalog_cross_check(scans: DataFrame, cards: DataFrame, catalog: DataFrame, *, catalog_name: str = "Open Food Facts") -> DataFrame:
    """Agree/differ note between a scan and the public catalog entry of its first barcode."""
    first = cards.where(F.col("card_no") == 1).select("scan_id", digits_of(F.col("observed")).alias("code")).where(
        F.length("code") >= 8)
    known = catalog.select("code", F.nullif(strip(F.col("name")), F.lit("")).alias("name"),
                           F.nullif(strip(F.col("quantity")), F.lit("")).alias("quantity"))
    hit = scans.select("scan_id", "product_name", "quantity_text").join(first, "scan_id").join(known, "code").where(
        F.col("name").isNotNull() | F.col("quantity").isNotNull())

    def compare(ours: str, theirs: str, what: str) -> Column:
        same = F.contains(F.lower(ours), F.lower(theirs))
        usable = F.col(theirs).isNotNull() & (F.col(ours) != "")
        return F.when(usable, F.when(same, f"{what} matches").otherwise(f"{what} DIFFERS"))

    ref = F.concat_ws(" ", F.concat(F.lit("'"), "name", F.lit("'")), "quantity")
    both = F.concat_ws("; ", compare("product_name", "name", "name"), compare("quantity_text", "quantity", "quantity"))
    verdict = F.when(both != "", both).otherwise("compare with our read")
    return hit.select("scan_id", F.concat(
        F.lit(f"{catalog_name} lists barcode "), "code", F.lit(" as "), ref, F.lit(" ("), verdict,
        F.lit(") — verify on the physical package.")).alias("note"))
