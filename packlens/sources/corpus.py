"""Readers and writers of the labelling corpus, with explicit schemas (no inference pass)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from packlens.functions.text import strip

LABEL_ROW = (
    "image STRING, lines ARRAY<STRING>, truth STRUCT<generic_name: STRING, violation: STRING, net_quantity_value: DOUBLE, "
    "net_quantity_unit: STRING, mrp: DOUBLE, mfg: STRING, exp: STRING>")
DECLARATION = (
    "manufacturer_name STRING, manufacturer_address STRING, generic_name STRING, net_quantity_value DOUBLE, net_quantity_unit STRING, "
    "mrp DOUBLE, mrp_includes_taxes BOOLEAN, mfg_date DATE, expiry_date DATE, consumer_care STRING, country_of_origin STRING, "
    "is_imported BOOLEAN, min_numeral_height_mm DOUBLE, min_letter_height_mm DOUBLE, min_font_height_mm DOUBLE, is_embossed BOOLEAN, "
    "panel_area_cm2 DOUBLE, min_width_to_height_ratio DOUBLE, field_sources MAP<STRING, STRING>")
PRELABEL_ROW = f"image STRING, text STRING, confidence DOUBLE, declaration STRUCT<{', '.join(p.replace(' ', ': ', 1) for p in DECLARATION.split(', ')[:18])}>"
TRUTH_ROW = (
    "image STRING, truth STRUCT<generic_sub: STRING, net_quantity_value: DOUBLE, net_quantity_unit: STRING, mrp: DOUBLE, mfg: BOOLEAN, "
    "exp: BOOLEAN, manufacturer_sub: STRING, consumer_care: BOOLEAN>, absent ARRAY<STRING>, notes STRING")
STUDIO_EXPORT = (
    "text STRING, annotations ARRAY<STRUCT<result: ARRAY<STRUCT<type: STRING, value: STRUCT<start: INT, `end`: INT, labels: ARRAY<STRING>>>>>>")
FINDING = (
    "STRUCT<rule_id: STRING, status: STRING, message: STRING, field: STRING, citation: STRING, citation_verified: BOOLEAN, source_ref: STRING, "
    "observed: STRING, expected: STRING, severity: STRING, remedy: STRING, manual: BOOLEAN, cause: STRING, why: STRING, next_steps: ARRAY<STRING>>")


def _limited(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def label_corpus(spark: SparkSession, path: str, *, limit: int | None = None) -> DataFrame:
    return _limited(spark.read.schema(LABEL_ROW).json(path), limit)


def prelabels(spark: SparkSession, path: str, *, limit: int | None = None) -> DataFrame:
    """Prelabel rows; broken lines land in ``_corrupt_record`` instead of failing the job."""
    reader = spark.read.schema(PRELABEL_ROW + ", _corrupt_record STRING").option("mode", "PERMISSIVE")
    return _limited(reader.json(path), limit)


def eval_truth(spark: SparkSession, path: str, *, limit: int | None = None) -> DataFrame:
    """Truth rows; ``manufacturer_sub`` may be one string or a list and becomes a list."""
    rows = spark.read.schema(TRUTH_ROW).json(path)
    sub = F.col("truth.manufacturer_sub")
    makers = F.when(sub.startswith("["), F.from_json(sub, "array<string>")).when(sub.isNotNull(), F.array(sub))
    return _limited(rows.withColumn("makers", makers), limit)


def gazetteer_lists(spark: SparkSession, names_path: str, brands_path: str, *, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """The two name lists as (raw, pos); rows that do not parse are skipped."""
    names = spark.read.schema("names ARRAY<STRING>").option("multiLine", str(multi_line).lower()).json(names_path).select(
        F.posexplode("names").alias("pos", "raw"))
    brands = spark.read.schema("brand STRING").json(brands_path).select(
        F.monotonically_increasing_id().alias("pos"), F.col("brand").alias("raw"))
    return tuple(d.where(F.col("raw").isNotNull()) for d in (names, brands))


def labelstudio_spans(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """Label spans of a nested export: (text, start, end, labels)."""
    tasks = spark.read.schema(STUDIO_EXPORT).option("multiLine", str(multi_line).lower()).json(path)
    results = tasks.select("text", F.explode("annotations").alias("a")).select("text", F.explode("a.result").alias("r"))
    return results.where(F.col("r.type") == "labels").select(
        "text", F.col("r.value.start").alias("start"), F.col("r.value.end").alias("end"),
        F.coalesce("r.value.labels", F.array().cast("array<string>")).alias("labels"))


def write_jsonl(df: DataFrame, path: str, *, order_by: str | None = None) -> None:
    """JSON lines; brand lists are written in case-insensitive order (ties: as they stand) through a range partitioning."""
    (df.orderBy(F.lower(order_by), order_by) if order_by else df).write.mode("errorifexists").json(path)


def read_in_order(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Written JSON lines with ``line_no``, their place over all files in order of name: what a reader of the files one after another would see."""
    here = ["__file", "__split"]
    rows = spark.read.schema(schema).json(path).select(
        "*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__at"))
    before = F.sum("__n").over(W.orderBy(*here).rowsBetween(W.unboundedPreceding, -1))
    # One row per split of a file, so this window is small however long the files are.
    splits = rows.groupBy(*here).agg(F.count(F.lit(1)).alias("__n")).select(*here, F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy(*here).orderBy("__at"))
    return rows.withColumn("__in", inside).join(splits, here).withColumn("line_no", F.col("__before") + F.col("__in") - 1).drop(*here, "__at", "__in", "__before")


def labelstudio_tasks(rows: DataFrame, *, prefix: str = "") -> DataFrame:
    """Prelabels as annotation tasks; relative image names get the prefix."""
    name = F.coalesce("image", F.lit(""))
    if prefix:
        name = F.when(name.rlike("^(https?://|/)"), name).otherwise(F.concat(F.lit(prefix.rstrip("/") + "/"), name))
    return rows.select(F.struct(name.alias("image"), F.coalesce("text", F.lit("")).alias("text"),
                                F.coalesce("confidence", F.lit(0.0)).alias("ocr_confidence")).alias("data"))


def to_snapshot(decl: DataFrame) -> DataFrame:
    """Declaration columns packed as JSON with ISO dates."""
    names = [p.split()[0] for p in DECLARATION.split(", ") if p.split()[0] in decl.columns]
    return decl.select("scan_id", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("declaration_json"))


def from_snapshot(rows: DataFrame) -> DataFrame:
    """Declarations back from JSON: unknown keys dropped, corrupt text gives a blank row."""
    return rows.select("scan_id", F.from_json("declaration_json", DECLARATION).alias("d")).select("scan_id", "d.*")


def _elements(text: Column) -> Column:
    """The elements of a JSON list, each as text; null if the whole is no list."""
    return F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>"))


def findings_backfill(rows: DataFrame) -> DataFrame:
    """Findings stored by older versions: missing keys get defaults, ``passed`` follows the status.

    Every element is read by itself and one that is no object is left out; a scan without any readable finding stays as one row
    without a rule.
    """
    objects = F.filter(_elements(F.col("results_json")), lambda e: F.ltrim(e).startswith("{"))
    read = F.filter(F.transform(objects, lambda e: F.from_json(e, FINDING)), lambda r: r.isNotNull())
    stored = rows.select("scan_id", F.explode_outer(read).alias("r"))
    text = {c: F.coalesce(F.col(f"r.{c}"), F.lit("")) for c in ("message", "field", "citation", "source_ref", "cause", "why")}
    status = F.coalesce("r.status", F.lit("PASS"))
    return stored.select(
        "scan_id", F.col("r.rule_id").alias("rule_id"), status.alias("status"), (status == "PASS").alias("passed"),
        *[v.alias(k) for k, v in text.items()],
        F.coalesce("r.citation_verified", F.lit(False)).alias("citation_verified"), "r.observed", "r.expected",
        F.coalesce("r.severity", F.lit("info")).alias("severity"), "r.remedy", F.coalesce("r.manual", F.lit(False)).alias("manual"),
        F.coalesce("r.next_steps", F.array().cast("array<string>")).alias("next_steps"))


def boxes_backfill(rows: DataFrame, *, cap: int = 500) -> DataFrame:
    """Stored word boxes: absent numbers are 0; boxes with null or unreadable numbers, and what is no box, are skipped."""
    box = rows.select("scan_id", F.explode(F.slice(_elements(F.col("boxes_json")), 1, cap)).alias("e")).where(F.ltrim("e").startswith("{"))
    box = box.select("scan_id", F.from_json("e", "map<string,string>").alias("m"))

    def number(name: str) -> Column:
        return F.when(F.map_contains_key("m", name), F.col("m")[name]).otherwise(F.lit("0")).try_cast("double")

    out = box.select("scan_id", F.coalesce(F.col("m")["text"], F.lit("")).alias("text"), *[number(c).alias(c) for c in ("x", "y", "w", "h", "confidence")])
    return out.where("x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL AND h IS NOT NULL AND confidence IS NOT NULL").withColumns(
        {c: F.col(c).cast("int") for c in ("x", "y", "w", "h")})


def panel_manifest(products: DataFrame, *, limit: int) -> DataFrame:
    """One row per product and panel that has an image; full-size URL; at most twice the limit."""
    panels = F.array(F.struct(F.lit("ingredients").alias("panel"), F.col("image_ingredients_url").alias("url")),
                     F.struct(F.lit("nutrition").alias("panel"), F.col("image_nutrition_url").alias("url")))
    rows = products.select("code", "product_name", F.inline(panels)).where(F.coalesce("url", F.lit("")) != "")
    return rows.select("code", F.coalesce("product_name", F.lit("")).alias("product_name"), "panel",
                       F.replace("url", F.lit(".400.jpg"), F.lit(".full.jpg")).alias("image_url")).orderBy("code", "panel").limit(limit * 2)


def packaging_manifest(manifest: DataFrame, products: DataFrame, *, limit: int) -> DataFrame:
    """Existing rows plus products that have a packaging image and are not listed yet, up to the limit."""
    have = manifest.select("code", "image_url", F.lit(0).alias("later"))
    new = products.where(F.coalesce("image_packaging_url", F.lit("")) != "").join(manifest.select("code"), "code", "left_anti").select(
        "code", F.replace("image_packaging_url", F.lit(".400.jpg"), F.lit(".full.jpg")).alias("image_url"), F.lit(1).alias("later"))
    return have.unionByName(new).orderBy("later", "code").limit(limit).drop("later")


def distinct_brands(products: DataFrame) -> DataFrame:
    """Brands of comma lists with the first product that named them; ``pos`` orders the products."""
    brand = products.select("pos", "code", "product_name", F.posexplode(F.split("brands", ",")).alias("n", "raw")).withColumn(
        "brand", F.btrim(F.regexp_replace(strip(F.col("raw")), r"(?U)\s+", " "))).where(F.length("brand") >= 3)
    return brand.groupBy("brand").agg(F.min(F.struct("pos", "n", F.coalesce("product_name", F.lit("")).alias("example"), "code")).alias("f")).select(
        "brand", "f.example", "f.code")
