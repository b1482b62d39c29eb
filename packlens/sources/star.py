"""Label tables derived from a star schema and an event stream.

Every view is a narrow chain of DataFrame steps over parquet tables, so column pruning and filter
pushdown reach the scan. Only constant tables are broadcast; every other side is left to the optimizer,
which checks sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens import fixed_values as fv
from packlens.functions.text import lines_of, short_number, two_decimals
from packlens.operators import rules

UNIT_CYCLE = ("g", "ml", "g", "kg", "l", "mg", "pcs", "cm", "g", "ml", "nos", "oz")
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")


def tasks_for(df: DataFrame) -> int:
    """How many tasks an input is worth: several per core so that none is waited for long, and more as it grows past that.

    The size comes from the file listing. Splits of files do not tell: one file may be one row group however large, and
    partitions that are merged by their bytes are too few for work that grows out of a few narrow columns.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, min(size // 32768, 8 * cores), size >> 23)


def spread(df: DataFrame) -> DataFrame:
    """The input in as many even partitions as it is worth tasks."""
    return df.repartition(tasks_for(df))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(df) if table == "documents" else df


def _drop_every(key: Column, n: int, value: Column) -> Column:
    return F.when(key % n != 0, value)


def first_lines(lineitem: DataFrame) -> DataFrame:
    """First line per order. An aggregate, not a window: it combines before the shuffle."""
    order = [F.col(c) for c in LINE_ORDER]
    rest = [F.col(c) for c in ("l_quantity", "l_discount", "l_tax", "l_linestatus")]
    return (
        lineitem.groupBy("l_orderkey")
        .agg(F.min(F.struct(*order, *rest)).alias("l1"))
        .select("l_orderkey", "l1.*")
    )


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One declaration per order."""
    k = F.col("o_orderkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    joined = (
        orders.repartition(tasks_for(orders), "o_orderkey")  # the join's own shuffle, in a number of tasks that suits the labels' work
        .join(first_lines(read(spark, sf_dir, "lineitem")), k == F.col("l_orderkey"), "left")
        .join(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"),
              F.col("l_partkey") == F.col("p_partkey"), "left")
        .join(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"),
              F.col("l_suppkey") == F.col("s_suppkey"), "left")
        .join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    )
    units = F.array(*[F.lit(u) for u in UNIT_CYCLE])
    care = F.concat(F.lit("care"), k.cast("string"), F.lit("@example.in 1800-100-"),
                    F.lpad((k % 1000).cast("string"), 3, "0"))
    size = F.col("p_size").cast("double")
    return joined.select(
        k.alias("scan_id"),
        F.col("o_custkey").alias("owner_id"),
        F.col("o_orderdate").alias("created_at"),
        _drop_every(k, 37, F.col("s_name")).alias("manufacturer_name"),
        _drop_every(k, 41, F.col("n_name")).alias("manufacturer_address"),
        _drop_every(k, 31, F.col("p_name")).alias("generic_name"),
        _drop_every(k, 29, size * 20).alias("net_quantity_value"),
        F.get(units, (k % 12).cast("int")).alias("net_quantity_unit"),
        _drop_every(k, 43, F.col("p_retailprice")).alias("mrp"),
        F.coalesce(F.col("l_tax") > 0.005, F.lit(False)).alias("mrp_includes_taxes"),
        _drop_every(k, 47, F.col("o_orderdate").cast("date")).alias("mfg_date"),
        F.col("l_shipdate").cast("date").alias("expiry_date"),
        _drop_every(k, 23, care).alias("consumer_care"),
        _drop_every(k, 19, F.col("n_name")).alias("country_of_origin"),
        F.coalesce(F.col("n_regionkey") != 2, F.lit(False)).alias("is_imported"),
        _drop_every(k, 5, F.col("l_quantity") / 10).alias("min_numeral_height_mm"),
        _drop_every(k, 5, F.col("l_quantity") / 15).alias("min_letter_height_mm"),
        F.lit(None).cast("double").alias("min_font_height_mm"),
        F.coalesce(F.col("l_linestatus") == "F", F.lit(False)).alias("is_embossed"),
        _drop_every(k, 11, size * 60).alias("panel_area_cm2"),
        _drop_every(k, 7, F.col("l_discount") * 10).alias("min_width_to_height_ratio"),
        _drop_every(k, 9, ((k * 37) % 101).cast("double")).alias("ocr_confidence"),
    )


def document_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents form one scan; each document is one captured frame with its whole text."""
    d = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(
        F.expr("doc_id div 3").alias("scan_id"),
        (d % 3).cast("int").alias("frame_index"),
        ((d * 37) % 101).cast("double").alias("ocr_confidence"),
        F.col("text"),
    )


def order_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as frames of one scan (numbers only); the frame index follows the line order.

    Orders hold a handful of lines, so the numbering sorts a small array per order after a combining
    aggregate.
    """
    cols = [F.col(c) for c in (*LINE_ORDER, "l_quantity", "l_discount", "l_tax")]
    packed = (
        read(spark, sf_dir, "lineitem").groupBy("l_orderkey")
        .agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("ls"))
        .select("l_orderkey", F.posexplode("ls").alias("i", "l"))
    )
    q = F.col("l.l_quantity")
    return packed.select(
        F.col("l_orderkey").alias("scan_id"),
        F.col("i").alias("frame_index"),
        F.least(F.round(F.col("l.l_discount") * 1000), F.lit(100.0)).alias("ocr_confidence"),
        (F.lit(20) + F.col("l.l_partkey") % 50).cast("int").alias("text_length"),
        F.when(q > 10, F.round(q / 12, 2)).alias("font_mm"),
        (F.col("l.l_suppkey") % 7 != 0).alias("has_boxes"),
        (F.col("l.l_partkey") % 11 != 0).alias("has_blob"),
        F.col("l.l_partkey").alias("part_id"),
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word boxes of every document line; one document is one scan.

    Texts are dealt by scan before they become words, which are many times as large: later steps by scan shuffle nothing.
    """
    token = F.col("token")
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("scan_id"), "text")
    texts = texts.repartition(tasks_for(texts), "scan_id")
    lines = texts.select(
        "scan_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    tokens = lines.select(
        "scan_id", "line_no",
        F.posexplode(F.filter(F.split("line", " "), lambda t: t != "")).alias("token_no", "token"))
    return tokens.select(
        "scan_id",
        (F.col("line_no").cast("long") * 100_000 + F.col("token_no")).alias("ord"),
        F.col("line_no"),
        token.alias("text"),
        (F.col("token_no") * 120).alias("x"),
        (F.col("line_no") * 35 + F.col("token_no") % 3).alias("y"),
        (F.length(token) * 10).alias("w"),
        (F.col("token_no") % 3 + 20).alias("h"),
        ((F.col("scan_id") + F.col("line_no") * 7 + F.col("token_no") * 37) % 104 - 3)
        .cast("double").alias("confidence"),
    )


def _date_text(d: Column, k: Column) -> Column:
    style = k % 10
    month = F.get(F.array(*[F.lit(m) for m in fv.MONTHS]), F.month(d) - 1)
    numeric = F.date_format(d, "dd/MM/yyyy")
    return (
        F.when(style < 6, numeric)
        .when(style < 8, F.concat(F.upper(F.substring(month, 1, 3)), F.lit(" "), F.year(d).cast("string")))
        .otherwise(F.concat(month, F.lit(" "), F.year(d).cast("string")))
    )


def with_label(decl: DataFrame, *, violation: Column | None = None) -> DataFrame:
    """Add the label text of a declaration, with an optional injected violation per row."""
    k = F.col("scan_id")
    if violation is None:
        kinds = F.array(*[F.lit(v) for v in fv.VIOLATIONS])
        violation = F.when(k % 4 == 0, F.get(kinds, (F.floor(k / 4) % len(fv.VIOLATIONS)).cast("int")))
    df = decl.withColumn("violation", violation)

    def unless(kind: str, value: Column) -> Column:
        return F.when(~F.col("violation").eqNullSafe(kind), value)

    tax = F.when(F.col("mrp_includes_taxes") & ~F.col("violation").eqNullSafe("missing_tax_phrase"),
                 F.lit(" Inclusive of all taxes")).otherwise("")
    maker = F.when(
        F.col("manufacturer_name").isNotNull(),
        F.concat_ws(", ", "manufacturer_name", F.concat(F.lit("Plot "), (k + 1).cast("string")),
                    "manufacturer_address"))
    dates = F.concat_ws(" ", F.concat(F.lit("Mfg: "), _date_text(F.col("mfg_date"), k)),
                        F.concat(F.lit("Exp: "), _date_text(F.col("expiry_date"), k)))
    lines = [
        F.col("generic_name"),
        maker,
        unless("missing_netqty", F.concat(F.lit("Net Qty: "), short_number(F.col("net_quantity_value")),
                                          F.lit(" "), F.col("net_quantity_unit"))),
        unless("missing_mrp", F.concat(F.lit("MRP Rs. "), two_decimals(F.col("mrp")), tax)),
        unless("missing_dates", F.nullif(dates, F.lit(""))),
        unless("missing_care", F.concat(F.lit("Customer Care: "), F.col("consumer_care"))),
        F.concat(F.lit("Country of Origin: "), F.col("country_of_origin")),
    ]
    return df.withColumn("ocr_text", F.concat_ws("\n", *lines))


def compose_label(decl: DataFrame, *, violation: Column | None = None) -> DataFrame:
    """Label text per scan."""
    return with_label(decl, violation=violation).select("scan_id", "ocr_text", "ocr_confidence", "violation")


def label_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose_label(declarations(spark, sf_dir))


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored scan rows: text, verdict, workflow state and product identity, without image columns."""
    k = F.col("scan_id")
    labelled = with_label(declarations(spark, sf_dir))
    judged = rules.verdicts(labelled, "owner_id", "created_at", "ocr_text", "generic_name", "manufacturer_name",
                            "min_numeral_height_mm")
    final = k % 4 == 1
    return judged.select(
        "scan_id", "owner_id", "created_at", "ocr_text", "ocr_confidence", "verdict", "compliant", "warnings",
        F.when(final, "final").otherwise("pending_review").alias("status"),
        F.when(k % 3 == 0, "tesseract").when(k % 3 == 1, "florence-2").otherwise("tesseract+merge3")
        .alias("ocr_engine"),
        F.when(k % 10 != 0, F.col("generic_name")).alias("product_name"),
        F.when(k % 10 != 1, F.col("manufacturer_name")).alias("brand_name"),
        F.when(k % 5 == 0, "food").when(k % 5 == 1, "").when(k % 5 == 2, " home ").alias("category"),
        F.when(k % 6 != 0, (k * 7 % 2000) / 10 - 100).alias("scan_lat"),
        F.when(k % 8 != 0, (k * 13 % 4001) / 11 - 182).alias("scan_lon"),
        F.when(final, F.concat(F.lit("officer"), (k % 20).cast("string"))).alias("reviewed_by"),
        F.when(final, F.col("created_at") + F.expr("INTERVAL '26' HOUR")).alias("reviewed_at"),
        F.when(final & (k % 8 == 1), "seen on pack").otherwise("").alias("review_notes"),
        (final & (k % 8 == 1)).alias("overridden"),
        F.col("min_numeral_height_mm").alias("font_height_mm"),
    )


def field_sources(decl: DataFrame) -> DataFrame:
    """Declarations with a provenance map; the source of a field varies with the scan."""
    kinds = F.array(*[F.lit(s) for s in ("read", "inferred", "ai_assist", "uncertain", "attested", "read", "read")])
    pairs = [F.struct(F.lit(f).alias("key"), F.get(kinds, ((F.col("scan_id") + 3 * i) % 7).cast("int")).alias("value"))
             for i, f in enumerate(fv.TRACKED_FIELDS)]
    kept = [F.when(F.col(f).isNotNull(), p) for f, p in zip(fv.TRACKED_FIELDS, pairs, strict=True)]
    return decl.withColumn("field_sources", F.map_from_entries(F.filter(F.array(*kept), lambda e: e.isNotNull())))


def order_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the number of orders, used to map events onto scans."""
    return read(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n_orders"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Officer actions from the event stream."""
    kinds = F.create_map(*[F.lit(x) for pair in (
        ("click", "attest"), ("error", "dispute"), ("view", "withdraw"),
        ("purchase", "confirm"), ("signup", "override")) for x in pair])
    ev = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    rules = F.array(*[F.lit(r) for r in fv.RULE_IDS])
    return ev.crossJoin(F.broadcast(order_count(spark, sf_dir))).select(
        "event_id",
        (F.col("event_id") % F.col("n_orders")).alias("scan_id"),
        F.get(rules, (F.col("event_id") % len(fv.RULE_IDS)).cast("int")).alias("rule_id"),
        F.element_at(kinds, F.col("event_type")).alias("action"),
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("seen "), F.col("event_id").cast("string")))
        .alias("observed"),
        F.col("user_id").cast("string").alias("by"),
        F.when(F.col("event_id") % 5 == 0, "").otherwise(
            F.concat(F.lit("note "), F.col("event_id").cast("string"))).alias("notes"),
        F.when(F.col("user_id") % 2 == 0, "admin").otherwise("officer").alias("role"),
        F.col("ts").alias("at"),
        F.col("value"),
    )


GTIN_PREFIXES = tuple(sorted(fv.GS1_COUNTRIES))[:40] + ("123", "999")


def barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded barcodes: each line item contributes its part's code; repeats occur."""
    prefixes = F.array(*[F.lit(p) for p in GTIN_PREFIXES])
    frames = order_frames(spark, sf_dir)
    part = F.col("part_id")
    code = F.concat(F.get(prefixes, (part % len(GTIN_PREFIXES)).cast("int")),
                    F.lpad(part.cast("string"), 9, "0"), F.lit("0"))
    return frames.select(
        "scan_id", F.col("frame_index").alias("pos"),
        F.when(part % 3 == 0, "EAN8").otherwise("EAN13").alias("format"),
        F.when(part % 17 == 0, "  ").otherwise(F.concat(F.lit(" "), code)).alias("text"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product catalog keyed by barcode digits."""
    prefixes = F.array(*[F.lit(p) for p in GTIN_PREFIXES])
    part = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        F.concat(F.get(prefixes, (part % len(GTIN_PREFIXES)).cast("int")),
                 F.lpad(part.cast("string"), 9, "0"), F.lit("0")).alias("code"),
        F.when(part % 13 != 0, F.upper(F.split("p_name", " ")[0])).alias("name"),
        F.when(part % 5 != 0, F.concat((F.col("p_size") * 20).cast("string"), F.lit(" G"))).alias("quantity"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("brand"),
    )
