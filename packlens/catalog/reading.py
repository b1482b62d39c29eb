"""Queries that turn text into declarations and score them."""

from __future__ import annotations

from pyspark.sql import functions as F

from packlens.catalog.compliance import _MISSED_SQL, _WARN_SQL
from packlens.catalog.oracle_views import LABEL_TEXT, TIERED, with_views
from packlens.catalog.registry import Registry
from packlens.functions import fields as ff
from packlens.functions.dates import parse_label_date
from packlens.functions.text import plain_number, stage
from packlens.operators import extraction as ex
from packlens.operators import rules, scoring
from packlens.plans.merge import merge_scan
from packlens.sources import star

R = Registry()
_LABELS = with_views("SELECT scan_id, ocr_text AS text FROM label_text", "label_text")
# Short month names are close enough to their four-letter full names to be completed.
_COMPLETED = with_views(
    r"SELECT scan_id, regexp_replace(regexp_replace(ocr_text, '\bJUN (20\d\d)', 'June \1', 'g'), '\bJUL (20\d\d)', 'July \1', 'g') AS text FROM label_text", "label_text")


def _garbled(spark, d, build):
    return star.label_text(spark, d).withColumn("ocr_text", build(F.col("ocr_text")))


@R.add("compose_label", with_views("SELECT scan_id, violation, ocr_text FROM label_text", "label_text"))
def compose_label(spark, d):
    return star.label_text(spark, d).select("scan_id", "violation", "ocr_text")


# Each repair runs on labels damaged in the way it mends; the undamaged label is the expected result.
def _bad_months(t):
    return F.regexp_replace(F.regexp_replace(t, r"ary (20\d{2})", "arv  $1"), r"mber (20\d{2})", "mder $1")


def _bad_units(t):
    return F.regexp_replace(F.regexp_replace(t, r"(Net Qty: \d+) g(\n|$)", "$1 q$2"), r"(Net Qty: \d+) ml", "$1 m1")


def _bad_price(t):
    return F.regexp_replace(t, r"(MRP Rs\. \d+)0\.(\d)0", "$1O.$2o")


def _bad_dates(t):
    return F.regexp_replace(F.regexp_replace(t, r"0(\d)/(\d\d)/(\d{4})", "O$1-$2-$3"), r"(\d)1/(\d\d)/(\d{4})", "$1l.$2.$3")


@R.add("fix_month_tokens", _COMPLETED)
def fix_month_tokens(spark, d):
    raw = _garbled(spark, d, _bad_months)
    df = stage(raw, cand=ff.month_candidates(F.col("ocr_text"))).withColumn("months", ff.closest_months(F.col("cand")))
    return df.select("scan_id", ff.fix_month_tokens(F.col("ocr_text"), F.col("cand"), F.col("months")).alias("text"))


@R.add("fix_qty_units", _LABELS)
def fix_qty_units(spark, d):
    return _garbled(spark, d, _bad_units).select("scan_id", ff.fix_qty_units(F.col("ocr_text")).alias("text"))


@R.add("fix_mrp_digits", _LABELS)
def fix_mrp_digits(spark, d):
    return _garbled(spark, d, _bad_price).select("scan_id", ff.fix_mrp_digits(F.col("ocr_text")).alias("text"))


@R.add("fix_date_tokens", _LABELS)
def fix_date_tokens(spark, d):
    return _garbled(spark, d, _bad_dates).select("scan_id", ff.fix_date_tokens(F.col("ocr_text")).alias("text"))


@R.add("normalize_text", _COMPLETED)
def normalize_text(spark, d):
    damaged = _garbled(spark, d, lambda t: _bad_dates(_bad_price(_bad_units(_bad_months(t)))))
    return ex.normalize_text(damaged).select("scan_id", "text")


@R.add("normalize_documents")
def normalize_documents(spark, d):
    docs = star.read(spark, d, "documents").select("doc_id", F.col("text").alias("ocr_text"))
    return ex.normalize_text(docs).select("doc_id", F.length("text").alias("n"), (F.col("text") != F.col("ocr_text")).cast("int").alias("changed"))


_SPARK_FORMS = ("dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "dd/MM/yy", "dd/MMM/yyyy", "dd-MMM-yy", "yyyy-MM-dd", "MMM yyyy", "MMMM yyyy", "MM/yyyy", "MM-yy", "dd-MM-yy", "yyyy/MM")


@R.add("parse_label_date", "SELECT o_orderkey AS scan_id, CASE WHEN o_orderkey % 13 = 12 THEN NULL WHEN o_orderkey % 13 < 7 THEN strftime(o_orderdate, '%Y-%m-%d') "
       "ELSE strftime(o_orderdate, '%Y-%m-01') END AS parsed FROM orders")
def parse_label_date_query(spark, d):
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.date_format(day, _SPARK_FORMS[0])
    for i, form in enumerate(_SPARK_FORMS):
        text = F.when(k % len(_SPARK_FORMS) == i, F.date_format(day, form)).otherwise(text)
    upper = F.when(k % 2 == 0, F.upper(text)).otherwise(text)
    return star.read(spark, d, "orders").select(k.alias("scan_id"), parse_label_date(F.concat(F.lit(" "), upper)).cast("string").alias("parsed"))


@R.add("quantity_number", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 2 = 0 THEN NULLIF(CASE WHEN l_partkey * 31 > 9999 THEN l_partkey * 31 % 1000 ELSE l_partkey * 31 END, 0)
  ELSE l_partkey * 31 + 0.5 END::DOUBLE AS quantity, CAST(l_partkey * 1000 + 0.25 AS DOUBLE) AS price FROM lineitem""")
def quantity_number(spark, d):
    p = F.col("l_partkey")
    n = (p * 31).cast("string")
    raw = F.when(p % 2 == 0, F.concat(F.lit("00"), n)).otherwise(F.concat(n, F.lit(".5")))
    price = F.concat(F.format_number(p * 1000, 0), F.lit(".25"))
    return star.read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", ff.quantity_number(raw).alias("quantity"), plain_number(price).alias("price"))


_PARSED = r"""
SELECT scan_id, ocr_confidence, violation, mrp, contains(ocr_text, 'Inclusive of all taxes') AS taxes, qty, unit, COALESCE(mfg, CASE WHEN contains(exp_text, '/') THEN exp END) AS mfg, exp,
  'Customer Care: ' || NULLIF(regexp_extract(ocr_text, 'care\d+@example\.in'), '') AS care, origin, maker, ocr_text,
  COALESCE(list_filter(cand, lambda l: length(regexp_replace(l, '[^A-Za-z]', '', 'g')) >= 8)[1], cand[1]) AS generic
FROM (SELECT *, CASE WHEN contains(mfg_text, '/') THEN strptime(mfg_text, '%d/%m/%Y') WHEN mfg_text <> '' THEN COALESCE(try_strptime('1 ' || mfg_text, '%d %B %Y'), try_strptime('1 ' || mfg_text, '%d %b %Y')) END::DATE AS mfg,
    CASE WHEN contains(exp_text, '/') THEN strptime(exp_text, '%d/%m/%Y') WHEN exp_text <> '' THEN COALESCE(try_strptime('1 ' || exp_text, '%d %B %Y'), try_strptime('1 ' || exp_text, '%d %b %Y')) END::DATE AS exp
  FROM (SELECT *, TRY_CAST(NULLIF(regexp_extract(ocr_text, 'MRP Rs\. (\d+\.\d\d)', 1), '') AS DOUBLE) AS mrp,
    TRY_CAST(NULLIF(regexp_extract(ocr_text, 'Net Qty: ([\d.]+) (g|ml|kg|l|mg|pcs|cm|nos)\b', 1), '') AS DOUBLE) AS qty,
    rtrim(NULLIF(regexp_extract(ocr_text, 'Net Qty: ([\d.]+) (g|ml|kg|l|mg|pcs|cm|nos)\b', 2), ''), 's') AS unit,
    regexp_extract(ocr_text, 'Mfg: ([A-Za-z]+ \d{4}|\d\d/\d\d/\d{4})', 1) AS mfg_text, regexp_extract(ocr_text, 'Exp: ([A-Za-z]+ \d{4}|\d\d/\d\d/\d{4})', 1) AS exp_text,
    NULLIF(regexp_extract(ocr_text, 'Country of Origin: ([A-Za-z ]{2,30})', 1), '') AS origin,
    list_filter(string_split(ocr_text, chr(10)), lambda l: regexp_matches(l, '\bPlot\b'))[1] AS maker,
    list_filter(string_split(ocr_text, chr(10)), lambda l: l <> '' AND NOT regexp_matches(l, '^(MRP|Mfg|Exp|Customer Care|Country|Net Qty.* (g|ml|kg|l|mg|pcs|cm|nos)$)')) AS cand FROM label_text))
"""


def _parsed(body: str, *more: str) -> str:
    return with_views(body, "parsed", *more, replaced={"parsed": (_PARSED, ("label_text",))})


def _lines(spark, d):
    return ex.with_lines(star.label_text(spark, d).withColumn("text", F.col("ocr_text")))


@R.add("extract_mrp", _parsed("SELECT scan_id, mrp FROM parsed"))
def extract_mrp(spark, d):
    return _lines(spark, d).select("scan_id", ff.extract_mrp(F.col("text"), F.col("lines")).alias("mrp"))


@R.add("tax_phrase", _parsed("SELECT scan_id, CAST(taxes AS INTEGER) AS taxes FROM parsed"))
def tax_phrase(spark, d):
    return star.label_text(spark, d).select("scan_id", ff.tax_phrase(F.col("ocr_text")).cast("int").alias("taxes"))


@R.add("extract_quantity", _parsed("SELECT scan_id, qty, unit FROM parsed"))
def extract_quantity(spark, d):
    best = stage(star.label_text(spark, d), q=ff.best_quantity(ff.quantity_candidates(F.col("ocr_text"))))
    return best.select("scan_id", F.col("q.value").alias("qty"), F.col("q.unit").alias("unit"))


@R.add("qty_candidates")
def qty_candidates(spark, d):
    """Candidates of labels and documents with their score and rank."""
    texts = star.label_text(spark, d).select(F.col("scan_id").alias("id"), F.col("ocr_text").alias("text")).unionByName(
        star.read(spark, d, "documents").select((-F.col("doc_id")).alias("id"), "text"))
    rows = stage(texts, c=ff.quantity_candidates(F.col("text"))).select("id", F.posexplode("c").alias("seen", "q"))
    return rows.select("id", "seen", F.col("q.score").alias("score"), F.col("q.value").alias("value"), F.col("q.unit").alias("unit"))


@R.add("extract_dates", _parsed("SELECT scan_id, CAST(mfg AS VARCHAR) AS mfg, CAST(exp AS VARCHAR) AS exp FROM parsed"))
def extract_dates(spark, d):
    return ex.with_dates(_lines(spark, d)).select(
        "scan_id", F.col("mfg_date").cast("string").alias("mfg"), F.col("expiry_date").cast("string").alias("exp"))


@R.add("extract_care", _parsed("SELECT scan_id, care FROM parsed"))
def extract_care(spark, d):
    return star.label_text(spark, d).select("scan_id", ff.extract_care(F.col("ocr_text")).alias("care"))


_WORD = r"[\p{L}\p{N}_+\-.]+"
_CONTACT_SQL = rf"{_WORD} ?@{{1,2}} ?[a-z\d\-.]+ ?\.[a-z]{{2,}}|\+?91[\s\-]*\d[\d\s\-]{{4,}}|1800[\s\-]*\d[\d\s\-]*"
_BARE_SQL = rf"{_WORD} ?@{{1,2}} ?[a-z\d\-.]+ ?\.[a-z]{{2,}}|1800[\s\-]*\d[\d\s\-]{{4,}}"


@R.add("extract_care_documents", rf"""SELECT doc_id, substr(trim(COALESCE(
 NULLIF(regexp_extract(text, '(?i)(?:(?:customer|consumer)\s*(?:care|service|support|[a-z]?are\b)|helpline|toll\s*free)[\s\S]{{0,300}}?(?:{_CONTACT_SQL})'), ''),
 NULLIF(regexp_extract(text, '(?i){_BARE_SQL}'), ''))), 1, 300) AS care FROM documents""")
def extract_care_documents(spark, d):
    return star.read(spark, d, "documents").select("doc_id", ff.extract_care(F.col("text")).alias("care"))


@R.add("extract_origin", _parsed("SELECT scan_id, origin, CAST(COALESCE(lower(origin) <> 'india', FALSE) AS INTEGER) AS imported FROM parsed"))
def extract_origin(spark, d):
    rows = star.label_text(spark, d).select("scan_id", ff.extract_origin(F.col("ocr_text")).alias("origin"))
    return rows.withColumn("imported", ff.imported(F.col("origin")).cast("int"))


@R.add("extract_generic", _parsed("SELECT scan_id, generic FROM parsed"))
def extract_generic(spark, d):
    return _lines(spark, d).select("scan_id", ff.extract_generic(F.col("said")).alias("generic"))


@R.add("extract_manufacturer", _parsed("SELECT scan_id, maker AS name, maker AS address FROM parsed"))
def extract_manufacturer(spark, d):
    rows = stage(_lines(spark, d), m=ff.extract_maker(F.col("said")))
    return rows.select("scan_id", F.col("m.name").alias("name"), F.col("m.address").alias("address"))


_DECL_SQL = """SELECT scan_id, maker AS manufacturer_name, maker AS manufacturer_address, generic AS generic_name, qty AS net_quantity_value, unit AS net_quantity_unit, mrp,
 CAST(taxes AS INTEGER) AS mrp_includes_taxes, CAST(mfg AS VARCHAR) AS mfg_date, CAST(exp AS VARCHAR) AS expiry_date, care AS consumer_care, origin AS country_of_origin,
 CAST(origin IS NOT NULL AS INTEGER) AS is_imported, CASE WHEN ocr_confidence < 60 THEN 'uncertain' ELSE 'read' END AS source FROM parsed"""


@R.add("extract_declarations", _parsed(_DECL_SQL))
def extract_declarations(spark, d):
    out = ex.extract_declarations(star.label_text(spark, d))
    return out.select(
        "scan_id", "manufacturer_name", "manufacturer_address", "generic_name", "net_quantity_value", "net_quantity_unit", "mrp",
        F.col("mrp_includes_taxes").cast("int").alias("mrp_includes_taxes"), F.col("mfg_date").cast("string").alias("mfg_date"),
        F.col("expiry_date").cast("string").alias("expiry_date"), "consumer_care", "country_of_origin",
        F.col("is_imported").cast("int").alias("is_imported"), F.get(F.map_values("field_sources"), 0).alias("source"))


@R.add("extract_documents")
def extract_documents(spark, d):
    docs = star.read(spark, d, "documents").select(F.col("doc_id").alias("scan_id"), F.col("text").alias("ocr_text"), F.lit(70.0).alias("ocr_confidence"))
    return ex.extract_declarations(docs).drop("ocr_text", "field_sources")


@R.add("confidence_sources", with_views(
    "SELECT scan_id, CASE WHEN generic_name IS NOT NULL THEN CASE WHEN scan_id % 7 IN (6, 0, 1) AND ocr_confidence < 60 THEN 'uncertain' "
    "ELSE (['read','inferred','ai_assist','uncertain','attested','read','read'])[CAST((scan_id + 6) % 7 AS INTEGER) + 1] END END AS source FROM declarations", "declarations"))
def confidence_sources(spark, d):
    rows = star.field_sources(star.declarations(spark, d))
    marked = ex.confidence_sources(F.col("field_sources"), F.col("ocr_confidence"))
    return rows.select("scan_id", F.try_element_at(marked, F.lit("generic_name")).alias("source"))


@R.add("repair_spacing", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13), chr(10)), '([a-z])([A-Z])', '\1 \2', 'g'), '([.!?;:])([A-Za-z])', '\1 \2', 'g'),
 '[\s\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), ' ') AS text FROM documents""")
def repair_spacing(spark, d):
    return star.read(spark, d, "documents").select("doc_id", ff.repair_spacing(F.col("text")).alias("text"))


# --- scoring -------------------------------------------------------------------------------------
def _truth(spark, d):
    """Labels with their truth: the declaration, without what injected violations and gaps leave out."""
    v = F.col("violation")
    labelled = star.with_label(star.declarations(spark, d))

    def kept(name, kind):
        return F.when(~v.eqNullSafe(kind), F.col(name))

    rows = labelled.select(
        "scan_id", "ocr_text", "ocr_confidence", F.when(F.col("scan_id") % 2 == 0, "synthetic").otherwise("real").alias("source"),
        F.substring("generic_name", 1, 4).alias("t_generic_sub"),
        kept("net_quantity_value", "missing_netqty").alias("t_value"), F.col("net_quantity_unit").alias("t_unit"),
        kept("mrp", "missing_mrp").alias("t_mrp"),
        kept("mfg_date", "missing_dates").isNotNull().alias("t_mfg"), kept("expiry_date", "missing_dates").isNotNull().alias("t_exp"),
        F.when(F.col("manufacturer_name").isNotNull(), F.array(F.col("manufacturer_name"), F.lit("nobody"))).alias("t_makers"),
        kept("consumer_care", "missing_care").isNotNull().alias("t_care"))
    no = F.array_compact(F.array(
        F.when(F.col("t_generic_sub").isNull(), "generic"), F.when(F.col("t_value").isNull(), "net_quantity"), F.when(F.col("t_mrp").isNull(), "mrp"),
        F.when(~F.col("t_mfg"), "mfg"), F.when(~F.col("t_exp"), "exp"), F.when(F.col("t_makers").isNull(), "manufacturer"), F.when(~F.col("t_care"), "care")))
    return rows.withColumn("absent", no)


def _scores(spark, d):
    return scoring.score_rows(ex.extract_declarations(_truth(spark, d)).drop("ocr_text", "field_sources"))


_SCORE_SQL = """SELECT p.scan_id, CASE WHEN p.scan_id % 2 = 0 THEN 'synthetic' ELSE 'real' END AS source, field, hit FROM (
 SELECT p.scan_id, unnest(['generic', 'net_quantity', 'mrp', 'mfg', 'exp', 'manufacturer', 'care']) AS field, unnest([
  CASE WHEN d.generic_name IS NOT NULL THEN contains(lower(COALESCE(p.generic, '')), lower(substr(d.generic_name, 1, 4))) ELSE COALESCE(p.generic, '') = '' END,
  CASE WHEN d.net_quantity_value IS NOT NULL AND v IS DISTINCT FROM 'missing_netqty' THEN COALESCE(p.qty = d.net_quantity_value AND p.unit = rtrim(d.net_quantity_unit, 's'), FALSE) ELSE p.qty IS NULL END,
  CASE WHEN d.mrp IS NOT NULL AND v IS DISTINCT FROM 'missing_mrp' THEN p.mrp IS NOT DISTINCT FROM d.mrp ELSE p.mrp IS NULL END,
  (p.mfg IS NOT NULL) = (d.mfg_date IS NOT NULL AND v IS DISTINCT FROM 'missing_dates'),
  (p.exp IS NOT NULL) = (d.expiry_date IS NOT NULL AND v IS DISTINCT FROM 'missing_dates'),
  CASE WHEN d.manufacturer_name IS NOT NULL THEN COALESCE(contains(lower(p.maker), lower(d.manufacturer_name)), FALSE) ELSE p.maker IS NULL END,
  (p.care IS NOT NULL) = (d.consumer_care IS NOT NULL AND v IS DISTINCT FROM 'missing_care')]) AS hit
 FROM (SELECT *, violation AS v FROM parsed) p JOIN declarations d ON p.scan_id = d.scan_id) p"""


@R.add("truth_score", _parsed(f"SELECT scan_id, source, field, CAST(hit AS INTEGER) AS hit FROM ({_SCORE_SQL})", "declarations"))
def truth_score(spark, d):
    return _scores(spark, d).withColumn("hit", F.col("hit").cast("int"))


@R.add("field_accuracy", _parsed(
    f"SELECT source, field, count(*) FILTER (hit) AS hits, count(*) AS total, round_even(1000.0 * count(*) FILTER (hit) / count(*), 0) / 10 AS percent FROM ({_SCORE_SQL}) GROUP BY ROLLUP (source, field)", "declarations"))
def field_accuracy(spark, d):
    return scoring.field_accuracy(_scores(spark, d))


# Sizes are unknown on a flat text, so a clean label is incomplete.
_READ_DECL = f"""
SELECT d.*, FALSE AS is_embossed, t.ocr_confidence, t.violation, {', '.join(f'NULL::DOUBLE AS {c}' for c in ('min_numeral_height_mm', 'min_letter_height_mm', 'min_width_to_height_ratio', 'panel_area_cm2'))}
FROM ({_DECL_SQL}) d JOIN label_text t ON d.scan_id = t.scan_id
"""


@R.add("verdict_accuracy", with_views(
    "SELECT count(*) FILTER (v.verdict = CASE WHEN t.violation IS NOT NULL THEN 'NON_COMPLIANT' ELSE 'INCOMPLETE' END) AS ok, count(*) AS total FROM verdicts v JOIN label_text t ON v.scan_id = t.scan_id",
    "verdicts", "label_text", replaced={
        "parsed": (_PARSED, ("label_text",)), "read_decl": (_READ_DECL, ("parsed", "label_text")),
        "tiered": (TIERED.replace("FROM declarations", "FROM read_decl"), ("read_decl",))}))
def verdict_accuracy(spark, d):
    read = ex.extract_declarations(star.label_text(spark, d))
    unknown = {c: F.lit(None).cast("double") for c in ("min_numeral_height_mm", "min_letter_height_mm", "min_width_to_height_ratio", "panel_area_cm2")}
    judged = rules.verdicts(read.withColumns(unknown).withColumn("is_embossed", F.lit(False)), "violation")
    return scoring.verdict_accuracy(judged)


@R.add("read_quality", "SELECT source, count(*) AS n, count(*) FILTER ((doc_id * 37) % 101 >= 60) AS readable, count(*) FILTER (trim(text) = '') AS empty, round_even(avg((doc_id * 37) % 101), 1) AS mean_conf FROM documents GROUP BY source")
def read_quality(spark, d):
    docs = star.read(spark, d, "documents").withColumn("ocr_confidence", ((F.col("doc_id") * 37) % 101).cast("double"))
    return scoring.read_quality(docs)


_GATE_FOUND = " + ".join(f"CASE WHEN {f} {'> 0' if f in scoring.GATE_NUMBERS else 'IS NOT NULL'} THEN 1 ELSE 0 END" for f in scoring.GATE_FIELDS)
# Every seventh price is 0, which counts as not found.
_GATE_INPUT = "(SELECT * REPLACE (CASE WHEN scan_id % 7 = 0 THEN 0 ELSE mrp END AS mrp) FROM declarations)"


def _gate(spark, d):
    decl = star.declarations(spark, d)
    return scoring.acceptance_gate(decl.withColumn("mrp", F.when(F.col("scan_id") % 7 == 0, 0.0).otherwise(F.col("mrp"))))


@R.add("acceptance_gate", with_views(
    f"SELECT scan_id, {_GATE_FOUND} AS fields, min_numeral_height_mm AS font_mm, CASE WHEN {_GATE_FOUND} >= 5 AND min_numeral_height_mm IS NOT NULL THEN 1 ELSE 0 END AS ok FROM {_GATE_INPUT}", "declarations"))
def acceptance_gate(spark, d):
    return _gate(spark, d).withColumn("ok", F.col("ok").cast("int"))


@R.add("acceptance_gate_all", with_views(
    f"SELECT count(*) AS images, count(*) FILTER (ok) AS passing, bool_and(ok) AS passed FROM (SELECT {_GATE_FOUND} >= 5 AND min_numeral_height_mm IS NOT NULL AS ok FROM {_GATE_INPUT})", "declarations"))
def acceptance_gate_all(spark, d):
    return scoring.gate_passed(_gate(spark, d))


_MISSING_SQL = """list_filter([CASE WHEN consumer_care IS NULL THEN 'care' END, CASE WHEN generic_name IS NULL THEN 'generic' END, CASE WHEN manufacturer_name IS NULL OR manufacturer_address IS NULL THEN 'manufacturer' END,
 CASE WHEN mfg_date IS NULL THEN 'mfg_date' END, CASE WHEN mrp IS NULL THEN 'mrp' END, CASE WHEN net_quantity_value IS NULL OR net_quantity_unit IS NULL THEN 'net_qty' END], lambda m: m IS NOT NULL)"""


@R.add("preview_readiness", with_views(
    f"""SELECT scan_id, 6 - len(missing) AS fields_count, array_to_string(missing, ', ') AS missing, CASE WHEN len(reasons) = 0 THEN 1 ELSE 0 END AS ready,
    CASE WHEN len(reasons) = 0 THEN 'ready to capture' ELSE array_to_string(reasons, '; ') END AS ready_reason FROM (SELECT *, list_filter([
      CASE WHEN len(missing) > 0 THEN 'missing ' || array_to_string(missing, ', ') END, CASE WHEN ocr_confidence < 60 THEN 'low confidence ' || ocr_confidence || '% (<60%)' END,
      CASE WHEN min_numeral_height_mm IS NULL THEN 'size unmeasured (no card/ppm in frame)' END, CASE WHEN scan_id % 90 < 50 THEN 'blurry (sharpness ' || CAST(scan_id % 90 AS DOUBLE) || ')' END], lambda r: r IS NOT NULL) AS reasons
      FROM (SELECT *, {_MISSING_SQL} AS missing FROM declarations))""", "declarations"))
def preview_readiness(spark, d):
    decl = star.declarations(spark, d).withColumn("sharpness", (F.col("scan_id") % 90).cast("double"))
    return scoring.preview_readiness(decl).withColumn("ready", F.col("ready").cast("int"))


@R.add("merge_scan", with_views("""
SELECT u.scan_id, u.ocr_text, best_index, measured_index, n_frames, 'tesseract+merge' || n_frames AS ocr_engine FROM (
  SELECT scan_id, substr(string_agg(line, chr(10) ORDER BY ocr_confidence DESC, frame_index, pos), 1, 8000) AS ocr_text FROM (
    SELECT scan_id, frame_index, pos, ocr_confidence, line FROM (
      SELECT scan_id, frame_index, ocr_confidence, pos, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS line FROM (
        SELECT scan_id, frame_index, ocr_confidence, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM document_frames))
    WHERE length(line) >= 2 QUALIFY row_number() OVER (PARTITION BY scan_id, lower(line) ORDER BY ocr_confidence DESC, frame_index, pos) = 1) GROUP BY scan_id) u
JOIN (SELECT b.scan_id, b.frame_index AS best_index, COALESCE(m.frame_index, b.frame_index) AS measured_index, n_frames FROM
  (SELECT *, count(*) OVER (PARTITION BY scan_id) AS n_frames FROM document_frames QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY ocr_confidence DESC, length(text) DESC, frame_index) = 1) b
  LEFT JOIN (SELECT scan_id, frame_index FROM document_frames WHERE (scan_id + frame_index) % 4 = 1 QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY ocr_confidence DESC, frame_index DESC) = 1) m ON b.scan_id = m.scan_id) c
ON u.scan_id = c.scan_id""", "document_frames"))
def merge_scan_query(spark, d):
    return _merged(spark, d).select(
        "scan_id", "ocr_text", F.col("best_index").cast("bigint").alias("best_index"),
        F.col("measured_index").cast("bigint").alias("measured_index"), "n_frames", "ocr_engine")


@R.add("merge_scan_verdicts")
def merge_scan_verdicts(spark, d):
    return _merged(spark, d).select("scan_id", "verdict", "generic_name", "mrp", F.array_join("warnings", " | ").alias("warnings"))


def _merged(spark, d):
    calibrated = (F.col("scan_id") + F.col("frame_index")) % 4 == 1
    size = (F.col("scan_id") % 30 / 10).cast("double")
    docs = star.document_frames(spark, d)
    frames = docs.repartition(star.tasks_for(docs), "scan_id").withColumns({
        "font_mm": F.when(calibrated, size), "letter_mm": F.when(calibrated, size), "ratio": F.lit(0.5), "has_boxes": F.lit(True)})
    return merge_scan(frames)




# --- merged scans of labels ------------------------------------------------------------------------
# Three captures of each label; every line is on two of them. Words have boxes, captures barcodes, scans an upload.
_CAPTURES = """SELECT scan_id, f, CAST((scan_id * 7 + f * 31) % 101 AS DOUBLE) AS conf, CASE WHEN (scan_id + f) % 4 = 1 THEN scan_id % 30 / 10.0 END AS size, lines,
 string_agg(line, chr(10) ORDER BY no) AS text, count(line) AS n FROM (SELECT scan_id, lines, unnest([0, 1, 2]) AS f FROM (SELECT scan_id, string_split(ocr_text, chr(10)) AS lines FROM label_text))
 LEFT JOIN (SELECT scan_id, unnest(lines) AS line, unnest(range(len(lines))) AS no FROM (SELECT scan_id, string_split(ocr_text, chr(10)) AS lines FROM label_text)) USING (scan_id)
 WHERE (no + f) % 3 <> 0 GROUP BY ALL"""
_CHOSEN = """SELECT b.scan_id, b.f AS best_index, b.conf AS ocr_confidence, COALESCE(m.f, b.f) AS measured_index, COALESCE(m.size, b.size) AS size, n_frames FROM
 (SELECT *, count(*) OVER (PARTITION BY scan_id) AS n_frames FROM captures QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY conf DESC, length(text) DESC, f) = 1) b
 LEFT JOIN (SELECT * FROM captures WHERE size IS NOT NULL QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY conf DESC, f DESC) = 1) m USING (scan_id)"""
_UNION = """SELECT scan_id, f, ord, line FROM (SELECT scan_id, f, conf, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS ord FROM captures)
 WHERE length(line) >= 2 QUALIFY row_number() OVER (PARTITION BY scan_id, lower(line) ORDER BY conf DESC, f, ord) = 1"""
_UNION_TEXT = """SELECT c.scan_id, c.ocr_confidence, NULL::VARCHAR AS violation, COALESCE(string_agg(line, chr(10) ORDER BY p.conf DESC, u.f, ord), '') AS ocr_text
 FROM chosen c LEFT JOIN union_lines u USING (scan_id) LEFT JOIN captures p ON p.scan_id = u.scan_id AND p.f = u.f GROUP BY c.scan_id, c.ocr_confidence"""
# A label that only shows a month of expiry gets it as its first date from the visual row, where the best capture has that row.
_SEEN = r"""SELECT p.* REPLACE (COALESCE(p.mfg, CASE WHEN regexp_matches(c.text, 'Exp: ') THEN p.exp END) AS mfg) FROM parsed_text p JOIN chosen b USING (scan_id) JOIN captures c ON c.scan_id = b.scan_id AND c.f = b.best_index"""
_MERGED_DECL = f"""SELECT d.*, b.scan_id % 2 = 0 AS is_embossed, b.ocr_confidence, b.size AS min_numeral_height_mm, b.size AS min_letter_height_mm, 0.5::DOUBLE AS min_width_to_height_ratio, 40.0::DOUBLE AS panel_area_cm2
 FROM ({_DECL_SQL}) d JOIN chosen b USING (scan_id)"""
_MERGE_VIEWS = {
    "whole_text": (LABEL_TEXT, ("declarations",)), "captures": (_CAPTURES.replace("FROM label_text", "FROM whole_text"), ("whole_text",)), "chosen": (_CHOSEN, ("captures",)),
    "union_lines": (_UNION, ("captures",)), "label_text": (_UNION_TEXT, ("chosen", "union_lines")), "parsed_text": (_PARSED, ("label_text",)), "parsed": (_SEEN, ("parsed_text", "chosen")),
    "read_decl": (_MERGED_DECL, ("parsed", "chosen")), "tiered": (TIERED.replace("FROM declarations", "FROM read_decl"), ("read_decl",)),
}


@R.add("merge_labels", with_views(f"""
SELECT v.scan_id, v.verdict, warned || CASE WHEN warned <> '' THEN ' | ' ELSE '' END || 'Merged ' || n_frames || ' captures (best single-frame confidence ' || b.ocr_confidence || '%); text combined by confidence, evaluated once.' ||
 CASE WHEN measured_index <> best_index THEN ' | Type size measured on angle ' || (measured_index + 1) || ' (it carries the mm scale); text led by angle ' || (best_index + 1) || '.' ELSE '' END AS warnings,
 n_frames, (SELECT string_agg(f || ':' || CASE WHEN f = best_index THEN 'b' ELSE '' END || CASE WHEN f = measured_index THEN 'm' ELSE '' END || ':' || words || ':' || added, ' ' ORDER BY f) FROM
   (SELECT c.f, len(string_split(replace(c.text, chr(10), ' '), ' ')) AS words, (SELECT count(*) FROM union_lines u WHERE u.scan_id = c.scan_id AND u.f = c.f) AS added FROM captures c WHERE c.scan_id = v.scan_id)) AS frames,
 (SELECT string_agg(rule_id || '=' || status || ':' || cause, ' ' ORDER BY rule_order) FROM annotated a WHERE a.scan_id = v.scan_id) ||
   CASE WHEN v.scan_id % 3 = 0 THEN ' LMPC-gtin-1=PASS: LMPC-gtin-2=PASS:' ELSE ' LMPC-gtin=PASS:' END AS results,
 CASE WHEN v.scan_id % 5 = 0 THEN 'Given' ELSE COALESCE(d.generic_name, '') END AS product_name, COALESCE(substr(d.manufacturer_name, 1, 160), '') AS brand_name, CASE WHEN v.scan_id % 5 = 1 THEN 'food' ELSE '' END AS category,
 CASE WHEN v.scan_id % 2000 / 10.0 - 100 BETWEEN -90 AND 90 THEN v.scan_id % 2000 / 10.0 - 100 END AS scan_lat, b.size AS font_height_mm, d.mrp, d.mfg_date, d.expiry_date
FROM (SELECT *, {_WARN_SQL} AS warned FROM (SELECT *, {_MISSED_SQL} AS missed FROM verdicts)) v JOIN chosen b USING (scan_id) JOIN read_decl d USING (scan_id)""", "annotated", "verdicts", "chosen", "union_lines", "read_decl", replaced=_MERGE_VIEWS))
def merge_labels(spark, d):
    out = merge_scan(_label_captures(spark, d), uploads=_uploads(spark, d))
    mark = lambda f: F.concat(F.when(f["is_best"], "b").otherwise(""), F.when(f["measured"], "m").otherwise(""))
    said = lambda f: F.concat_ws(":", f["index"].cast("string"), mark(f), f["word_count"].cast("string"), f["words_added"].cast("string"))
    return out.select(
        "scan_id", "verdict", F.array_join("warnings", " | ").alias("warnings"), "n_frames", F.array_join(F.transform("frames", said), " ").alias("frames"),
        F.array_join(F.transform("results", lambda f: F.concat(f["rule_id"], F.lit("="), f["status"], F.lit(":"), f["cause"])), " ").alias("results"),
        "product_name", "brand_name", "category", "scan_lat", "font_height_mm", "mrp", F.col("mfg_date").cast("string").alias("mfg_date"), F.col("expiry_date").cast("string").alias("expiry_date"))


def _label_captures(spark, d):
    k, f = F.col("scan_id"), F.col("frame_index")
    kept = F.filter(F.transform(F.split("ocr_text", "\n"), lambda line, no: F.struct(no.alias("no"), line.alias("line"))), lambda x: (x["no"] + f) % 3 != 0)
    texts = star.label_text(spark, d).select("scan_id", "ocr_text").repartition(star.tasks_for(star.read(spark, d, "orders")), "scan_id")
    frames = texts.select("scan_id", "ocr_text", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("frame_index")).select("scan_id", "frame_index", kept.alias("ls"))
    words = F.flatten(F.transform("ls", lambda x: F.transform(F.split(x["line"], " "), lambda w, i: F.struct(
        (x["no"] * 1000 + i).cast("bigint").alias("ord"), w.alias("text"), (i * 120).alias("x"), (x["no"] * 40).alias("y"), (F.length(w) * 10).alias("w"), F.lit(20).alias("h"), F.lit(80.0).alias("confidence")))))
    size = F.when((k + f) % 4 == 1, (k % 30) / 10)
    code = lambda n: F.struct(F.lit("EAN13").alias("format"), F.concat(F.lit(" 890"), F.lpad(k.cast("string"), 9, "0"), F.lit(n)).alias("text"))
    blank = F.struct(F.lit("EAN8").alias("format"), F.lit("  ").alias("text"))
    return frames.where("size(ls) > 0").select(
        "scan_id", "frame_index", ((k * 7 + f * 31) % 101).cast("double").alias("ocr_confidence"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("text"),
        size.alias("font_mm"), size.alias("letter_mm"), F.lit(0.5).alias("ratio"), F.lit(True).alias("has_boxes"), words.alias("boxes"),
        F.when(k % 3 == 0, F.array(code("1"), blank, code("2"), code("1"))).otherwise(F.array(code("1"), code("1"))).alias("barcodes"))


def _uploads(spark, d):
    k = F.col("o_orderkey")
    return star.read(spark, d, "orders").select(
        k.alias("scan_id"), F.when(k % 5 == 0, " Given ").otherwise(" ").alias("given_product"), F.when(k % 5 == 1, "food").alias("given_category"),
        (k % 2000 / 10 - 100).alias("scan_lat"), F.lit(77.0).alias("scan_lon"), (k % 2 == 0).alias("is_embossed"), F.lit(40.0).alias("panel_area_cm2"))
