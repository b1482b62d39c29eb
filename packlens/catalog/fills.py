"""Queries over second opinions, known names, the labelling corpus and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from packlens import fixed_values as fv
from packlens.catalog.oracle_views import LABEL_TEXT, quote, sql_in, with_views
from packlens.catalog.registry import Registry
from packlens.operators import extraction, gazetteer, layout, patches, rules, tagging
from packlens.session import scratch_path, settle
from packlens.sources import corpus, star
from packlens.streaming import live

R = Registry()


def _k():
    return F.col("scan_id")


# --- model answers -------------------------------------------------------------------------------
def _answers(spark, d):
    """Model answers: fenced or plain JSON, wrong types, unknown keys and broken text."""
    decl = star.declarations(spark, d)
    body = F.to_json(F.struct(
        F.when(_k() % 5 != 0, F.col("mrp")).alias("mrp"), F.lit(True).alias("mrp_includes_taxes"), F.col("net_quantity_value"),
        F.when(_k() % 6 == 0, "Pieces").otherwise(F.upper("net_quantity_unit")).alias("net_quantity_unit"),
        F.date_format("mfg_date", "dd/MM/yyyy").alias("mfg_date"), F.concat(F.lit(" "), F.col("manufacturer_name")).alias("manufacturer_name"),
        F.lit(7).alias("generic_name"), F.lit("x").alias("other"), (_k() % 2 == 0).alias("is_imported")))
    wrong = F.regexp_replace(body, r'"mrp":[\d.]+', '"mrp":"12"')
    return decl.select("scan_id", F.when(_k() % 7 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(_k() % 7 == 1, "{broken")
                       .when(_k() % 7 == 2, wrong).otherwise(body).alias("answer"))


@R.add("model_patch_parse", with_views(f"""SELECT scan_id, CASE WHEN scan_id % 7 IN (1, 2) OR scan_id % 5 = 0 THEN NULL ELSE mrp END AS mrp,
 CASE WHEN scan_id % 7 <> 1 THEN 1 END AS taxes, CASE WHEN scan_id % 7 <> 1 THEN net_quantity_value END AS quantity,
 CASE WHEN scan_id % 7 <> 1 AND scan_id % 6 <> 0 AND rtrim(lower(net_quantity_unit), 's') IN {sql_in(fv.MODEL_UNITS)} THEN rtrim(lower(net_quantity_unit), 's') END AS unit,
 CASE WHEN scan_id % 7 <> 1 THEN CAST(mfg_date AS VARCHAR) END AS mfg, CASE WHEN scan_id % 7 <> 1 THEN manufacturer_name END AS maker, NULL::VARCHAR AS generic,
 CASE WHEN scan_id % 7 <> 1 THEN CAST(scan_id % 2 = 0 AS INTEGER) END AS imported FROM declarations""", "declarations"))
def model_patch_parse(spark, d):
    return patches.model_patch_parse(_answers(spark, d)).select(
        "scan_id", F.col("p_mrp").alias("mrp"), F.col("p_mrp_includes_taxes").cast("int").alias("taxes"), F.col("p_net_quantity_value").alias("quantity"),
        F.col("p_net_quantity_unit").alias("unit"), F.col("p_mfg_date").cast("string").alias("mfg"), F.col("p_manufacturer_name").alias("maker"),
        F.col("p_generic_name").alias("generic"), F.col("p_is_imported").cast("int").alias("imported"))


def _patch_rows(spark, d):
    rows = star.declarations(spark, d).select(
        "scan_id", (_k() % 500 + 1).cast("double").alias("p_mrp"), F.lit(True).alias("p_mrp_includes_taxes"), (_k() % 90 + 10).cast("double").alias("p_net_quantity_value"),
        F.lit("g").alias("p_net_quantity_unit"), F.lit("2024-01-01").cast("date").alias("p_mfg_date"),
        F.when(_k() % 2 == 0, "2023-01-01").otherwise("2025-01-01").cast("date").alias("p_expiry_date"),
        F.when(_k() % 3 == 0, "For Consumer Care Contact").otherwise("Plain Oats").alias("p_generic_name"),
        F.when(_k() % 4 == 0, "Marketed by X").otherwise("Acme Foods").alias("p_manufacturer_name"), F.lit("Pune").alias("p_manufacturer_address"),
        F.when(_k() % 2 == 0, "customer care").otherwise("call 1800 123 456").alias("p_consumer_care"), F.lit("Nepal").alias("p_country_of_origin"),
        F.lit(False).alias("p_is_imported"))
    return rows


def _with_text(spark, d):
    base = star.field_sources(star.declarations(spark, d))
    return base.withColumns({"ocr_text": F.concat(F.lit("No. "), _k().cast("string"), F.lit(" lot 4 7"))})


_DIGITS = "regexp_replace('No. ' || scan_id || ' lot 4 7', '[^0-9]', '', 'g')"
_FILL = f"""SELECT scan_id, COALESCE(mrp, f_mrp) AS mrp, CAST(mrp_includes_taxes OR TRUE AS INTEGER) AS taxes, COALESCE(net_quantity_value, f_qty) AS quantity,
 COALESCE(generic_name, f_gen) AS generic, COALESCE(manufacturer_name, f_maker) AS maker, COALESCE(consumer_care, f_care) AS care, CAST(COALESCE(mfg_date, f_mfg) AS VARCHAR) AS mfg, CAST(COALESCE(expiry_date, f_exp) AS VARCHAR) AS exp,
 array_to_string(list_filter([CASE WHEN f_care IS NOT NULL THEN 'consumer_care' END, CASE WHEN country_of_origin IS NULL THEN 'country_of_origin' END, CASE WHEN f_exp IS NOT NULL THEN 'expiry_date' END,
  CASE WHEN f_gen IS NOT NULL THEN 'generic_name' END, CASE WHEN manufacturer_address IS NULL THEN 'manufacturer_address' END, CASE WHEN f_maker IS NOT NULL THEN 'manufacturer_name' END, CASE WHEN f_mfg IS NOT NULL THEN 'mfg_date' END,
  CASE WHEN f_mrp IS NOT NULL THEN 'mrp' END, CASE WHEN NOT mrp_includes_taxes THEN 'mrp_includes_taxes' END, CASE WHEN net_quantity_unit IS NULL THEN 'net_quantity_unit' END, CASE WHEN f_qty IS NOT NULL THEN 'net_quantity_value' END], lambda x: x IS NOT NULL), ',') AS filled
FROM (SELECT *, CASE WHEN NOT (g_mfg IS NOT NULL AND g_exp IS NOT NULL AND g_exp <= g_mfg) THEN g_mfg END AS f_mfg, CASE WHEN NOT (g_mfg IS NOT NULL AND g_exp IS NOT NULL AND g_exp <= g_mfg) THEN g_exp END AS f_exp FROM (
 SELECT *, CASE WHEN mrp IS NULL AND contains({_DIGITS}, CAST(scan_id % 500 + 1 AS VARCHAR)) THEN CAST(scan_id % 500 + 1 AS DOUBLE) END AS f_mrp,
 CASE WHEN net_quantity_value IS NULL AND contains({_DIGITS}, CAST(scan_id % 90 + 10 AS VARCHAR)) THEN CAST(scan_id % 90 + 10 AS DOUBLE) END AS f_qty,
 CASE WHEN generic_name IS NULL AND scan_id % 3 <> 0 THEN 'Plain Oats' END AS f_gen, CASE WHEN manufacturer_name IS NULL AND scan_id % 4 <> 0 THEN 'Acme Foods' END AS f_maker,
 CASE WHEN consumer_care IS NULL AND scan_id % 2 <> 0 THEN 'call 1800 123 456' END AS f_care, CASE WHEN mfg_date IS NULL THEN DATE '2024-01-01' END AS g_mfg,
 CASE WHEN expiry_date IS NULL THEN CASE WHEN scan_id % 2 = 0 THEN DATE '2023-01-01' ELSE DATE '2025-01-01' END END AS g_exp FROM declarations))"""


@R.add("model_patch_fill", with_views(_FILL, "declarations"))
def model_patch_fill(spark, d):
    out = patches.model_patch_fill(_with_text(spark, d), _patch_rows(spark, d))
    return out.select("scan_id", "mrp", F.col("mrp_includes_taxes").cast("int").alias("taxes"), F.col("net_quantity_value").alias("quantity"),
                      F.col("generic_name").alias("generic"), F.col("manufacturer_name").alias("maker"), F.col("consumer_care").alias("care"),
                      F.col("mfg_date").cast("string").alias("mfg"), F.col("expiry_date").cast("string").alias("exp"), F.array_join("filled", ",").alias("filled"))


@R.add("digits_grounded", with_views(
    "SELECT scan_id, CAST(contains(regexp_replace(ocr_text, '[^0-9]', '', 'g'), regexp_replace(format('{:g}', mrp), '[^0-9]', '', 'g')) AS INTEGER) AS ok FROM label_text JOIN declarations USING (scan_id)",
    "label_text", "declarations"))
def digits_grounded(spark, d):
    rows = star.with_label(star.declarations(spark, d))
    return rows.select("scan_id", patches.digits_grounded(F.col("mrp"), F.col("ocr_text")).cast("int").alias("ok"))


def _entities(spark, d):
    """Entities of order lines: the label cycles over the kinds, texts carry or lack their evidence."""
    fr = star.order_frames(spark, d)
    n = F.col("part_id")
    kinds = ("MRP", "NET_QTY", "MFG_DATE", "EXP_DATE", "MANUFACTURER", "CARE", "ORG", "GPE")
    text = {
        "MRP": F.concat(F.when(n % 2 == 0, "Rs. ").otherwise(""), n.cast("string"), F.lit(".50")),
        "NET_QTY": F.concat(n.cast("string"), F.when(n % 3 == 0, " blobs").otherwise(" pcs")),
        "MFG_DATE": F.lit("on 05/06/2024"), "EXP_DATE": F.lit("till 07/2026"),
        "MANUFACTURER": F.when(n % 2 == 0, F.concat(F.lit("Acme, Plot "), (n % 100).cast("string"))).otherwise(F.concat(F.lit("A COOL "), n.cast("string"))),
        "CARE": F.when(n % 2 == 0, F.concat(F.lit("write to a"), n.cast("string"), F.lit("@b.in"))).otherwise("customer care"),
        "ORG": F.concat(F.lit("Org "), n.cast("string")), "GPE": F.concat(F.lit("Place "), n.cast("string")),
    }
    label = F.get(F.array(*[F.lit(k) for k in kinds]), ((n + F.col("frame_index")) % len(kinds)).cast("int"))
    value = F.lit(None).cast("string")
    for k in kinds:
        value = F.when(F.col("label") == k, text[k]).otherwise(value)
    return fr.select("scan_id", F.col("frame_index").alias("pos"), label.alias("label"), "part_id").withColumn("text", value)


_ENT = """SELECT scan_id, (['MRP', 'NET_QTY', 'MFG_DATE', 'EXP_DATE', 'MANUFACTURER', 'CARE', 'ORG', 'GPE'])[CAST((part_id + frame_index) % 8 AS INTEGER) + 1] AS label, part_id AS n FROM order_frames
 QUALIFY row_number() OVER (PARTITION BY scan_id, (part_id + frame_index) % 8 ORDER BY frame_index) = 1"""


@R.add("entity_fill", with_views(f"""WITH_E SELECT d.scan_id, COALESCE(mrp, CASE WHEN m.n % 2 = 0 THEN m.n + 0.5 END)::DOUBLE AS mrp,
 CASE WHEN net_quantity_value IS NULL AND q.n > 0 AND q.n % 3 <> 0 THEN CAST(q.n AS DOUBLE) ELSE net_quantity_value END AS quantity,
 CASE WHEN net_quantity_value IS NULL AND q.n > 0 AND q.n % 3 <> 0 THEN 'pc' ELSE net_quantity_unit END AS unit,
 CAST(COALESCE(mfg_date, CASE WHEN f.n IS NOT NULL THEN DATE '2024-06-05' END) AS VARCHAR) AS mfg, CAST(COALESCE(expiry_date, CASE WHEN x.n IS NOT NULL THEN DATE '2026-07-01' END) AS VARCHAR) AS exp,
 COALESCE(manufacturer_name, CASE WHEN a.n % 2 = 0 THEN 'Acme, Plot ' || (a.n % 100) END) AS maker, COALESCE(consumer_care, CASE WHEN c.n % 2 = 0 THEN 'write to a' || c.n || '@b.in' END) AS care
 FROM declarations d LEFT JOIN e m ON d.scan_id = m.scan_id AND m.label = 'MRP' LEFT JOIN e q ON d.scan_id = q.scan_id AND q.label = 'NET_QTY' LEFT JOIN e f ON d.scan_id = f.scan_id AND f.label = 'MFG_DATE'
 LEFT JOIN e x ON d.scan_id = x.scan_id AND x.label = 'EXP_DATE' LEFT JOIN e a ON d.scan_id = a.scan_id AND a.label = 'MANUFACTURER' LEFT JOIN e c ON d.scan_id = c.scan_id AND c.label = 'CARE'""".replace("WITH_E ", ""),
    "declarations", "e", replaced={"e": (_ENT, ("order_frames",))}))
def entity_fill(spark, d):
    out = patches.entity_fill(_with_text(spark, d), _entities(spark, d))
    return out.select("scan_id", "mrp", F.col("net_quantity_value").alias("quantity"), F.col("net_quantity_unit").alias("unit"), F.col("mfg_date").cast("string").alias("mfg"),
                      F.col("expiry_date").cast("string").alias("exp"), F.col("manufacturer_name").alias("maker"), F.col("consumer_care").alias("care"))


@R.add("org_place_fill", with_views(
    "SELECT d.scan_id, COALESCE(manufacturer_name, 'Org ' || o.n) AS maker, COALESCE(country_of_origin, 'Place ' || g.n) AS origin FROM declarations d "
    "LEFT JOIN e o ON d.scan_id = o.scan_id AND o.label = 'ORG' LEFT JOIN e g ON d.scan_id = g.scan_id AND g.label = 'GPE'",
    "declarations", "e", replaced={"e": (_ENT, ("order_frames",))}))
def org_place_fill(spark, d):
    out = patches.org_place_fill(star.declarations(spark, d), _entities(spark, d))
    return out.select("scan_id", F.col("manufacturer_name").alias("maker"), F.col("country_of_origin").alias("origin"))


@R.add("source_trigger", with_views(
    f"SELECT DISTINCT scan_id FROM findings WHERE ocr_confidence < 75 OR (status IN ('FAIL', 'NOT_FOUND') AND rule_id IN {sql_in(fv.SECOND_OPINION_RULES)})", "findings"))
def source_trigger(spark, d):
    return patches.source_trigger(rules.findings(star.declarations(spark, d)))


@R.add("layout_rescue")
def layout_rescue(spark, d):
    """Labels whose words lost their line order in the text; visual rows bring fields back."""
    from packlens.catalog.capture import label_words
    words = settle(label_words(spark, d), "rescue-words")
    shuffled = words.groupBy("scan_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "ord", "text"))), lambda w: w["text"]), "\n").alias("ocr_text"))
    decl = settle(extraction.extract_declarations(shuffled.withColumn("ocr_confidence", F.lit(70.0))), "rescue-decl")
    return patches.layout_rescue(decl, settle(layout.visual_lines(words), "rescue-lines")).select(
        "scan_id", "mrp", F.col("mfg_date").cast("string").alias("mfg"), F.col("expiry_date").cast("string").alias("exp"), "manufacturer_name")


# --- known names ---------------------------------------------------------------------------------
def _known_names(spark, d):
    makers = star.read(spark, d, "supplier").select(F.col("s_name").alias("raw"), F.col("s_suppkey").alias("pos"))
    goods = star.read(spark, d, "part").groupBy(F.col("p_name").alias("raw")).agg(F.min("p_partkey").alias("pos"))
    return gazetteer.canonical_names(makers, goods)


def _misread(name, k):
    """One character replaced; every fourth name is left alone."""
    at = (k % (F.length(name) - 2) + 1).cast("int")
    return F.when(k % 4 != 0, F.concat(F.substring(name, F.lit(1), at), F.lit("~"), F.substring(name, at + 2, F.length(name)))).otherwise(name)


#: The list of known names and the misreadings, as SQL.
_NAMES_SQL = """SELECT name, src * (1::BIGINT << 40) + pos AS position FROM (SELECT name, src, pos, row_number() OVER (PARTITION BY lower(name) ORDER BY src, pos) AS rn FROM (
 SELECT s_name AS name, 0 AS src, s_suppkey AS pos FROM supplier UNION ALL SELECT p_name, 1, min(p_partkey) FROM part GROUP BY p_name)) WHERE rn = 1"""


def _misread_sql(name):
    at = f"(scan_id % (length({name}) - 2) + 1)"
    return f"CASE WHEN scan_id % 4 <> 0 THEN substr({name}, 1, {at}) || '~' || substr({name}, {at} + 2) ELSE {name} END"


def _match_sql(queries, cutoff):
    """Common table expressions ending in ``hits(query, name, score)``: partial ratio by its definition, every window of every pair of distinct strings.

    A string that contains another scores 100, the most there is. Pairs whose longest common subsequence over whole strings is too short for
    any window are left out first.
    """
    step = "lambda s, m: ((s + (s & m)) | (s - (s & m))) & ((1::BIGINT << n) - 1)"
    lcs = lambda masks: f"(n - bit_count(list_reduce({masks}, {step}, (1::BIGINT << n) - 1)))"
    return f"""names AS ({_NAMES_SQL}),
asked AS (SELECT DISTINCT query FROM ({queries}) WHERE length(query) >= 5),
every AS (SELECT query, name, position, name AS needle, query AS hay FROM asked, names WHERE length(name) <= length(query)
  UNION ALL SELECT query, name, position, query, name FROM asked, names WHERE length(query) <= length(name)),
whole AS (SELECT query, name, position, 100.0::DOUBLE AS raw FROM every WHERE contains(hay, needle)),
pairs AS (SELECT * FROM every WHERE query NOT IN (SELECT query FROM whole)),
letters AS (SELECT needle, string_split(needle, '') AS cs FROM (SELECT DISTINCT needle FROM pairs)),
bits AS (SELECT needle, map_from_entries(list((c, b))) AS mk FROM (
  SELECT needle, c, sum(1::BIGINT << (i - 1))::BIGINT AS b FROM (SELECT needle, unnest(cs) AS c, unnest(range(1, len(cs) + 1)) AS i FROM letters) GROUP BY needle, c) GROUP BY needle),
masked AS (SELECT query, name, position, length(needle) AS n, list_transform(string_split(hay, ''), lambda c: coalesce(mk[c], 0::BIGINT)) AS ms FROM pairs JOIN bits USING (needle)),
near AS (SELECT * FROM masked WHERE {lcs("ms")} >= {cutoff / 100} * n / {2 - cutoff / 100} - 1e-9),
cuts AS (SELECT query, name, position, n, unnest(list_transform(range(1 - n, len(ms)), lambda a: ms[greatest(a, 0) + 1:least(a + n, len(ms))])) AS w FROM near),
scored AS (SELECT query, name, position, max(200.0 * {lcs("w")} / (n + len(w))) AS raw FROM cuts GROUP BY query, name, position UNION ALL SELECT * FROM whole),
hits AS (SELECT query, arg_max(name, {{'r': raw, 'p': -position}}) AS name, round_even(max(raw) * 10, 0) / 10 AS score FROM scored WHERE raw >= {cutoff} GROUP BY query)"""


_FIXED = f"SELECT scan_id, {_misread_sql('manufacturer_name')} AS maker FROM declarations WHERE manufacturer_name IS NOT NULL"
_BETTER = "name IS NOT NULL AND NOT contains(lower(maker), lower(name))"


@R.add("gazetteer_fix", with_views(f"""SELECT scan_id, CASE WHEN {_BETTER} THEN name ELSE maker END AS manufacturer_name, {_BETTER} AS rewritten
 FROM read_makers LEFT JOIN hits ON hits.query = read_makers.maker""", "hits",
    replaced={"read_makers": (_FIXED, ("declarations",)), "hits": ("WITH " + _match_sql("SELECT maker AS query FROM read_makers", gazetteer.FIX_CUTOFF) + " SELECT * FROM hits", ("read_makers",))}))
def gazetteer_fix(spark, d):
    decl = star.declarations(spark, d).where("manufacturer_name IS NOT NULL").select("scan_id", _misread(F.col("manufacturer_name"), _k()).alias("manufacturer_name"))
    return gazetteer.gazetteer_fix(decl, _known_names(spark, d))


_FILL_LINES = f"""SELECT scan_id, unnest([0, 1, 2]) AS pos, unnest(['Best quality', {_misread_sql('generic_name')} || ', Plot 5, Main Road', 'by ' || manufacturer_name]) AS query FROM declarations"""


@R.add("gazetteer_fill", with_views("""SELECT scan_id, arg_max(name, {'s': score, 'p': -pos}) AS manufacturer_name, max(score) AS score
 FROM said JOIN hits USING (query) GROUP BY scan_id""", "hits",
    replaced={"said": (_FILL_LINES, ("declarations",)), "hits": ("WITH " + _match_sql("SELECT query FROM said WHERE query IS NOT NULL", gazetteer.FILL_CUTOFF) + " SELECT * FROM hits", ("said",))}))
def gazetteer_fill(spark, d):
    texts = star.declarations(spark, d).select("scan_id", F.concat_ws(
        "\n", F.lit("Best quality"), F.concat(_misread(F.col("generic_name"), _k()), F.lit(", Plot 5, Main Road")), F.concat(F.lit("by "), F.col("manufacturer_name"))).alias("ocr_text"))
    return gazetteer.gazetteer_fill(texts, _known_names(spark, d))


# Labels whose maker was misread; every third has lost its address line, so the maker is only found by the list.
_MAKERS_SQL = "SELECT s_name AS name, s_suppkey AS position FROM supplier"
_BROKEN_SQL = f"SELECT * REPLACE ({_misread_sql('manufacturer_name')} AS manufacturer_name) FROM declarations"
_READ_SQL = """SELECT scan_id, ocr_confidence, found, lines, CASE WHEN scan_id % 3 <> 0 THEN found END AS maker, CASE WHEN scan_id % 3 = 0 THEN [split_part(found, ', Plot ', 1)] ELSE [] END AS bare
 FROM (SELECT scan_id, ocr_confidence, string_split(ocr_text, chr(10)) AS lines, list_filter(string_split(ocr_text, chr(10)), lambda l: contains(l, ', Plot '))[1] AS found FROM label_text)"""
_ASKED_FIX, _ASKED_FILL = "SELECT DISTINCT maker AS query FROM read_labels WHERE maker IS NOT NULL", """SELECT DISTINCT query FROM filled"""
_FILLED_SQL = """SELECT scan_id, unnest(lines) AS query, unnest(range(len(lines))) AS pos FROM (SELECT scan_id,
 list_transform(lines, lambda l: CASE WHEN l = found THEN split_part(l, ', Plot ', 1) ELSE l END) AS lines FROM read_labels WHERE maker IS NULL)"""


def _hits_sql(queries, cutoff):
    return "WITH " + _match_sql(queries, cutoff).replace(_NAMES_SQL, _MAKERS_SQL) + " SELECT * FROM hits"


@R.add("extract_known_makers", with_views("""SELECT r.scan_id, CASE WHEN r.maker IS NULL THEN f.name WHEN h.name IS NULL OR contains(lower(r.maker), lower(h.name)) THEN r.maker ELSE h.name END AS manufacturer_name,
 CASE WHEN r.maker IS NULL THEN CASE WHEN f.name IS NOT NULL THEN 'inferred' END WHEN h.name IS NOT NULL AND NOT contains(lower(r.maker), lower(h.name)) THEN 'inferred'
  WHEN r.ocr_confidence < 60 THEN 'uncertain' ELSE 'read' END AS source
FROM read_labels r LEFT JOIN fix_hits h ON h.query = r.maker
LEFT JOIN (SELECT scan_id, arg_max(name, {'s': score, 'p': -pos}) AS name FROM filled JOIN fill_hits USING (query) GROUP BY scan_id) f ON f.scan_id = r.scan_id""", "fix_hits", "fill_hits",
    replaced={"misread": (_BROKEN_SQL, ("declarations",)), "label_text": (LABEL_TEXT.replace("FROM declarations", "FROM misread"), ("misread",)), "read_labels": (_READ_SQL, ("label_text",)),
              "filled": (_FILLED_SQL, ("read_labels",)), "fix_hits": (_hits_sql(_ASKED_FIX, gazetteer.FIX_CUTOFF), ("read_labels",)), "fill_hits": (_hits_sql(_ASKED_FILL, gazetteer.FILL_CUTOFF), ("filled",))}))
def extract_known_makers(spark, d):
    """Declarations from labels, with the list of known makers inside extraction."""
    decl = star.declarations(spark, d).withColumn("manufacturer_name", _misread(F.col("manufacturer_name"), _k()))
    bare = F.when(_k() % 3 == 0, F.regexp_replace("ocr_text", r", Plot [^\n]*", "")).otherwise(F.col("ocr_text"))
    labels = star.compose_label(decl).withColumn("ocr_text", bare)
    names = star.read(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("position"))
    return extraction.extract_declarations(labels, names).select(
        "scan_id", "manufacturer_name", F.try_element_at("field_sources", F.lit("manufacturer_name")).alias("source"))


@R.add("gazetteer_names", """SELECT name FROM (SELECT trim(n) AS name, row_number() OVER (PARTITION BY lower(trim(n)) ORDER BY src, pos) AS rn FROM (
  SELECT CASE WHEN s_suppkey % 2 = 0 THEN '  ' || s_name ELSE upper(s_name) END AS n, 0 AS src, s_suppkey AS pos FROM supplier
  UNION ALL SELECT s_name, 1, s_suppkey FROM supplier UNION ALL SELECT p_brand, 2, p_partkey FROM part) WHERE trim(n) <> '') WHERE rn = 1""")
def gazetteer_names(spark, d):
    k = F.col("s_suppkey")
    listed = star.read(spark, d, "supplier").select(F.when(k % 2 == 0, F.concat(F.lit("  "), "s_name")).otherwise(F.upper("s_name")).alias("raw"), k.alias("pos"))
    again = star.read(spark, d, "supplier").select(F.col("s_name").alias("raw"), k.alias("pos"))
    brands = star.read(spark, d, "part").select(F.col("p_brand").alias("raw"), F.col("p_partkey").alias("pos"))
    return gazetteer.canonical_names(listed, again, brands).select("name")


@R.add("gazetteer_files", "SELECT DISTINCT s_name AS name FROM supplier UNION SELECT DISTINCT p_brand FROM part")
def gazetteer_files(spark, d):
    """The two list formats written from the tables and read back."""
    names, brands = scratch_path(spark, "names"), scratch_path(spark, "brands")
    star.read(spark, d, "supplier").select(F.array("s_name").alias("names")).write.json(names)
    corpus.write_jsonl(star.read(spark, d, "part").select(F.col("p_brand").alias("brand")).distinct(), brands, order_by="brand")
    return gazetteer.canonical_names(*corpus.gazetteer_lists(spark, names, brands, multi_line=False)).select("name")


# --- places of patterns, as SQL -------------------------------------------------------------------
def _places_sql(pattern, more=""):
    """Matches of a pattern in every label with their places, from the gaps between them."""
    sizes = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda x: length(x))), 0)"
    return f"""SELECT doc_id, no, ms[no] AS m{more}, ({sizes("gs[1:no]")} + {sizes("ms[1:no - 1]")})::BIGINT AS s FROM (
 SELECT *, unnest(range(1, len(ms) + 1)) AS no FROM (SELECT scan_id AS doc_id, regexp_extract_all(ocr_text, {quote(pattern)}) AS ms, string_split_regex(ocr_text, {quote(pattern)}) AS gs FROM label_text))"""


_TOKENS_SQL = "SELECT doc_id, no - 1 AS tok, m AS token, s, s + length(m) AS e FROM (" + _places_sql(r"\S+") + ")"
_ENTITIES_SQL = "SELECT doc_id, rank, no, label, s, s + length(m) AS e FROM (" + " UNION ALL ".join(
    _places_sql(f"(?{flags})" + pattern, f", {rank} AS rank, {quote(label)} AS label") for rank, (label, pattern, flags) in enumerate(fv.ENTITY_PATTERNS)) + ") WHERE length(m) > 0"
_BIO_SQL = """SELECT t.doc_id, t.tok, t.token, coalesce(CASE WHEN t.tok = o.opens THEN 'B-' ELSE 'I-' END || o.label, 'O') AS tag FROM tokens t LEFT JOIN (
 SELECT doc_id, tok, label, min(tok) OVER (PARTITION BY doc_id, rank, no) AS opens FROM (
  SELECT t.doc_id, t.tok, x.rank, x.no, x.label FROM tokens t JOIN entities x ON x.doc_id = t.doc_id AND t.e > x.s AND t.s < x.e
  QUALIFY row_number() OVER (PARTITION BY t.doc_id, t.tok ORDER BY x.rank, x.no) = 1)) o ON o.doc_id = t.doc_id AND o.tok = t.tok"""
_TAG_VIEWS = {"tokens": (_TOKENS_SQL, ("label_text",)), "entities": (_ENTITIES_SQL, ("label_text",)), "bio": (_BIO_SQL, ("tokens", "entities"))}


# --- corpus files --------------------------------------------------------------------------------
@R.add("label_corpus", with_views(
    "SELECT 'label_' || scan_id || '.png' AS image, len(string_split(ocr_text, chr(10))) AS n_lines, violation, generic_name, mrp FROM label_text JOIN declarations USING (scan_id)", "label_text", "declarations"))
def label_corpus(spark, d):
    path = scratch_path(spark, "label-corpus")
    rows = star.with_label(star.declarations(spark, d)).select(
        F.concat(F.lit("label_"), _k().cast("string"), F.lit(".png")).alias("image"), F.split("ocr_text", "\n").alias("lines"),
        F.struct("generic_name", "violation", "net_quantity_value", "net_quantity_unit", "mrp").alias("truth"))
    corpus.write_jsonl(rows, path)
    return corpus.label_corpus(spark, path).select("image", F.size("lines").cast("bigint").alias("n_lines"), "truth.violation", "truth.generic_name", "truth.mrp")


@R.add("prelabels", "SELECT 'doc_' || doc_id AS image, length(text) AS n, CAST(doc_id % 100 AS DOUBLE) AS confidence FROM documents")
def prelabels(spark, d):
    path = scratch_path(spark, "prelabels")
    doc = F.col("doc_id")
    good = star.read(spark, d, "documents").select(F.to_json(F.struct(
        F.concat(F.lit("doc_"), doc.cast("string")).alias("image"), "text", (doc % 100).cast("double").alias("confidence"))).alias("value"))
    broken = star.read(spark, d, "documents").where(doc % 50 == 0).select(F.lit('{"image": "cut').alias("value"))
    good.unionByName(broken).write.text(path)
    rows = settle(corpus.prelabels(spark, path), "prelabel-rows")
    return rows.where("_corrupt_record IS NULL").select("image", F.length("text").cast("bigint").alias("n"), "confidence")


# The four sinks, read back.
@R.add("sink_prelabels", "SELECT 'doc_' || doc_id AS image, length(text) AS n, CAST(doc_id % 100 AS DOUBLE) AS confidence FROM documents")
def sink_prelabels(spark, d):
    path, doc = scratch_path(spark, "sink-prelabels"), F.col("doc_id")
    corpus.write_jsonl(star.read(spark, d, "documents").select(
        F.concat(F.lit("doc_"), doc.cast("string")).alias("image"), "text", (doc % 100).cast("double").alias("confidence")), path)
    return corpus.prelabels(spark, path).select("image", F.length("text").cast("bigint").alias("n"), "confidence")


@R.add("sink_brands", """SELECT brand, example, code, row_number() OVER (ORDER BY lower(brand), brand) - 1 AS line_no FROM (
 SELECT brand, min_by(p_name, p_partkey) AS example, lpad(CAST(min(p_partkey) AS VARCHAR), 8, '0') AS code FROM (
  SELECT p_brand AS brand, p_name, p_partkey FROM part UNION ALL SELECT upper(p_type), p_name, p_partkey FROM part) GROUP BY brand)""")
def sink_brands(spark, d):
    """Brands in case-insensitive order over all files: the order is read off file names and places, not sorted again."""
    path = scratch_path(spark, "sink-brands")
    corpus.write_jsonl(corpus.distinct_brands(_products(spark, d)), path, order_by="brand")
    return corpus.read_in_order(spark, path, "brand string, example string, code string")


@R.add("sink_bio", with_views("SELECT doc_id, (SELECT ocr_text FROM label_text WHERE scan_id = doc_id) AS text, string_agg(token || chr(9) || tag, chr(10) ORDER BY tok) AS bio FROM bio GROUP BY doc_id", "bio", "label_text", replaced=_TAG_VIEWS))
def sink_bio(spark, d):
    path, docs = scratch_path(spark, "sink-bio"), settle(_label_docs(spark, d), "label-docs")
    corpus.write_jsonl(tagging.bio_rows(docs, tagging.bio_from_patterns(docs)).where("size(bio) > 0"), path)
    back = spark.read.schema("doc_id long, text string, bio array<array<string>>").json(path)
    return back.select("doc_id", "text", F.array_join(F.transform("bio", lambda p: F.array_join(p, "\t")), "\n").alias("bio"))


@R.add("sink_corpus", with_views("SELECT scan_id, ocr_text AS lines, violation, manufacturer_name FROM label_text JOIN declarations USING (scan_id)", "label_text", "declarations"))
def sink_corpus(spark, d):
    path = scratch_path(spark, "sink-corpus")
    labelled = star.with_label(star.declarations(spark, d))
    corpus.write_jsonl(labelled.select("scan_id", F.split("ocr_text", "\n").alias("lines"), F.struct("violation", "manufacturer_name").alias("truth")), path)
    back = spark.read.schema("scan_id long, lines array<string>, truth struct<violation:string, manufacturer_name:string>").json(path)
    return back.select("scan_id", F.array_join("lines", "\n").alias("lines"), "truth.violation", "truth.manufacturer_name")


@R.add("eval_truth", "SELECT 's_' || s_suppkey AS image, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE s_name || ',' || s_nationkey END AS makers, 'mrp,exp' AS absent FROM supplier")
def eval_truth(spark, d):
    path = scratch_path(spark, "truth")
    k = F.col("s_suppkey")
    one = F.to_json(F.struct(F.concat(F.lit("s_"), k.cast("string")).alias("image"), F.struct(F.col("s_name").alias("manufacturer_sub")).alias("truth"), F.array(F.lit("mrp"), F.lit("exp")).alias("absent")))
    many = F.to_json(F.struct(F.concat(F.lit("s_"), k.cast("string")).alias("image"), F.struct(F.array("s_name", F.col("s_nationkey").cast("string")).alias("manufacturer_sub")).alias("truth"), F.array(F.lit("mrp"), F.lit("exp")).alias("absent")))
    star.read(spark, d, "supplier").select(F.when(k % 2 == 0, one).otherwise(many).alias("value")).write.text(path)
    return corpus.eval_truth(spark, path).select("image", F.array_join("makers", ",").alias("makers"), F.array_join("absent", ",").alias("absent"))


@R.add("labelstudio_spans", "SELECT p_name || ' ' || p_partkey AS text, 0 AS s, length(p_name) AS e, p_brand AS label FROM part WHERE p_partkey % 3 <> 0")
def labelstudio_spans(spark, d):
    path = scratch_path(spark, "studio")
    k = F.col("p_partkey")
    result = F.struct(F.when(k % 3 == 0, "choices").otherwise("labels").alias("type"), F.struct(
        F.lit(0).alias("start"), F.length("p_name").alias("end"), F.array("p_brand").alias("labels")).alias("value"))
    star.read(spark, d, "part").select(F.concat_ws(" ", "p_name", k.cast("string")).alias("text"),
                                       F.array(F.struct(F.array(result).alias("result"))).alias("annotations")).write.json(path)
    return corpus.labelstudio_spans(spark, path, multi_line=False).select("text", F.col("start").alias("s"), F.col("end").cast("bigint").alias("e"), F.get("labels", 0).alias("label"))


@R.add("labelstudio_tasks", "SELECT CASE WHEN page_id % 3 = 0 THEN url ELSE 'data/backs/p' || page_id END AS image, length(html) AS n, CAST(0 AS DOUBLE) AS ocr_confidence FROM pages")
def labelstudio_tasks(spark, d):
    rows = star.read(spark, d, "pages").select(F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.concat(F.lit("p"), F.col("page_id").cast("string"))).alias("image"),
                                               F.col("html").alias("text"), F.lit(None).cast("double").alias("confidence"))
    return corpus.labelstudio_tasks(rows, prefix="data/backs/").select("data.image", F.length("data.text").cast("bigint").alias("n"), "data.ocr_confidence")


@R.add("scan_history_source", with_views("SELECT scan_id, verdict, status FROM scans", "scans"))
def scan_history_source(spark, d):
    """Stored scans with a binary column next to them; the list reads only what it shows."""
    stored = settle(star.scans(spark, d).withColumn("image_blob", F.encode("ocr_text", "UTF-8")), "stored-scans")
    return stored.select("scan_id", "verdict", "status")


@R.add("declaration_snapshot", with_views(
    "SELECT scan_id, CASE WHEN scan_id % 10 <> 3 THEN generic_name END AS generic_name, CASE WHEN scan_id % 10 <> 3 THEN CAST(mfg_date AS VARCHAR) END AS mfg_date, CASE WHEN scan_id % 10 <> 3 THEN mrp END AS mrp FROM declarations", "declarations"))
def declaration_snapshot(spark, d):
    packed = corpus.to_snapshot(star.declarations(spark, d))
    damaged = packed.withColumn("declaration_json", F.when(_k() % 10 == 3, "{not json").otherwise(F.replace("declaration_json", F.lit('{"manu'), F.lit('{"old_key":1,"manu'))))
    return corpus.from_snapshot(damaged).select("scan_id", "generic_name", F.col("mfg_date").cast("string").alias("mfg_date"), "mrp")


@R.add("findings_backfill", with_views("SELECT scan_id, rule_id, status, CAST(status = 'PASS' AS INTEGER) AS passed, '' AS cause, 'info' AS severity FROM findings", "findings"))
def findings_backfill(spark, d):
    old = rules.findings(star.declarations(spark, d)).groupBy("scan_id").agg(F.collect_list(F.struct("rule_id", "status", "message")).alias("r"))
    rows = old.select("scan_id", F.to_json("r").alias("results_json"))
    return corpus.findings_backfill(rows).select("scan_id", "rule_id", "status", F.col("passed").cast("int").alias("passed"), "cause", "severity")


@R.add("boxes_backfill", with_views("SELECT scan_id, frame_index AS x, text_length AS w FROM order_frames WHERE part_id % 9 <> 0", "order_frames"))
def boxes_backfill(spark, d):
    box = F.struct(F.when(F.col("part_id") % 9 == 0, "bad").otherwise(F.col("frame_index").cast("string")).alias("x"), F.col("text_length").alias("w"))
    rows = star.order_frames(spark, d).groupBy("scan_id").agg(F.to_json(F.collect_list(box)).alias("boxes_json"))
    return corpus.boxes_backfill(rows).select("scan_id", F.col("x").cast("bigint").alias("x"), F.col("w").cast("bigint").alias("w"))


@R.add("findings_backfill_damaged", with_views(
    "SELECT scan_id, rule_id, status FROM findings WHERE scan_id % 11 <> 5 UNION ALL SELECT scan_id, NULL, NULL FROM declarations WHERE scan_id % 11 = 5", "findings", "declarations"))
def findings_backfill_damaged(spark, d):
    """Every list holds elements that are no findings; some texts are cut short or no list."""
    old = rules.findings(star.declarations(spark, d)).groupBy("scan_id").agg(F.to_json(F.collect_list(F.struct("rule_id", "status"))).alias("r"))
    damaged = F.when(_k() % 22 == 5, "{broken").when(_k() % 11 == 5, '"text"').otherwise(F.concat(F.lit('["loose", 7, null, '), F.substr("r", F.lit(2))))
    rows = old.withColumn("results_json", damaged)
    out = corpus.findings_backfill(rows)
    return out.select("scan_id", "rule_id", F.when(F.col("rule_id").isNotNull(), F.col("status")).alias("status"))


@R.add("boxes_backfill_damaged", with_views("SELECT scan_id, frame_index AS x, text_length AS w, 0 AS y FROM order_frames WHERE part_id % 9 <> 0", "order_frames"))
def boxes_backfill_damaged(spark, d):
    """A null number skips its box, an absent one is 0, and elements that are no boxes skip only themselves."""
    x = F.when(F.col("part_id") % 9 == 0, F.lit("null")).otherwise(F.col("frame_index").cast("string"))
    box = F.concat(F.lit('{"x": '), x, F.lit(', "w": '), F.col("text_length").cast("string"), F.lit("}"))
    rows = star.order_frames(spark, d).groupBy("scan_id").agg(F.concat(F.lit('["loose", null, '), F.array_join(F.collect_list(box), ", "), F.lit("]")).alias("boxes_json"))
    return corpus.boxes_backfill(rows).select("scan_id", *[F.col(c).cast("bigint").alias(c) for c in ("x", "w", "y")])


def _products(spark, d):
    k = F.col("p_partkey")
    code = F.lpad(k.cast("string"), 8, "0")
    url = F.concat(F.lit("http://img.example/"), k.cast("string"), F.lit(".400.jpg"))
    return star.read(spark, d, "part").select(code.alias("code"), F.col("p_name").alias("product_name"), k.alias("pos"),
                                              F.when(k % 2 == 0, url).alias("image_ingredients_url"), F.when(k % 3 == 0, url).alias("image_nutrition_url"),
                                              F.when(k % 5 != 0, url).alias("image_packaging_url"), F.concat_ws(" , ", "p_brand", F.upper("p_type"), F.lit("x")).alias("brands"))


@R.add("panel_manifest", """SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS code, panel, 'http://img.example/' || p_partkey || '.full.jpg' AS image_url FROM part,
 (VALUES ('ingredients', 2), ('nutrition', 3)) v(panel, m) WHERE p_partkey % m = 0 ORDER BY code, panel LIMIT 600""")
def panel_manifest(spark, d):
    return corpus.panel_manifest(_products(spark, d), limit=300).select("code", "panel", "image_url")


@R.add("packaging_manifest", """SELECT code, image_url FROM (SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS code, 'http://img.example/' || p_partkey || '.full.jpg' AS image_url,
 CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 1 END AS later FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 5 <> 0) ORDER BY later, code LIMIT 900""")
def packaging_manifest(spark, d):
    p = _products(spark, d)
    have = p.where(F.col("pos") % 7 == 0).select("code", F.concat(F.lit("http://img.example/"), F.col("pos").cast("string"), F.lit(".full.jpg")).alias("image_url"))
    return corpus.packaging_manifest(have, p, limit=900)


@R.add("distinct_brands", """SELECT brand, min_by(p_name, p_partkey) AS example, lpad(CAST(min(p_partkey) AS VARCHAR), 8, '0') AS code FROM (
 SELECT p_brand AS brand, p_name, p_partkey FROM part UNION ALL SELECT upper(p_type), p_name, p_partkey FROM part) GROUP BY brand""")
def distinct_brands(spark, d):
    return corpus.distinct_brands(_products(spark, d))


# --- tags and spans ------------------------------------------------------------------------------
def _label_docs(spark, d):
    return star.label_text(spark, d).select(F.col("scan_id").alias("doc_id"), F.col("ocr_text").alias("text"))


@R.add("bio_from_patterns", with_views("SELECT doc_id, tok, token, tag FROM bio", "bio", replaced=_TAG_VIEWS))
def bio_from_patterns(spark, d):
    return tagging.bio_from_patterns(_label_docs(spark, d))


@R.add("bio_tag_tokens", with_views("""SELECT t.doc_id, t.tok, t.token, coalesce(o.tag, 'O') AS tag FROM tokens t LEFT JOIN (
 SELECT doc_id, tok, arg_max(tag, no) AS tag FROM (
  SELECT t.doc_id, t.tok, x.no, CASE WHEN t.tok = min(t.tok) OVER (PARTITION BY t.doc_id, x.no) THEN 'B-' ELSE 'I-' END || x.label AS tag
  FROM tokens t JOIN marked x ON x.doc_id = t.doc_id AND t.e > x.s AND t.s < x.e) GROUP BY doc_id, tok) o ON o.doc_id = t.doc_id AND o.tok = t.tok""", "tokens", "marked", replaced=_TAG_VIEWS | {
    "marked": ("""SELECT scan_id AS doc_id, 0 AS no, 0 AS s, least(length(ocr_text), 12) AS e, 'NAME' AS label FROM label_text
      UNION ALL SELECT scan_id, 1, 8, least(length(ocr_text), 30), CASE WHEN scan_id % 2 = 0 THEN 'MAKER' ELSE 'ENT' END FROM label_text""", ("label_text",))}))
def bio_tag_tokens(spark, d):
    docs = settle(_label_docs(spark, d), "label-docs")
    n = F.length("text")
    spans = docs.select("doc_id", F.inline(F.array(
        F.struct(F.lit(0).alias("span_no"), F.lit(0).alias("s_start"), F.least(n, F.lit(12)).alias("s_end"), F.lit("NAME").alias("label")),
        F.struct(F.lit(1).alias("span_no"), F.lit(8).alias("s_start"), F.least(n, F.lit(30)).alias("s_end"), F.when(F.col("doc_id") % 2 == 0, "MAKER").alias("label")))))
    return tagging.bio_tag_tokens(docs, spans)


@R.add("entity_spans", with_views("""SELECT doc_id, start, label, coalesce(min(CASE WHEN tok > start AND tag <> 'I-' || label THEN tok END), max(tok) + 1) AS "end" FROM (
 SELECT *, first_value(substr(tag, 3)) OVER (PARTITION BY doc_id, start ORDER BY tok) AS label FROM (
  SELECT *, max(CASE WHEN starts_with(tag, 'B-') THEN tok END) OVER (PARTITION BY doc_id ORDER BY tok) AS start FROM bio) WHERE start IS NOT NULL)
 GROUP BY doc_id, start, label""", "bio", replaced=_TAG_VIEWS))
def entity_spans(spark, d):
    return tagging.entity_spans(tagging.bio_from_patterns(_label_docs(spark, d)))


def _gold_pred(spark, d):
    li = star.read(spark, d, "lineitem").select(
        F.when(F.col("l_orderkey") % 2 == 0, "synthetic").otherwise("real").alias("source"), F.col("l_orderkey").alias("doc_id"),
        (F.col("l_linenumber") * 3).alias("start"), (F.col("l_linenumber") * 3 + 2).alias("end"), F.col("l_returnflag").alias("label"), "l_partkey")
    pred = li.where("l_partkey % 7 <> 0").withColumn("label", F.when(F.col("l_partkey") % 11 == 0, "X").otherwise(F.col("label")))
    return li, pred


_SPANS = """g AS (SELECT DISTINCT CASE WHEN l_orderkey % 2 = 0 THEN 'synthetic' ELSE 'real' END AS source, l_orderkey AS doc_id, l_linenumber AS s, l_returnflag AS label FROM lineitem),
 p AS (SELECT DISTINCT CASE WHEN l_orderkey % 2 = 0 THEN 'synthetic' ELSE 'real' END AS source, l_orderkey AS doc_id, l_linenumber AS s, CASE WHEN l_partkey % 11 = 0 THEN 'X' ELSE l_returnflag END AS label FROM lineitem WHERE l_partkey % 7 <> 0),
 j AS (SELECT COALESCE(g.source, p.source) AS source, COALESCE(g.doc_id, p.doc_id) AS doc_id, CASE WHEN g.s IS NULL THEN 'predicted' WHEN p.s IS NULL THEN 'gold' ELSE 'both' END AS side
  FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.s = p.s AND g.label = p.label)"""


@R.add("span_sets", f"WITH {_SPANS} SELECT source, doc_id, side, count(*) AS n FROM j GROUP BY ALL")
def span_sets(spark, d):
    return tagging.span_sets(*_gold_pred(spark, d)).groupBy("source", "doc_id", "side").agg(F.count(F.lit(1)).alias("n"))


@R.add("span_prf", f"""WITH {_SPANS}, c AS (SELECT source, count(*) FILTER (side = 'both') AS tp, count(*) FILTER (side = 'predicted') AS fp, count(*) FILTER (side = 'gold') AS fn FROM j GROUP BY source)
 SELECT source, round_even(tp / (tp + fp), 3) AS precision, round_even(tp / (tp + fn), 3) AS recall, round_even(2.0::DOUBLE * tp / (2 * tp + fp + fn), 3) AS f1, tp + fn AS support FROM c""")
def span_prf(spark, d):
    return tagging.span_prf(*_gold_pred(spark, d))


@R.add("corpus_union", "SELECT 'synthetic' AS source, item_id AS doc_id, text FROM benchmark UNION ALL SELECT 'real', doc_id, text FROM documents")
def corpus_union(spark, d):
    return tagging.corpus_union(star.read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), star.read(spark, d, "documents").select("doc_id", "text"))


@R.add("corpus_train_eval_split", "SELECT source, doc_id, CASE WHEN CAST('0x' || substr(md5(source || ':' || doc_id), 1, 8) AS BIGINT) % 10 = 0 THEN 'eval' ELSE 'train' END AS part FROM documents")
def corpus_train_eval_split(spark, d):
    return tagging.train_eval_split(star.read(spark, d, "documents").select("source", "doc_id"))


# --- streams -------------------------------------------------------------------------------------
@R.add("stream_findings", with_views("SELECT scan_id, verdict FROM verdicts", "verdicts"))
def stream_findings(spark, d):
    out = scratch_path(spark, "stream-findings")
    live.stream_findings(live.arriving(star.declarations(spark, d), "arriving"), out, scratch_path(spark, "cp")).awaitTermination()
    return live.verdicts_table(spark, out).select("scan_id", "verdict")


@R.add("stream_findings_rows", with_views("SELECT scan_id, rule_id, status FROM findings", "findings"))
def stream_findings_rows(spark, d):
    out = scratch_path(spark, "stream-findings")
    live.stream_findings(live.arriving(star.declarations(spark, d), "arriving"), out, scratch_path(spark, "cp")).awaitTermination()
    return live.findings_table(spark, out).select("scan_id", "rule_id", "status")


@R.add("stream_daily_volume", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY day")
def stream_daily_volume(spark, d):
    out = scratch_path(spark, "stream-daily")
    scans = star.read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("created_at"))
    live.stream_daily_volume(live.arriving(scans, "arriving"), out, scratch_path(spark, "cp")).awaitTermination()
    return live.daily_volume_table(spark, out).select(F.col("day").cast("string").alias("day"), "n")


def _transitions(spark, d):
    kinds = F.create_map(*[F.lit(x) for p in (("signup", "queued"), ("view", "working"), ("click", "working"), ("purchase", "done"), ("error", "failed")) for x in p])
    return star.read(spark, d, "events").select(F.col("user_id").alias("job_id"), "event_id", F.col("ts").alias("at"), F.element_at(kinds, F.col("event_type")).alias("status")).withColumns({
        "error": F.when(F.col("status") == "failed", F.concat(F.lit("error "), F.col("event_id").cast("string"))),
        "scan_id": F.when(F.col("status") == "done", F.col("event_id"))})


_JOBS = """SELECT job_id, status, CASE WHEN status = 'failed' THEN 'error ' || e END AS error, CASE WHEN status = 'done' THEN e END AS scan_id FROM (
 SELECT user_id AS job_id, COALESCE(arg_min(status, (ts, event_id)) FILTER (status IN ('done', 'failed')), arg_max(status, (ts, event_id))) AS status,
  COALESCE(arg_min(event_id, (ts, event_id)) FILTER (status IN ('done', 'failed')), arg_max(event_id, (ts, event_id))) AS e FROM (
 SELECT *, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'working' WHEN 'click' THEN 'working' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' END AS status FROM events) GROUP BY user_id)"""


@R.add("job_status_latest", _JOBS)
def job_status_latest(spark, d):
    return live.job_status_latest(_transitions(spark, d))


@R.add("stream_job_status", _JOBS)
def stream_job_status(spark, d):
    out = scratch_path(spark, "stream-jobs")
    live.stream_job_status(live.arriving(_transitions(spark, d), "arriving"), out, scratch_path(spark, "cp")).awaitTermination()
    return live.job_status_table(spark, out)


