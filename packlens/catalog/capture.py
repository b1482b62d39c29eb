"""Queries over frames, words, reads and barcodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from packlens.catalog.oracle_views import with_views
from packlens.catalog.registry import Registry
from packlens.functions.text import lines_of, short_number
from packlens.operators import barcodes, frames, layout, rules
from packlens.session import scratch_path, settle
from packlens.sources import captures, star

R = Registry()
L = "bigint"


# --- frame choice --------------------------------------------------------------------------------
@R.add("best_frame", with_views(
    "SELECT scan_id, frame_index AS best_index, ocr_confidence AS best_confidence FROM order_frames "
    "QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY ocr_confidence DESC, text_length DESC, frame_index) = 1", "order_frames"))
def best_frame(spark, d):
    out = frames.best_frame(star.order_frames(spark, d))
    return out.withColumn("best_index", F.col("best_index").cast(L))


_CHOSEN = """SELECT b.scan_id, b.frame_index AS best_index, b.ocr_confidence AS best_confidence, COALESCE(m.frame_index, b.frame_index) AS measured_index, n_frames
FROM (SELECT *, count(*) OVER (PARTITION BY scan_id) AS n_frames FROM order_frames
  QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY ocr_confidence DESC, text_length DESC, frame_index) = 1) b
LEFT JOIN (SELECT scan_id, frame_index FROM order_frames WHERE font_mm IS NOT NULL AND has_boxes
  QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY ocr_confidence DESC, frame_index DESC) = 1) m ON b.scan_id = m.scan_id"""


@R.add("measured_frame", with_views(_CHOSEN, "order_frames"))
def measured_frame(spark, d):
    out = frames.measured_frame(star.order_frames(spark, d))
    return out.withColumns({"best_index": F.col("best_index").cast(L), "measured_index": F.col("measured_index").cast(L)})


@R.add("measured_index", with_views(
    "SELECT scan_id, COALESCE(min(frame_index) FILTER (part_id % 4 = 0), CASE WHEN bool_or(has_blob) THEN 0 END) AS measured_index "
    "FROM order_frames GROUP BY scan_id", "order_frames"))
def measured_index(spark, d):
    flagged = star.order_frames(spark, d).withColumn("measured", F.col("part_id") % 4 == 0)
    return frames.measured_index(flagged).withColumn("measured_index", F.col("measured_index").cast(L))


@R.add("merge_warnings", with_views(
    f"""SELECT scan_id, 'Merged ' || n_frames || ' captures (best single-frame confidence ' || best_confidence || '%); text combined by confidence, evaluated once.' ||
    CASE WHEN measured_index <> best_index THEN ' | Type size measured on angle ' || (measured_index + 1) || ' (it carries the mm scale); text led by angle ' || (best_index + 1) || '.' ELSE '' END AS warnings
    FROM ({_CHOSEN})""", "order_frames"))
def merge_warnings(spark, d):
    out = frames.merge_warnings(frames.measured_frame(star.order_frames(spark, d)))
    return out.select("scan_id", F.array_join("merge_warnings", " | ").alias("warnings"))


# --- text union ----------------------------------------------------------------------------------
_UNION = """SELECT scan_id, frame_index, pos, ocr_confidence, line FROM (
  SELECT scan_id, frame_index, ocr_confidence, pos, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS line FROM (
    SELECT scan_id, frame_index, ocr_confidence, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM document_frames))
  WHERE length(line) >= 2 QUALIFY row_number() OVER (PARTITION BY scan_id, lower(line) ORDER BY ocr_confidence DESC, frame_index, pos) = 1"""


@R.add("line_union", with_views(
    f"SELECT scan_id, substr(string_agg(line, chr(10) ORDER BY ocr_confidence DESC, frame_index, pos), 1, 8000) AS ocr_text FROM ({_UNION}) GROUP BY scan_id",
    "document_frames"))
def line_union(spark, d):
    return frames.line_union(frames.union_lines(star.document_frames(spark, d))).withColumn(
        "ocr_text", frames.stored_text(F.col("ocr_text")))


@R.add("words_added", with_views(f"SELECT scan_id, frame_index, count(*) AS added FROM ({_UNION}) GROUP BY ALL", "document_frames"))
def words_added(spark, d):
    return frames.words_added(frames.union_lines(star.document_frames(spark, d))).withColumn(
        "frame_index", F.col("frame_index").cast(L))


@R.add("gallery", with_views(
    f"""SELECT s.scan_id, COALESCE(frame_index, 0) AS frame_index, 'Angle ' || (COALESCE(frame_index, 0) + 1) || CASE WHEN frame_index IS NULL OR frame_index = best_index THEN ' (Best capture)' ELSE '' END AS label
    FROM (SELECT o_orderkey AS scan_id, o_orderkey % 3 <> 0 AS has_image FROM orders) s
    LEFT JOIN ({_CHOSEN}) c ON s.scan_id = c.scan_id LEFT JOIN order_frames f ON s.scan_id = f.scan_id
    WHERE CASE WHEN frame_index IS NULL THEN has_image ELSE has_blob END""", "order_frames"))
def gallery(spark, d):
    fr = star.order_frames(spark, d)
    scans = star.read(spark, d, "orders").select(F.col("o_orderkey").alias("scan_id"), (F.col("o_orderkey") % 3 != 0).alias("has_image"))
    scans = scans.join(frames.best_frame(fr), "scan_id", "left")
    out = frames.gallery(scans, fr.select("scan_id", "frame_index", "has_blob"))
    return out.select("scan_id", F.col("frame_index").cast(L).alias("frame_index"), "label")


@R.add("capture_quarantine", with_views(
    """SELECT scan_id, frame_index, CASE WHEN count(*) OVER (PARTITION BY scan_id) NOT BETWEEN 2 AND 5 THEN '422 send 2-5 images of the same label'
    WHEN part_id % 13 = 0 THEN '415 unsupported type' WHEN part_id % 7 = 0 THEN '400 empty file' WHEN part_id * 9001 > 10485760 THEN '413 file too large' ELSE 'accepted' END AS reason
    FROM order_frames""", "order_frames"))
def capture_quarantine(spark, d):
    part = F.col("part_id")
    captures = star.order_frames(spark, d).select(
        "scan_id", "frame_index", F.when(part % 13 == 0, "image/gif").otherwise("image/jpeg").alias("content_type"),
        F.when(part % 7 == 0, 0).otherwise(part * 9001).alias("length"))
    return frames.capture_quarantine(captures).select("scan_id", F.col("frame_index").cast(L).alias("frame_index"), "reason")


# Every document is a capture file; the largest are over the limit that the query sets.
@R.add("capture_files", """SELECT scan_id, frame_index, content_type, length, CASE WHEN count(*) OVER (PARTITION BY scan_id) NOT BETWEEN 2 AND 5 THEN '422 send 2-5 images of the same label'
    WHEN content_type IS NULL OR content_type = 'image/gif' THEN '415 unsupported type' WHEN length > 4000 THEN '413 file too large' ELSE 'accepted' END AS reason FROM (
 SELECT doc_id // 3 AS scan_id, doc_id % 3 AS frame_index, CASE doc_id % 5 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/webp' WHEN 3 THEN 'image/gif' END AS content_type,
  octet_length(encode(text)) + 1 AS length FROM documents)""")
def capture_files(spark, d):
    path, k = scratch_path(spark, "captures"), F.col("doc_id")
    kinds = F.array(*[F.lit(x) for x in ("jpg", "PNG", "webp", "gif", "bmp")])
    rows = star.read(spark, d, "documents").select(
        F.expr("doc_id div 3").alias("scan_id"), (k % 3).alias("frame_index"), F.get(kinds, (k % 5).cast("int")).alias("kind"), F.col("text").alias("value"))
    captures.write_captures(rows, path)
    gated = frames.capture_quarantine(settle(captures.capture_files(spark, path), "capture-list"), max_bytes=4000)
    return gated.select("scan_id", F.col("frame_index").cast(L).alias("frame_index"), "content_type", "length", "reason")


_READS = """SELECT doc_id // 4 AS scan_id, CASE doc_id % 4 WHEN 2 THEN 'florence' WHEN 3 THEN 'vlm' ELSE 'tesseract' END AS engine, doc_id % 4 AS config_no,
  CASE WHEN doc_id % 11 = 0 THEN '  ' ELSE text END AS text, CASE WHEN doc_id % 4 < 2 THEN CAST((doc_id * 37) % 101 AS DOUBLE) ELSE 0.0 END AS confidence FROM documents"""


@R.add("read_arbitration", f"""WITH reads AS ({_READS}), g AS (SELECT scan_id,
  max(text) FILTER (config_no = 0 AND trim(text) <> '') AS t0, max(confidence) FILTER (config_no = 0 AND trim(text) <> '') AS c0,
  max(text) FILTER (config_no = 1 AND trim(text) <> '') AS t1, max(confidence) FILTER (config_no = 1 AND trim(text) <> '') AS c1,
  max(text) FILTER (config_no = 2 AND trim(text) <> '') AS tf, max(text) FILTER (config_no = 3 AND trim(text) <> '') AS tv FROM reads GROUP BY scan_id),
 p AS (SELECT *, CASE WHEN t0 IS NULL THEN t1 WHEN t1 IS NOT NULL AND c0 < 80 AND c1 > c0 THEN t1 ELSE t0 END AS pt,
  CASE WHEN t0 IS NULL THEN c1 WHEN t1 IS NOT NULL AND c0 < 80 AND c1 > c0 THEN c1 ELSE c0 END AS pc FROM g)
SELECT scan_id, CASE WHEN tf IS NOT NULL AND (pt IS NULL OR (pc < 60 AND length(tf) > length(pt))) THEN 'florence'
  WHEN tv IS NOT NULL AND (pt IS NULL OR (pc < 60 AND length(tv) > length(pt))) THEN 'vlm' WHEN pt IS NOT NULL THEN 'tesseract' ELSE 'none' END AS ocr_engine,
 CASE WHEN tf IS NOT NULL AND (pt IS NULL OR (pc < 60 AND length(tf) > length(pt))) THEN tf
  WHEN tv IS NOT NULL AND (pt IS NULL OR (pc < 60 AND length(tv) > length(pt))) THEN tv ELSE COALESCE(pt, '') END AS ocr_text FROM p""")
def read_arbitration(spark, d):
    doc = F.col("doc_id")
    reads = star.read(spark, d, "documents").select(
        F.expr("doc_id div 4").alias("scan_id"),
        F.when(doc % 4 == 2, "florence").when(doc % 4 == 3, "vlm").otherwise("tesseract").alias("engine"),
        (doc % 4).cast("int").alias("config_no"), F.when(doc % 11 == 0, "  ").otherwise(F.col("text")).alias("text"),
        F.when(doc % 4 < 2, ((doc * 37) % 101).cast("double")).otherwise(0.0).alias("confidence"))
    return frames.read_arbitration(reads).select("scan_id", "ocr_engine", "ocr_text")


# --- words ---------------------------------------------------------------------------------------
@R.add("box_cap", with_views(
    "SELECT scan_id, ord, text FROM words QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY ord) <= 500", "words"))
def box_cap(spark, d):
    return frames.box_cap(star.words(spark, d)).select("scan_id", "ord", "text")


@R.add("line_rebuild", with_views(
    "SELECT scan_id, min(ord) AS run_start, string_agg(text, ' ' ORDER BY ord) AS line FROM words GROUP BY scan_id, line_no", "words"))
def line_rebuild(spark, d):
    w = star.words(spark, d).withColumns({
        "block": F.floor(F.col("line_no") / 12), "par": F.floor(F.col("line_no") / 4), "line": F.col("line_no") % 4})
    return frames.line_rebuild(w)


@R.add("word_conf_mean", with_views(
    "SELECT scan_id, COALESCE(round_even(avg(confidence) FILTER (confidence >= 0), 1), 0.0) AS ocr_confidence FROM words GROUP BY scan_id", "words"))
def word_conf_mean(spark, d):
    return frames.word_conf_mean(star.words(spark, d))


@R.add("box_medians", with_views(
    """SELECT scan_id, CAST(list_sort(list(h))[len(list(h)) // 2 + 1] AS DOUBLE) AS upper_h, CAST(median(h) AS DOUBLE) AS true_h,
    round_even(list_sort(list(w / h))[len(list(h)) // 2 + 1], 3) AS upper_ratio, round_even(median(w / h), 3) AS true_ratio FROM words GROUP BY scan_id""", "words"))
def box_medians(spark, d):
    return frames.box_medians(star.words(spark, d))


@R.add("font_mm", with_views(
    "SELECT scan_id, ord, round_even(h / (x / 85.6::DOUBLE), 2) AS font_mm FROM words WHERE x > 0 UNION ALL SELECT scan_id, ord, NULL FROM words WHERE x = 0", "words"))
def font_mm(spark, d):
    return star.words(spark, d).select("scan_id", "ord", frames.font_mm(
        F.col("h"), frames.ppm_estimate(F.col("x").cast("double"), F.lit(85.6))).alias("font_mm"))


@R.add("measure_gate", with_views(
    """SELECT d.scan_id, CASE WHEN any_m THEN font ELSE min_numeral_height_mm END AS numeral, CASE WHEN any_m THEN ratio ELSE min_width_to_height_ratio END AS ratio,
    CAST(CASE WHEN any_m THEN d.scan_id % 2 = 0 ELSE is_embossed END AS INTEGER) AS embossed, CASE WHEN any_m THEN 77.0 ELSE panel_area_cm2 END AS panel
    FROM (SELECT *, CASE WHEN scan_id % 3 = 0 THEN scan_id % 40 / 10 END AS font, CASE WHEN scan_id % 5 = 0 THEN 0.5 END AS ratio,
      (scan_id % 3 = 0 OR scan_id % 5 = 0) AND scan_id % 4 <> 0 AS any_m FROM declarations) d""", "declarations"))
def measure_gate(spark, d):
    k = F.col("scan_id")
    decl = star.declarations(spark, d)
    some = decl.where(k % 4 != 0).select(
        "scan_id", F.when(k % 3 == 0, k % 40 / 10).alias("font_mm"), F.lit(None).cast("double").alias("letter_mm"),
        F.when(k % 5 == 0, 0.5).alias("ratio"), (k % 2 == 0).alias("embossed"), F.lit(77.0).alias("panel"))
    return frames.measure_gate(decl, some).select(
        "scan_id", F.col("min_numeral_height_mm").alias("numeral"), F.col("min_width_to_height_ratio").alias("ratio"),
        F.col("is_embossed").cast("int").alias("embossed"), F.col("panel_area_cm2").alias("panel"))


_VISUAL = """SELECT scan_id, line_no, string_agg(text, ' ' ORDER BY x) AS text, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1, avg(confidence) AS conf
FROM words GROUP BY scan_id, line_no"""


@R.add("visual_lines", with_views(f"SELECT scan_id, text, x0, y0, x1, y1, conf FROM ({_VISUAL})", "words"))
def visual_lines(spark, d):
    return layout.visual_lines(star.words(spark, d)).select("scan_id", "text", "x0", "y0", "x1", "y1", "conf")


@R.add("visual_lines_skewed")
def visual_lines_skewed(spark, d):
    """Slanted captures: rows drift into each other, so the sequential fold decides."""
    slanted = star.words(spark, d).withColumn("y", F.col("y") + (F.col("ord") * 7919) % 19)
    return layout.visual_lines(slanted).select("scan_id", "text", "x0", "y0", "x1", "y1", "conf")


_ANCHOR = f"SELECT * FROM ({_VISUAL}) WHERE regexp_matches(text, '(?i)the') QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY y0, x0) = 1"


@R.add("rows_below", with_views(
    f"""SELECT l.scan_id, l.y0, l.text, row_number() OVER (PARTITION BY l.scan_id ORDER BY l.y0, l.x0) AS nth FROM ({_VISUAL}) l JOIN ({_ANCHOR}) a ON l.scan_id = a.scan_id
    WHERE l.line_no > a.line_no AND l.y0 >= a.y1 - 2 QUALIFY nth <= 3""", "words"))
def rows_below(spark, d):
    lines = settle(layout.visual_lines(star.words(spark, d)), "lines")
    out = layout.rows_below(lines, layout.anchor_rows(lines, "(?i)the"), k=3)
    return out.select("scan_id", "y0", "text", F.col("nth").cast(L).alias("nth"))


_HALVES = _VISUAL.replace("GROUP BY scan_id, line_no", "GROUP BY scan_id, line_no, half").replace(
    "FROM words", "FROM (SELECT * REPLACE (y + half * 16 AS y) FROM (SELECT *, CASE WHEN x >= 600 THEN 1 ELSE 0 END AS half FROM (SELECT * REPLACE (y + line_no * 65 AS y) FROM words)))").replace("line_no,", "line_no, half,")


@R.add("row_mates", with_views(
    f"""WITH v AS ({_HALVES}), a AS (SELECT * FROM v WHERE regexp_matches(text, '(?i)the') QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY y0, x0) = 1)
    SELECT v.scan_id, v.y0, v.text FROM v JOIN a ON v.scan_id = a.scan_id WHERE NOT (v.line_no = a.line_no AND v.half = a.half) AND v.y0 <= a.y1 AND v.y1 >= a.y0""".replace("WITH v AS", ", v AS"), "words")
    .replace("\n, v AS", ",\nv AS"))
def row_mates(spark, d):
    """Two columns of a label, the right one printed lower but overlapping the same band."""
    half = F.when(F.col("x") >= 600, 1).otherwise(0)
    tall = star.words(spark, d).withColumn("y", F.col("y") + F.col("line_no") * 65 + half * 16).withColumn("h", F.col("h"))
    lines = settle(layout.visual_lines(tall), "lines")
    return layout.row_mates(lines, layout.anchor_rows(lines, "(?i)the")).select("scan_id", "y0", "text")


@R.add("row_union_box", with_views(
    """SELECT scan_id, CAST(round_even(y / h, 0) AS BIGINT) AS row_key, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, avg(confidence) AS confidence, avg(confidence) AS mean_conf
    FROM words GROUP BY ALL""", "words"))
def row_union_box(spark, d):
    return layout.row_boxes(star.words(spark, d)).select("scan_id", "row_key", "x", "y", "w", "h", "confidence", "mean_conf")


# Label text laid out as words, so price, date and quantity rows occur.
_LABEL_WORDS = """SELECT scan_id, line_no * 1000 + token_no AS ord, token AS text, token_no * 120 AS x, line_no * 40 AS y, length(token) * 10 AS w, 20 AS h,
  CAST((scan_id * 13 + line_no * 29 + token_no) % 100 AS DOUBLE) AS confidence, line_no FROM (
  SELECT scan_id, line_no, unnest(toks) AS token, unnest(range(len(toks))) AS token_no FROM (
    SELECT scan_id, line_no, string_split(line, ' ') AS toks FROM (SELECT scan_id, unnest(string_split(ocr_text, chr(10))) AS line, unnest(range(len(string_split(ocr_text, chr(10))))) AS line_no FROM label_text) WHERE line <> ''))"""


def label_words(spark, d):
    texts = star.label_text(spark, d).select("scan_id", "ocr_text").repartition(star.tasks_for(star.read(spark, d, "orders")), "scan_id")  # before they become words, which are larger
    lines = texts.select("scan_id", F.posexplode(F.split("ocr_text", "\n")).alias("line_no", "line")).where("line <> ''")
    tokens = lines.select("scan_id", "line_no", F.posexplode(F.split("line", " ")).alias("token_no", "text"))
    return tokens.select(
        "scan_id", (F.col("line_no").cast("long") * 1000 + F.col("token_no")).alias("ord"), "text",
        (F.col("token_no") * 120).alias("x"), (F.col("line_no") * 40).alias("y"), (F.length("text") * 10).alias("w"), F.lit(20).alias("h"),
        ((F.col("scan_id") * 13 + F.col("line_no") * 29 + F.col("token_no")) % 100).cast("double").alias("confidence"), "line_no")


_CUE = r"(?i)\d|MRP|M\.?R\.?P\.?|retail\s*price|mfg|manufactur|exp|expiry|best\s*before|use\s*by|net\s*q|care|helpline|toll|rs\.?|inr|₹"
_PARSES = (r"(regexp_matches(text, '(?i)MRP Rs\. [\d,]+') OR regexp_matches(text, '(?i)net\s*(?:q?t[yl]|quantity|wt|weight|vol|content|o?t?y)[^\d]*([\d.,]+)\s*(kg|g|mg|ml|l|litre?s?|cm|m|nos?|pcs?|pc|units?)\b')"
           r" OR regexp_matches(text, '(?i)\b([\d.,]+)\s*(kg|g\b|mg|ml|l\b|litre?s?|units?)\b') OR regexp_matches(text, '(Mfg|Exp): ([A-Za-z]+ \d{4}|\d\d/\d\d/\d{4})'))")
_WEAK = f"""SELECT scan_id, CAST(round_even(y / h, 0) AS BIGINT) AS row_key, avg(confidence) AS mean_conf, min(ord) AS first_ord, string_agg(text, ' ' ORDER BY ord) AS text,
  min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM ({_LABEL_WORDS}) GROUP BY ALL"""


@R.add("weak_rows", with_views(
    f"""SELECT scan_id, row_key, text, mean_conf, row_number() OVER (PARTITION BY scan_id ORDER BY mean_conf, first_ord) AS try_no FROM ({_WEAK})
    WHERE mean_conf < 70 AND w >= 16 AND h >= 10 AND regexp_matches(text, '{_CUE}') AND NOT {_PARSES} QUALIFY try_no <= 8""", "label_text"))
def weak_rows(spark, d):
    return layout.weak_rows(label_words(spark, d)).select("scan_id", "row_key", "text", "mean_conf", F.col("try_no").cast(L).alias("try_no"))


def _rereads(words):
    """A second engine's reading of every row: some become a price, some stay as they are."""
    rows = layout.row_boxes(words)
    k = F.col("scan_id")
    return rows.select("scan_id", "row_key", F.when(k % 3 == 0, F.concat(F.lit("MRP Rs. "), (k % 90 + 10).cast("string")))
                       .when(k % 3 == 1, F.col("text")).otherwise("???").alias("new_text"))


def _repairs(spark, d):
    words = label_words(spark, d)
    return layout.accepted_rereads(layout.weak_rows(words), _rereads(words))


_REPAIR_SQL = f"""SELECT scan_id, row_key, 'MRP Rs. ' || (scan_id % 90 + 10) AS new_text, x, y, w, h, n FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY mean_conf, first_ord) AS n FROM ({_WEAK})
    WHERE mean_conf < 70 AND w >= 16 AND h >= 10 AND regexp_matches(text, '{_CUE}') AND NOT {_PARSES} QUALIFY n <= 8) WHERE scan_id % 3 = 0 AND n <= 4"""


@R.add("accepted_rereads", with_views(f"SELECT scan_id, row_key, new_text, n AS accepted_no FROM ({_REPAIR_SQL})", "label_text"))
def accepted_rereads(spark, d):
    return _repairs(spark, d).select("scan_id", "row_key", "new_text", F.col("accepted_no").cast(L).alias("accepted_no"))


@R.add("row_repair_splice", with_views(
    f"""SELECT scan_id, string_agg(text, chr(10) ORDER BY y) AS ocr_text FROM (
    SELECT scan_id, y, string_agg(text, ' ' ORDER BY x) AS text FROM ({_LABEL_WORDS}) w WHERE NOT EXISTS (SELECT 1 FROM ({_REPAIR_SQL}) r WHERE r.scan_id = w.scan_id AND r.row_key = round_even(w.y / w.h, 0)) GROUP BY scan_id, y
    UNION ALL SELECT scan_id, y, new_text FROM ({_REPAIR_SQL})) GROUP BY scan_id""", "label_text"))
def row_repair_splice(spark, d):
    words = label_words(spark, d)
    repairs = layout.accepted_rereads(layout.weak_rows(words), _rereads(words))
    spliced = layout.row_repair_splice(words, settle(repairs, "repairs"))
    return layout.text_of_lines(layout.visual_lines(spliced))


@R.add("segment_dedupe", """SELECT doc_id, len(segs) AS segments, array_to_string(list_filter(segs, lambda s, i: i = 1 OR s <> segs[i - 1]), chr(10)) AS text
 FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '') AS segs FROM documents)""")
def segment_dedupe(spark, d):
    from packlens.functions.fields import drop_repeats
    segs = F.filter(F.split("text", "\n"), lambda s: F.trim(s) != "")
    return star.read(spark, d, "documents").select(
        "doc_id", F.size(segs).cast(L).alias("segments"), F.array_join(drop_repeats(segs), "\n").alias("text"))


@R.add("line_context", """SELECT doc_id, pos, COALESCE(p2, '') AS prev2, COALESCE(p1, '') AS prev1, COALESCE(n1, '') AS next1, COALESCE(n2, '') AS next2 FROM (
  SELECT *, lag(line, 2) OVER w AS p2, lag(line) OVER w AS p1, lead(line) OVER w AS n1, lead(line, 2) OVER w AS n2 FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE contains(line, '@')""")
def line_context(spark, d):
    from packlens.functions.fields import line_context as context
    rows = star.read(spark, d, "documents").select("doc_id", context(lines_of(F.col("text")), r"@").alias("c"))
    return rows.select("doc_id", F.inline("c")).select("doc_id", F.col("pos").cast(L).alias("pos"), "prev2", "prev1", "next1", "next2")


# --- barcodes ------------------------------------------------------------------------------------
@R.add("gtin_dedupe", with_views("SELECT scan_id, format, code, min(pos) AS first_pos FROM barcodes WHERE code <> '' GROUP BY ALL", "barcodes"))
def gtin_dedupe(spark, d):
    return barcodes.gtin_dedupe(star.barcodes(spark, d)).withColumn("first_pos", F.col("first_pos").cast(L))


@R.add("gtin_country", with_views(
    "SELECT c.code, COALESCE(country, 'Unknown') AS country FROM catalog c LEFT JOIN gs1 ON substr(c.code, 1, 3) = prefix", "catalog", "gs1"))
def gtin_country(spark, d):
    return barcodes.gtin_country(star.catalog(spark, d).select("code"))


_CARD_SQL = """SELECT scan_id, CASE WHEN total = 1 THEN 'LMPC-gtin' ELSE 'LMPC-gtin-' || n END AS rule_id,
 'Barcode ' || format || ' ' || code || ' (GS1 prefix: ' || COALESCE(country, 'Unknown') || ')' AS message, code AS observed, 'PASS' AS status, n
 FROM gtin_cards LEFT JOIN gs1 ON substr(code, 1, 3) = prefix"""


@R.add("gtin_cards", with_views(f"SELECT scan_id, rule_id, message, observed FROM ({_CARD_SQL})", "gtin_cards", "gs1"))
def gtin_cards(spark, d):
    return barcodes.gtin_cards(star.barcodes(spark, d)).select("scan_id", "rule_id", "message", "observed")


@R.add("results_append", with_views(
    f"SELECT scan_id, rule_id, status, observed FROM findings UNION ALL SELECT scan_id, rule_id, status, observed FROM ({_CARD_SQL})", "findings", "gtin_cards", "gs1"))
def results_append(spark, d):
    found = rules.findings(star.declarations(spark, d))
    return barcodes.results_append(found, barcodes.gtin_cards(star.barcodes(spark, d))).select(
        "scan_id", "rule_id", "status", "observed")


@R.add("catalog_cross_check", with_views(
    """SELECT d.scan_id, 'Open Food Facts lists barcode ' || c.code || ' as ' || concat_ws(' ', '''' || name || '''', quantity) || ' (' ||
    COALESCE(NULLIF(concat_ws('; ', CASE WHEN name IS NOT NULL AND generic_name <> '' THEN CASE WHEN contains(lower(generic_name), lower(name)) THEN 'name matches' ELSE 'name DIFFERS' END END,
      CASE WHEN quantity IS NOT NULL AND net_quantity_value IS NOT NULL THEN CASE WHEN contains(lower(format('{:g}', net_quantity_value) || ' ' || net_quantity_unit), lower(quantity)) THEN 'quantity matches' ELSE 'quantity DIFFERS' END END), ''), 'compare with our read')
    || ') — verify on the physical package.' AS note
    FROM declarations d JOIN gtin_cards g ON d.scan_id = g.scan_id AND g.n = 1 JOIN catalog c ON g.code = c.code WHERE name IS NOT NULL OR quantity IS NOT NULL""",
    "declarations", "gtin_cards", "catalog"))
def catalog_cross_check(spark, d):
    qty = F.concat(short_number(F.col("net_quantity_value")), F.lit(" "), F.col("net_quantity_unit"))
    scans = star.declarations(spark, d).select("scan_id", F.col("generic_name").alias("product_name"), qty.alias("quantity_text"))
    return barcodes.catalog_cross_check(scans, barcodes.gtin_cards(star.barcodes(spark, d)), star.catalog(spark, d))


