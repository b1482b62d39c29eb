"""Several captures of one label: frame choice, text union, reads and galleries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from packlens import fixed_values as fv
from packlens.functions.text import float_text, lines_of, squeeze, strip
from packlens.operators.ordered import first_k

TEXT_LIMIT = 8000


def round_to(value: Column, digits: int) -> Column:
    """Round half to even on the binary value."""
    scale = 10 ** digits
    return F.rint(value * scale) / scale


def best_frame(frames: DataFrame) -> DataFrame:
    """Strongest read per scan; ties go to the longer text, then to the lowest index."""
    key = F.struct("ocr_confidence", "text_length", (-F.col("frame_index")).alias("back"))
    return frames.groupBy("scan_id").agg(F.max(key).alias("k")).select(
        "scan_id", (-F.col("k.back")).alias("best_index"), F.col("k.ocr_confidence").alias("best_confidence"))


def measured_frame(frames: DataFrame) -> DataFrame:
    """Strongest calibrated frame per scan (ties to the highest index), else the best frame."""
    calibrated = F.col("font_mm").isNotNull() & F.col("has_boxes")
    pick = F.max(F.when(calibrated, F.struct("ocr_confidence", "frame_index")))
    best = F.max(F.struct("ocr_confidence", "text_length", (-F.col("frame_index")).alias("back")))
    return frames.groupBy("scan_id").agg(pick.alias("m"), best.alias("b"), F.count(F.lit(1)).alias("n_frames")).select(
        "scan_id", (-F.col("b.back")).alias("best_index"), F.col("b.ocr_confidence").alias("best_confidence"),
        F.coalesce("m.frame_index", -F.col("b.back")).alias("measured_index"), "n_frames")


def measured_index(frames: DataFrame) -> DataFrame:
    """First frame flagged as measured, 0 for scans that only have an image, else null."""
    return frames.groupBy("scan_id").agg(
        F.min(F.when(F.col("measured"), F.col("frame_index"))).alias("m"), F.bool_or("has_blob").alias("blob"),
    ).select("scan_id", F.coalesce("m", F.when(F.col("blob"), F.lit(0))).alias("measured_index"))


def union_lines(frames: DataFrame) -> DataFrame:
    """Lines of all frames, each kept once per scan: strongest frame first, then reading order.

    The de-duplication is an aggregate, so copies meet inside the map tasks before the shuffle.
    """
    lines = frames.select("scan_id", "frame_index", "ocr_confidence", F.posexplode(lines_of(F.col("text"))).alias("pos", "raw"))
    clean = lines.withColumn("line", squeeze(F.col("raw"))).where(F.length("line") >= 2)
    first = F.min(F.struct((-F.col("ocr_confidence")).alias("rank"), "frame_index", "pos", "line"))
    return clean.groupBy("scan_id", F.lower("line").alias("key")).agg(first.alias("f")).select("scan_id", "f.*")


def words_added(union: DataFrame) -> DataFrame:
    """Lines only a given frame contributed."""
    return union.groupBy("scan_id", "frame_index").agg(F.count(F.lit(1)).alias("added"))


def line_union(union: DataFrame) -> DataFrame:
    """The whole union text per scan: strongest frame first, then reading order."""
    lines = F.array_sort(F.collect_list(F.struct("rank", "frame_index", "pos", "line")))
    return union.groupBy("scan_id").agg(lines.alias("ls")).select("scan_id", F.array_join("ls.line", "\n").alias("ocr_text"))


def stored_text(text: Column) -> Column:
    """What is stored of a text: its first 8000 characters. Extraction works on the whole text."""
    return F.substring(text, 1, TEXT_LIMIT)


def gallery(scans: DataFrame, frames: DataFrame) -> DataFrame:
    """Evidence frames per scan in index order; frames without an image are left out.

    Scans without frame metadata fall back to one best frame when they hold an image.
    """
    joined = scans.select("scan_id", "best_index", "has_image").join(frames, "scan_id", "left")
    none = F.col("frame_index").isNull()
    is_best = none | (F.col("frame_index") == F.col("best_index"))
    index = F.coalesce("frame_index", F.lit(0))
    label = F.concat(F.lit("Angle "), (index + 1).cast("string"), F.when(is_best, " (Best capture)").otherwise(""))
    has_blob = F.when(none, F.col("has_image")).otherwise(F.col("has_blob"))
    return joined.where(has_blob).select("scan_id", index.alias("frame_index"), label.alias("label"), is_best.alias("is_best"))


def box_cap(words: DataFrame, *, k: int = 500) -> DataFrame:
    """First ``k`` words per scan in reading order; each task keeps at most ``k`` per scan before the shuffle."""
    return first_k(words, ["scan_id"], [F.col("ord")], k)


def line_rebuild(words: DataFrame) -> DataFrame:
    """Lines from word rows: consecutive words with equal (block, par, line) belong together.

    The words of one scan are those of one image, so a window by scan is enough, and words that lie by scan are not shuffled.
    """
    said = words.where(strip(F.col("text")) != "").withColumn("text", strip(F.col("text"))).where("scan_id IS NOT NULL AND ord IS NOT NULL")
    by_place = W.partitionBy("scan_id").orderBy("ord")
    line = F.struct("block", "par", "line")
    opened = said.withColumn("run_start", F.when(~line.eqNullSafe(F.lag(line).over(by_place)), F.col("ord")))
    runs = opened.withColumn("run_start", F.max("run_start").over(by_place.rowsBetween(W.unboundedPreceding, 0)))
    packed = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return runs.groupBy("scan_id", "run_start").agg(packed.alias("ws")).select(
        "scan_id", "run_start", F.array_join(F.transform("ws", lambda r: r["text"]), " ").alias("line"))


def word_conf_mean(words: DataFrame) -> DataFrame:
    good = F.when((F.col("confidence") >= 0) & (strip(F.col("text")) != ""), F.col("confidence"))
    return words.groupBy("scan_id").agg(F.coalesce(round_to(F.avg(good), 1), F.lit(0.0)).alias("ocr_confidence"))


def box_medians(words: DataFrame) -> DataFrame:
    """Upper and true medians of box height and of width/height per scan.

    The exact percentiles keep one counter per distinct value, so a hot scan merges before the shuffle.
    """
    ratio = "CASE WHEN h > 0 THEN CAST(w AS DOUBLE) / h END"
    return words.groupBy("scan_id").agg(
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY CAST(h AS DOUBLE) DESC)").alias("upper_h"),
        F.expr("percentile(CAST(h AS DOUBLE), 0.5)").alias("true_h"),
        F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {ratio} DESC)").alias("upper_ratio"),
        F.expr(f"percentile({ratio}, 0.5)").alias("true_ratio"),
    ).select("scan_id", "upper_h", "true_h", round_to(F.col("upper_ratio"), 3).alias("upper_ratio"),
             round_to(F.col("true_ratio"), 3).alias("true_ratio"))


def ppm_estimate(pixels: Column, millimetres: Column) -> Column:
    return F.when((pixels != 0) & (millimetres > 0), pixels / millimetres)


def font_mm(pixels: Column, ppm: Column) -> Column:
    return F.when((ppm > 0) & (pixels > 0), round_to(pixels / ppm, 2))


def measure_gate(decl: DataFrame, measures: DataFrame) -> DataFrame:
    """Copy measurements, embossing and panel size only when something was measured at all."""
    m = measures.select("scan_id", F.col("font_mm").alias("m_font"), F.col("letter_mm").alias("m_letter"),
                        F.col("ratio").alias("m_ratio"), F.col("embossed").alias("m_embossed"), F.col("panel").alias("m_panel"))
    some = F.coalesce("m_font", "m_letter", "m_ratio").isNotNull()

    def gated(new: str, old: str) -> Column:
        return F.when(some, F.col(new)).otherwise(F.col(old))

    return decl.join(m, "scan_id", "left").withColumns({
        "min_numeral_height_mm": gated("m_font", "min_numeral_height_mm"),
        "min_letter_height_mm": gated("m_letter", "min_letter_height_mm"),
        "min_width_to_height_ratio": gated("m_ratio", "min_width_to_height_ratio"),
        "is_embossed": gated("m_embossed", "is_embossed"),
        "panel_area_cm2": gated("m_panel", "panel_area_cm2"),
    }).drop("m_font", "m_letter", "m_ratio", "m_embossed", "m_panel")


def read_arbitration(reads: DataFrame) -> DataFrame:
    """Winning read per scan among engine reads, as one conditional aggregate.

    ``engine`` is tesseract (``config_no`` 0 or 1), florence or vlm. A strong first configuration makes
    the second one irrelevant; an alternate only replaces an empty read, or a weak and shorter one.
    """
    said = strip(F.col("text")) != ""

    def pick(cond: Column) -> Column:
        return F.max(F.when(cond & said, F.struct("confidence", F.col("text"), F.col("engine"))))

    tess = F.col("engine") == "tesseract"
    g = reads.groupBy("scan_id").agg(
        pick(tess & (F.col("config_no") == 0)).alias("first"), pick(tess & (F.col("config_no") == 1)).alias("second"),
        pick(F.col("engine") == "florence").alias("florence"), pick(F.col("engine") == "vlm").alias("vlm"))
    second_wins = F.col("first").isNull() | (
        (F.col("first.confidence") < fv.STRONG_READ_CONFIDENCE) & (F.col("second.confidence") > F.col("first.confidence")))
    g = g.withColumn("primary", F.when(second_wins, F.coalesce("second", "first")).otherwise(F.col("first")))

    def accepted(name: str) -> Column:
        longer = (F.col("primary.confidence") < fv.LOW_CONFIDENCE) & (
            F.length(F.col(f"{name}.text")) > F.length(F.col("primary.text")))
        return F.col(name).isNotNull() & (F.col("primary").isNull() | F.coalesce(longer, F.lit(False)))

    winner = F.when(accepted("florence"), F.col("florence")).when(accepted("vlm"), F.col("vlm")).otherwise(F.col("primary"))
    return g.withColumn("w", winner).select(
        "scan_id", F.coalesce("w.engine", F.lit("none")).alias("ocr_engine"),
        F.coalesce("w.confidence", F.lit(0.0)).alias("ocr_confidence"), F.coalesce("w.text", F.lit("")).alias("ocr_text"))


def merge_warnings(chosen: DataFrame) -> DataFrame:
    """Warnings a merged scan carries about its frames."""
    merged = F.concat(F.lit("Merged "), F.col("n_frames").cast("string"), F.lit(" captures (best single-frame confidence "),
                      float_text(F.col("best_confidence")), F.lit("%); text combined by confidence, evaluated once."))
    moved = F.when(F.col("measured_index") != F.col("best_index"), F.concat(
        F.lit("Type size measured on angle "), (F.col("measured_index") + 1).cast("string"),
        F.lit(" (it carries the mm scale); text led by angle "), (F.col("best_index") + 1).cast("string"), F.lit(".")))
    return chosen.withColumn("merge_warnings", F.array_compact(F.array(merged, moved)))


def capture_quarantine(captures: DataFrame, *, max_bytes: int = fv.MAX_UPLOAD_BYTES) -> DataFrame:
    """Reason a capture is refused, per file and for the number of files of its scan."""
    reason = (
        F.when(~F.coalesce(F.col("content_type").isin(*fv.ALLOWED_IMAGE_TYPES), F.lit(False)), "415 unsupported type")
        .when(F.col("length") == 0, "400 empty file")
        .when(F.col("length") > max_bytes, "413 file too large")
    )
    per_scan = captures.groupBy("scan_id").agg(F.count(F.lit(1)).alias("files")).select(
        "scan_id", (~F.col("files").between(2, 5)).alias("bad_count"))
    return captures.join(per_scan, "scan_id").withColumn(
        "reason", F.coalesce(F.when(F.col("bad_count"), "422 send 2-5 images of the same label"), reason, F.lit("accepted"))
    ).drop("bad_count")
