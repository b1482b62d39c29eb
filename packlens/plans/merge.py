"""Several captures of one label, evaluated once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlens.functions.text import stage
from packlens.operators import frames as fr
from packlens.operators import history, rules
from packlens.operators.barcodes import cards_of
from packlens.operators.extraction import extract_declarations
from packlens.operators.guidance import annotated_array
from packlens.operators.layout import visual_lines
from packlens.operators.patches import layout_rescue, with_gaps
from packlens.session import settle

BOX_LIMIT = 500
BOXES = "array<struct<ord:bigint,text:string,x:int,y:int,w:int,h:int,confidence:double>>"
#: What a capture may bring besides its text and sizes.
OPTIONAL = {"ocr_engine": "string", "boxes": BOXES, "barcodes": "array<struct<format:string,text:string>>", "coord_w": "int", "coord_h": "int", "ppm": "double"}
#: What an upload may bring for its scan.
UPLOAD = {"given_product": "string", "given_brand": "string", "given_category": "string", "scan_lat": "double", "scan_lon": "double", "is_embossed": "boolean", "panel_area_cm2": "double"}


def _or_null(df: DataFrame, columns: dict[str, str]) -> list[Column]:
    return [(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()]


def choose_frames(dealt: DataFrame) -> DataFrame:
    """One row per scan: its best frame (``b``), the frame sizes were measured on (``m``) and an entry for every frame.

    The strongest read leads (ties: longer text, lowest index); sizes come from the strongest calibrated one (ties: highest index).
    """
    calibrated = F.col("font_mm").isNotNull() & F.coalesce("has_boxes", F.lit(False))
    sizes = [F.col(c) for c in ("font_mm", "letter_mm", "ratio", "ppm")]
    own = [F.coalesce("ocr_engine", F.lit("tesseract")).alias("engine"), "boxes", "barcodes"]
    length = F.coalesce(F.length("text"), F.lit(0))
    entry = F.struct("frame_index", "ocr_confidence", F.coalesce(F.size("boxes"), F.lit(0)).alias("word_count"), F.slice("boxes", 1, BOX_LIMIT).alias("boxes"), "coord_w", "coord_h")
    picked = dealt.groupBy("scan_id").agg(
        F.max(F.struct("ocr_confidence", length.alias("length"), (-F.col("frame_index")).alias("back"), F.struct(*own, *sizes).alias("own"))).alias("b"),
        F.max(F.when(calibrated, F.struct("ocr_confidence", "frame_index", F.struct(*sizes).alias("own")))).alias("m"),
        F.count(F.lit(1)).alias("n_frames"), F.array_sort(F.collect_list(entry)).alias("entries"),
    )
    best = -F.col("b.back")
    return picked.select(
        "scan_id", best.alias("best_index"), F.col("b.ocr_confidence").alias("best_confidence"), "n_frames", "entries", F.coalesce("m.frame_index", best).alias("measured_index"),
        *[F.when(F.col("m").isNull(), F.col(f"b.own.{c}")).otherwise(F.col(f"m.own.{c}")).alias(c) for c in ("font_mm", "letter_mm", "ratio", "ppm")],
        F.col("b.own.engine").alias("best_engine"), F.col("b.own.boxes").alias("best_boxes"), F.col("b.own.barcodes").alias("best_barcodes"),
    )


def merge_scan(frames: DataFrame, *, uploads: DataFrame | None = None, names: DataFrame | None = None, is_embossed: bool = False, panel_area_cm2: float | None = None) -> DataFrame:
    """One row per scan, as it is stored: union text, declaration, nested findings and frames, verdict and warnings.

    ``frames``: scan_id, frame_index, ocr_confidence, text, font_mm, letter_mm, ratio, has_boxes, and what ``OPTIONAL`` names. ``uploads``: scan_id and
    what ``UPLOAD`` names, one row per scan. ``names``: known makers (name, position). Frame choice, line union and
    their join shuffle nothing where frames lie by scan, as callers deal what frames are made from: boxes are many times as large. Text comes from the whole union and only the stored text is cut. Gaps in the union's fields are filled from the
    visual rows of the best frame's boxes, which are made for scans with gaps only; measurements come from the measured frame, confidence, engine and barcode cards from the best one.
    """
    needed = ("scan_id", "frame_index", "ocr_confidence", "text", "font_mm", "letter_mm", "ratio", "has_boxes")
    dealt = frames.select(*needed, *_or_null(frames, OPTIONAL))
    union = fr.union_lines(dealt).groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("rank", "frame_index", "pos", "line"))).alias("ls"))
    chosen = fr.merge_warnings(choose_frames(dealt)).join(union, "scan_id", "left")
    added = lambda e: F.coalesce(F.size(F.filter("ls", lambda x: x["frame_index"] == e["frame_index"])), F.lit(0))
    entries = F.transform("entries", lambda e: F.struct(
        e["frame_index"].alias("index"), (e["frame_index"] == F.col("best_index")).alias("is_best"), (e["frame_index"] == F.col("measured_index")).alias("measured"),
        e["ocr_confidence"].alias("ocr_confidence"), e["word_count"].alias("word_count"), added(e).alias("words_added"),
        e["boxes"].alias("boxes"), e["coord_w"].alias("coord_w"), e["coord_h"].alias("coord_h")))
    merged = stage(chosen, ocr_text=F.coalesce(F.array_join("ls.line", "\n"), F.lit("")), ocr_confidence=F.col("best_confidence"), frames=entries).drop("ls", "entries")
    if uploads is not None:
        merged = merged.join(uploads.select("scan_id", *_or_null(uploads, UPLOAD)), "scan_id", "left")
    else:
        merged = merged.select("*", *_or_null(merged, UPLOAD))
    given = {"is_embossed": F.coalesce("is_embossed", F.lit(is_embossed)), "panel_area_cm2": F.coalesce("panel_area_cm2", F.lit(panel_area_cm2).cast("double"))}
    merged = merged.withColumns(given).withColumnsRenamed({c: f"u_{c}" for c in given})

    decl = extract_declarations(merged, names)
    if "boxes" in frames.columns:
        decl = settle(decl, "merged-declarations")
        words = with_gaps(decl).where("size(best_boxes) > 0").select("scan_id", "best_boxes").repartition("scan_id").select("scan_id", F.inline("best_boxes"))
        decl = layout_rescue(decl, settle(visual_lines(words), "merged-rows"))
    decl = decl.withColumns({
        "min_numeral_height_mm": F.col("font_mm"), "min_letter_height_mm": F.col("letter_mm"), "min_width_to_height_ratio": F.col("ratio"),
        **{c: F.col(f"u_{c}") for c in given},
    })
    named = history.valid_gps(history.product_identity(decl))
    nested = rules.with_results(named)
    nested = nested.withColumn("results", annotated_array(F.concat("results", cards_of(F.col("best_barcodes"))), F.col("ocr_confidence")))
    keep = [c for c in nested.columns if c not in ("scan_id", "ocr_confidence", "given_product", "given_brand", "given_category", "best_boxes", "best_barcodes", *(f"u_{c}" for c in given))]
    judged = rules.verdicts(nested, *keep)
    return judged.withColumns({
        "warnings": F.concat("warnings", "merge_warnings"), "ocr_text": fr.stored_text(F.col("ocr_text")),
        "ocr_engine": F.concat("best_engine", F.lit("+merge"), F.col("n_frames").cast("string")), "font_height_mm": F.col("font_mm"), "ppm_used": F.col("ppm"),
    }).drop("merge_warnings", "best_engine", "font_mm", "letter_mm", "ratio", "ppm")
