"""Tags against the plain loop, officer actions at scan grain against finding grain, merged scans, capture files."""

import re
import time

from pyspark.sql import functions as F

from packlens import fixed_values as fv
from packlens.operators import tagging

TEXTS = [
    (1, "Acme Foods, Plot 1\nMRP Rs. 50.00MRP Rs. 60 x\nNet Qty: 5 g Mfg: 01/02/2024 Exp: June 2025\nCustomer Care: a@b.in 1800 123 4567"),
    (2, ""), (3, None), (4, "   "), (5, "nothing here"), (6, "日本 Foods é MRP Rs 1,2\nShakti Home"), (7, "word " * 500 + "MRP Rs. 9"), (None, "MRP Rs. 7"),
]


def _tokens(text):
    return [(m.group(), m.start(), m.end()) for m in re.finditer(r"\S+", text)]


def test_pattern_tags_equal_the_plain_loop(spark):
    want = {}
    for key, text in TEXTS:
        toks = _tokens(text or "")
        tags = ["O"] * len(toks)
        for label, pattern, flags in fv.ENTITY_PATTERNS:
            for m in re.finditer(pattern, text or "", re.IGNORECASE if flags == "i" else re.MULTILINE):
                first = True
                for i, (_, s, e) in enumerate(toks):
                    if e > m.start() and s < m.end() and tags[i] == "O":
                        tags[i], first = ("B-" if first else "I-") + label, False
        want.update({(key, i): (t[0], tag) for i, (t, tag) in enumerate(zip(toks, tags))})
    got = tagging.bio_from_patterns(spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(2))
    assert {(r.doc_id, r.tok): (r.token, r.tag) for r in got.collect()} == want
    assert "Exchange" not in tagging.bio_from_patterns(spark.createDataFrame(TEXTS, "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()


def test_span_tags_equal_the_plain_loop(spark):
    spans = [(1, 0, 0, 12, "NAME"), (1, 1, 8, 30, None), (1, 2, 9, 10, "X"), (7, 0, 3, 40, "A"), (7, 1, 600, 601, "B"), (5, 0, 4, 4, "EMPTY"), (99, 0, 0, 5, "NOBODY"), (6, 0, 0, 100, "ALL")]
    want = {}
    for key, text in TEXTS:
        toks = _tokens(text or "")
        tags = ["O"] * len(toks)
        for doc, _, s0, e0, label in spans:
            first = True
            for i, (_, s, e) in enumerate(toks):
                if doc == key and e0 > s0 and e > s0 and s < e0:
                    tags[i], first = ("B-" if first else "I-") + (label or "ENT"), False
        want.update({(key, i): (t[0], tag) for i, (t, tag) in enumerate(zip(toks, tags))})
    table = spark.createDataFrame(spans, "doc_id long, span_no int, s_start int, s_end int, label string")
    got = tagging.bio_tag_tokens(spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(2), table)
    assert {(r.doc_id, r.tok): (r.token, r.tag) for r in got.collect()} == want
    assert tagging.bio_tag_tokens(spark.createDataFrame([], "doc_id long, text string"), table).count() == 0


def test_actions_at_scan_grain_equal_finding_grain(spark):
    from packlens.operators import history, review, rules
    from packlens.operators.guidance import annotate
    from packlens.sources import star

    d = "/root/testdata/sf0.001"
    decl, actions = star.declarations(spark, d), star.actions(spark, d)
    marks = review.attest_merge(rules.findings(decl), actions)
    slow = review.finding_overlay(annotate(rules.findings(decl)), marks)
    fast = review.effective_findings(decl, actions)
    assert set(slow.columns) == set(fast.columns)
    assert slow.select(sorted(slow.columns)).exceptAll(fast.select(sorted(slow.columns))).isEmpty() and slow.count() == fast.count()
    states = review.effective_statuses(decl, actions)
    assert sorted(history.report_counts_of_scans(states).collect()) == sorted(history.report_counts(slow).collect())
    assert history.top_failed_of_scans(states).collect() == history.top_failed_rules(slow).collect()


def test_merged_scan_is_whole(spark):
    from packlens.plans.merge import BOXES, merge_scan

    word = lambda o, t, x, y: {"ord": o, "text": t, "x": x, "y": y, "w": 10 * len(t), "h": 20, "confidence": 90.0}
    boxes = [word(0, "MRP", 0, 0), word(1, "Rs.", 60, 0), word(2, "45.50", 0, 40), word(3, "Sunflower", 0, 80), word(4, "Oil", 120, 80)]
    code = {"format": "EAN13", "text": " 8901234567890 "}
    rows = [
        (1, 0, 90.0, "Sunflower Oil\nMRP", None, None, None, True, boxes, [code, code, {"format": "EAN8", "text": " "}], "florence-2"),
        (1, 1, 70.0, "Net Qty: 500 g\nSunflower  oil", 2.5, 2.0, 0.5, True, [], [], "tesseract"),
        (2, 0, 50.0, None, None, None, None, False, None, None, None), (2, 1, 50.0, "x", None, None, None, None, None, None, None),
    ]
    frames = spark.createDataFrame(rows, f"scan_id long, frame_index int, ocr_confidence double, text string, font_mm double, letter_mm double, ratio double, has_boxes boolean, boxes {BOXES}, "
                                         "barcodes array<struct<format:string,text:string>>, ocr_engine string")
    uploads = spark.createDataFrame([(1, " Own name ", 12.3456789, 77.0, True, 40.0)], "scan_id long, given_product string, scan_lat double, scan_lon double, is_embossed boolean, panel_area_cm2 double")
    got = {r["scan_id"]: r for r in merge_scan(frames, uploads=uploads).collect()}
    one, two = got[1], got[2]
    assert (one["mrp"], one["net_quantity_value"], one["ocr_engine"], one["ocr_confidence"]) == (45.5, 500.0, "florence-2+merge2", 90.0)  # the price comes from the rows of boxes
    assert one["field_sources"]["mrp"] == "inferred" and one["field_sources"]["net_quantity_value"] == "read"
    assert (one["measured_index"], one["best_index"], one["font_height_mm"], one["is_embossed"]) == (1, 0, 2.5, True)
    assert (one["product_name"], one["category"], one["scan_lat"], one["scan_lon"]) == ("Own name", "", 12.345679, 77.0)
    assert [(f["index"], f["is_best"], f["measured"], f["word_count"], f["words_added"]) for f in one["frames"]] == [(0, True, False, 5, 2), (1, False, True, 0, 1)]
    assert [f["rule_id"] for f in one["results"]] == [*fv.RULE_IDS, "LMPC-gtin"] and "890" in one["results"][-1]["message"] and one["results"][-1]["cause"] == ""
    assert all(f["cause"] for f in one["results"] if f["status"] in (fv.FAIL, fv.NOT_FOUND)) and len(one["warnings"]) == 2
    assert (two["best_index"], two["n_frames"], two["ocr_text"], len(two["results"])) == (1, 2, "", 10) and two["verdict"] == fv.INCOMPLETE
    assert merge_scan(frames.limit(0)).count() == 0


def test_capture_files_never_read_their_content(spark, tmp_path):
    from packlens.sources.captures import capture_files

    for scan, frame, kind, data in ((1, 0, "jpg", b"x" * 10), (1, 1, "PNG", b"yy"), (1, 2, "png", b""), (2, 0, "tiff", b"abc")):
        where = tmp_path / f"scan_id={scan}" / f"frame_index={frame}" / f"kind={kind}"
        where.mkdir(parents=True)
        (where / "capture.bin").write_bytes(data)
    rows = capture_files(spark, str(tmp_path))
    assert sorted((r["scan_id"], r["frame_index"], r["content_type"], r["length"]) for r in rows.collect()) == [(1, 0, "image/jpeg", 10), (1, 1, "image/png", 2), (2, 0, None, 3)]  # empty files are not listed
    assert "content#" not in rows._jdf.queryExecution().executedPlan().toString()


def test_captures_are_written_and_listed_by_tasks(spark, tmp_path):
    from packlens.sources.captures import capture_files, write_captures

    rows = spark.createDataFrame(
        [(k // 3, k % 3, ("jpg", "PNG", "gif", "bmp")[k % 4], "é\n" * (k % 7)) for k in range(300)]
        + [(5, 0, "PNG", "again"), (5, 0, "PNG", None), (None, None, None, "lost"), (7, 9, "a=b/c", "odd"), (-3, -1, None, None)],
        "scan_id long, frame_index long, kind string, value string")
    write_captures(rows, str(tmp_path / "own"))
    rows.write.partitionBy("scan_id", "frame_index", "kind").text(str(tmp_path / "spark"))
    own = capture_files(spark, str(tmp_path / "own"))
    assert "FileScan" not in own._jdf.queryExecution().executedPlan().toString()  # no listing on the driver
    # Spark's writer opens a file per task and key: lengths of one key are summed.
    listed = lambda df: sorted(map(tuple, df.groupBy("scan_id", "frame_index", "content_type").agg(F.sum("length")).collect()), key=str)
    theirs = spark.read.format("binaryFile").load(str(tmp_path / "spark")).selectExpr("CAST(scan_id AS long) AS scan_id", "CAST(frame_index AS int) AS frame_index",
        "CASE lower(kind) WHEN 'jpg' THEN 'image/jpeg' WHEN 'png' THEN 'image/png' WHEN 'gif' THEN 'image/gif' END AS content_type", "length")
    assert listed(own) == listed(theirs) and own.count() == 304
    one = own.where("scan_id = 7 AND frame_index = 9").first()
    assert one["file"].startswith(f"file:{tmp_path}/own/scan_id=7/frame_index=9/kind=a%3Db%2Fc/") and abs(one["modified"].timestamp() - time.time()) < 600


def test_lines_read_back_in_their_order(spark, tmp_path):
    from packlens.sources.corpus import read_in_order, write_jsonl

    rows = [(f"{c}{k}",) for k in range(300) for c in "aBcD"]
    write_jsonl(spark.createDataFrame(rows, "brand string").repartition(5), str(tmp_path / "out"), order_by="brand")
    back = sorted((r["line_no"], r["brand"]) for r in read_in_order(spark, str(tmp_path / "out"), "brand string").collect())
    assert [n for n, _ in back] == list(range(len(rows))) and [b for _, b in back] == sorted((r[0] for r in rows), key=lambda b: (b.lower(), b))


def test_tags_make_training_rows(spark):
    docs = spark.createDataFrame(TEXTS[:2] + [(8, "a b")], "doc_id long, text string")
    rows = {r["doc_id"]: r["bio"] for r in tagging.bio_rows(docs, tagging.bio_from_patterns(docs)).collect()}
    assert rows[8] == [["a", "O"], ["b", "O"]] and rows[2] == [] and [t for t, _ in rows[1]] == TEXTS[0][1].split()
    assert tagging.bio_rows(docs.where(F.lit(False)), tagging.bio_from_patterns(docs)).count() == 0


def test_actions_meet_declarations_not_findings(spark):
    from packlens.operators import review
    from packlens.sources.corpus import DECLARATION

    kinds = ", ".join(DECLARATION.split(", ")[:18])
    decl = spark.createDataFrame([(k, None, *["Mustard Oil" if c.startswith("generic_name") and k == 1 else None for c in kinds.split(", ")]) for k in (1, 2, 2, None)],
                                 f"scan_id long, ocr_confidence double, {kinds}")
    actions = spark.createDataFrame([(1, 5, "dispute", None), (2, 6, "attest", "seen"), (9, 7, "attest", None)], "scan_id long, event_id long, action string, observed string").selectExpr(
        "*", f"'{fv.R_GENERIC}' AS rule_id", "'x' AS by", "timestamp_seconds(event_id) AS at")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = review.effective_findings(decl, actions).where(F.col("rule_id") == fv.R_GENERIC)
        got = {(r["scan_id"], r["status"], r["manual"]) for r in out.collect()}
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {(1, fv.FAIL, True), (2, fv.PASS, True), (None, fv.NOT_FOUND, False)}
    joined = plan[plan.index("Join LeftOuter"):]
    assert "message" not in joined and "citation" not in joined  # what a join has to shuffle
