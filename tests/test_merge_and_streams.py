"""Merged scans use their whole text; streams lose no late row; damaged stored lists keep what can be read."""

from packlens.operators import frames as fr


def test_merge_extracts_beyond_the_stored_text(spark):
    from packlens.plans.merge import merge_scan

    filler = "\n".join(f"filler row number {k} of the long label" for k in range(400))
    rows = [(1, 0, 90.0, filler, "florence-2"), (1, 1, 60.0, "MRP Rs. 50.00 Inclusive of all taxes\nNet Qty: 500 g", "tesseract"), (2, 0, 70.0, "Net Qty: 2 kg", "tesseract")]
    frames = spark.createDataFrame(rows, "scan_id long, frame_index int, ocr_confidence double, text string, ocr_engine string").selectExpr(
        "*", "cast(null as double) font_mm", "cast(null as double) letter_mm", "cast(null as double) ratio", "false has_boxes")
    got = {r["scan_id"]: r for r in merge_scan(frames).collect()}
    assert (got[1]["mrp"], got[1]["net_quantity_value"], got[1]["ocr_engine"]) == (50.0, 500.0, "florence-2+merge2")
    assert len(got[1]["ocr_text"]) == fr.TEXT_LIMIT and got[2]["ocr_engine"] == "tesseract+merge1"


def test_daily_volume_counts_late_rows(spark, tmp_path):
    from packlens.streaming import live

    for day in (28, 20, 1, 28):  # later files hold earlier days
        spark.sql(f"SELECT timestamp'2024-01-{day:02d} 10:00:00' AS created_at FROM range(5)").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("created_at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.stream_daily_volume(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {str(r["day"]): r["n"] for r in live.daily_volume_table(spark, str(tmp_path / "out")).collect()} == {"2024-01-28": 10, "2024-01-20": 5, "2024-01-01": 5}


def test_daily_state_is_bounded_and_late_rows_go_aside(spark, tmp_path):
    from packlens.streaming import live

    days = [*range(1, 31, 3), 4, 1, 28, 30, 2, 30]  # most files move on by three days; some come weeks late
    for i, day in enumerate(days):
        spark.sql(f"SELECT timestamp'2024-01-{day:02d} 23:00:00' AS created_at FROM range({i + 1}) UNION ALL SELECT NULL").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("created_at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = live.stream_daily_volume(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    want = {}
    for i, day in enumerate(days):
        want[f"2024-01-{day:02d}"] = want.get(f"2024-01-{day:02d}", 0) + i + 1
    assert {str(r["day"]): r["n"] for r in live.daily_volume_table(spark, str(tmp_path / "out")).collect()} == want
    late = spark.read.parquet(str(tmp_path / "out" / "late"))
    assert {str(r["day"]) for r in late.select("day").distinct().collect()} == {"2024-01-01", "2024-01-02", "2024-01-04"}
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(rows) >= len(days) and max(rows) <= live.SLOTS  # one task reads a file here; days take turns in the slots
    held = spark.read.format("statestore").load(str(tmp_path / "cp")).selectExpr("value.*").toJSON().collect()
    assert sum("2024-01" in x for x in held) and not any("2024-01-0" in x for x in held if "2024-01-28" in x)


def test_job_buckets_stay_as_many(spark, tmp_path):
    from packlens.streaming import live

    steps = [(f"job{k % 7}", k, ["queued", "working", "done", "failed"][k * 5 % 4], f"e{k}", k) for k in range(14)]
    schema = "job_id string, event_id long, status string, error string, scan_id long"
    for row in steps:  # a file each, newest first
        spark.createDataFrame([steps[-1 - row[1]]], schema).selectExpr("*", "timestamp_seconds(event_id) AS at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    whole = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    query = live.stream_job_status(stream, out, str(tmp_path / "cp"), buckets=4)
    query.awaitTermination()
    assert len(query.recentProgress) >= len(steps) and len(list((tmp_path / "out").rglob("*.parquet"))) <= 4
    assert sorted(live.job_status_table(spark, out).collect()) == sorted(live.job_status_latest(whole).collect())


def test_damaged_lists(spark):
    from packlens.sources import corpus

    texts = ['[{"rule_id": "A"}, 7, "x", {"rule_id": "B", "status": "FAIL"}]', "{cut", None, "[]", '[{"rule_id": ']
    rows = spark.createDataFrame(list(enumerate(texts)), "scan_id long, results_json string")
    got = sorted((r["scan_id"], r["rule_id"], r["status"]) for r in corpus.findings_backfill(rows).where("rule_id IS NOT NULL").collect())
    assert got == [(0, "A", "PASS"), (0, "B", "FAIL")]
    assert corpus.findings_backfill(rows).select("scan_id").distinct().count() == len(texts)
    boxes = spark.createDataFrame([(0, '[{"x": 1}, {"x": null}, 5, {"x": "2", "text": "t"}, {"x": "a"}]'), (1, "no")], "scan_id long, boxes_json string")
    assert sorted((r["x"], r["text"]) for r in corpus.boxes_backfill(boxes).collect()) == [(1, ""), (2, "t")]


def test_search_takes_a_backslash_as_itself(spark):
    from packlens.operators.history import history_page, scan_search

    scans = spark.sql(r"SELECT id AS scan_id, if(id = 3, 'a\\b_c', 'ab_c') AS product_name, '' AS brand_name, '' AS ocr_text, timestamp'2024-01-01' + make_interval(0, 0, 0, int(id)) AS created_at FROM range(25)")
    assert [r["scan_id"] for r in scan_search(scans, q="a\\b").collect()] == [3]
    assert [r["scan_id"] for r in history_page(scans, sort="scan_id", descending=False, page=9).collect()] == [20, 21, 22, 23, 24]
    assert history_page(scans.limit(0)).count() == 0


def test_names_of_one_character_match(spark):
    from packlens.operators.gazetteer import match_names

    queries = spark.createDataFrame([("made by x company",), ("nothing of it",)], "query string")
    names = spark.createDataFrame([("x", 0), ("zzzz zzzz", 1)], "name string, position int")
    assert [(r["query"], r["name"], r["score"]) for r in match_names(queries, names).collect()] == [("made by x company", "x", 100.0)]


def test_captures_lie_by_scan_before_their_boxes_are_made(spark, monkeypatch):
    from pyspark.sql import functions as F

    from packlens.catalog import reading
    from packlens.plans.merge import choose_frames
    from packlens.sources import star
    texts = spark.range(6).select(F.col("id").alias("scan_id"), F.lit("Soap\nMRP Rs. 10\nMfg: 01/02/2024").alias("ocr_text"))
    monkeypatch.setattr(star, "label_text", lambda *_: texts)
    monkeypatch.setattr(star, "read", lambda *_: texts)
    captures = reading._label_captures(spark, "")
    chosen = choose_frames(captures.withColumns({c: F.lit(None).cast(k) for c, k in (("ocr_engine", "string"), ("coord_w", "int"), ("coord_h", "int"), ("ppm", "double"))}))
    assert "ENSURE_REQUIREMENTS" not in chosen._jdf.queryExecution().executedPlan().toString()
    assert chosen.count() == 6


def test_merge_lays_out_scans_with_gaps_only(spark, monkeypatch):
    from packlens.plans import merge

    text = "Mustard Oil\nAcme Foods, Plot 1, Delhi 110001\nMfg: 22/12/2025 Exp: 18/02/2026"
    rows = [(1, 0, 90.0, f"{text}\nMRP Rs. 50.00", "7.00"), (2, 0, 90.0, f"{text}\nMRP", "60.00"), (2, 0, 80.0, "MRP", "60.00"), (3, 0, 90.0, "MRP", None), (None, 0, 90.0, "MRP", "9.00")]
    frames = spark.createDataFrame(rows, "scan_id long, frame_index int, ocr_confidence double, text string, amount string").selectExpr(
        "scan_id", "frame_index", "ocr_confidence", "text", "cast(null as double) font_mm", "cast(null as double) letter_mm", "cast(null as double) ratio", "true has_boxes",
        f"if(amount is null, null, array(named_struct('ord', 1L, 'text', 'MRP', 'x', 0, 'y', 0, 'w', 30, 'h', 20, 'confidence', 80D), "
        f"named_struct('ord', 2L, 'text', amount, 'x', 0, 'y', 40, 'w', 50, 'h', 20, 'confidence', 80D))) boxes")
    laid = []
    real = merge.visual_lines
    monkeypatch.setattr(merge, "visual_lines", lambda words: laid.append(words) or real(words))
    got = {r["scan_id"]: r["mrp"] for r in merge.merge_scan(frames).collect()}
    assert (got[1], got[2], got[3]) == (50.0, 60.0, None)
    assert {r["scan_id"] for r in laid[0].select("scan_id").distinct().collect()} == {2, None}


def test_settled_tables_leave_no_shuffle_files(spark, tmp_path):
    from packlens.session import settle

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before, df = spark.conf.get(key), spark.range(1000).selectExpr("id", "id % 7 AS k").repartition(3, "k")
    held = blocks.getAllFiles().size()
    kept = settle(df, "dealt")
    assert blocks.getAllFiles().size() <= held and spark.conf.get(key) == before
    assert kept.count() == df.count() == 1000
