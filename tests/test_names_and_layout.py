import random

from pyspark.sql import functions as F

from packlens.operators import gazetteer, layout
from packlens.operators.ordered import number_rows, run_starts


def test_blocking_loses_nothing(spark):
    rnd = random.Random(3)
    names = ["".join(rnd.choice("abcde ") for _ in range(rnd.randint(4, 14))).strip() + "x" for _ in range(60)]
    queries = []
    for n in names:
        at = rnd.randrange(len(n))
        queries += [n[:at] + "~" + n[at + 1:] + ", Plot 9", n[:at] + n[at + 1:] + "~"]
    queries = sorted({q for q in queries if len(q) >= 5})
    expected = {(q, n) for q in queries for n in names if gazetteer.partial_ratio(q, n) >= 90}
    found = gazetteer.candidate_pairs(
        spark.createDataFrame([(q,) for q in queries], "query string"),
        spark.createDataFrame(list(zip(names, range(len(names)))), "name string, position long"), cutoff=90.0)
    got = {(r.query, r["name"]) for r in found.collect()}
    assert expected and expected <= got


def greedy(words):
    med = sorted(w[3] for w in words)[len(words) // 2]
    tol, rows = max(2.0, med * 0.5), []
    for w in sorted(words, key=lambda t: t[2]):
        for row in rows:
            if abs(w[2] + w[3] / 2 - sum(r[2] + r[3] / 2 for r in row) / len(row)) <= tol:
                row.append(w)
                break
        else:
            rows.append([w])
    return sorted(" ".join(r[0] for r in sorted(row, key=lambda t: t[1])) for row in rows)


def test_visual_rows_equal_sequential_fold(spark):
    rnd = random.Random(5)
    words = [(f"w{i}", rnd.randrange(900), rnd.randrange(400), rnd.randrange(15, 26)) for i in range(150)]
    df = spark.createDataFrame([(1, i, w[0], w[1], w[2], 30, w[3], 50.0) for i, w in enumerate(words)],
                               "scan_id long, ord long, text string, x int, y int, w int, h int, confidence double")
    assert sorted(r.text for r in layout.visual_lines(df).collect()) == greedy(words)


def test_ranges_number_like_one_window(spark):
    df = spark.range(100).select(F.lit(1).alias("k"), F.col("id").alias("pos"), F.floor(F.col("id") / 7).alias("v"))
    assert all(r.n == r.pos + 1 for r in number_rows(df, ["k"], "pos", [], width=8).collect())
    assert all(r.run_start == r.pos // 7 * 7 for r in run_starts(df, ["k"], "pos", ["v"], width=8).collect())


def test_best_name_equals_brute_force(spark):
    names = ["Amul", "Hindustan Unilever", "Parle Agro", "Parle Products", "Patanjali Foods"]
    queries = ["Hindustan Uniiever Ltd, Mumbai", "by Amul dairy", "Parle Agri", "Patanjali Foods Limited", "nothing here", "abc"]
    got = gazetteer.match_names(
        spark.createDataFrame([(q,) for q in queries], "query string"),
        spark.createDataFrame(list(zip(names, range(len(names)))), "name string, position long")).collect()
    expected = {}
    for q in queries:
        scores = [(gazetteer.partial_ratio(q, n), -i) for i, n in enumerate(names)]
        top = max(scores)
        if len(q) >= 5 and top[0] >= 90:
            expected[q] = names[-top[1]]
    assert expected and {r["query"]: r["name"] for r in got} == expected


def _slow_ratio(a, b):
    """Best 2 * LCS / total over all windows, by the textbook table."""
    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            new = [0]
            for j, e in enumerate(y):
                new.append(row[j] + 1 if c == e else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    def best(n, h):
        cuts = [h[max(0, i):i + len(n)] for i in range(1 - len(n), len(h))]
        return max(200.0 * lcs(n, c) / (len(n) + len(c)) for c in cuts)

    if len(a) == len(b):
        return max(best(a, b), best(b, a))
    return best(*sorted((a, b), key=len))


def test_scores_equal_the_definition():
    rnd = random.Random(9)
    for size in (1, 2, 7, 63, 64, 65, 130):
        for _ in range(4):
            a = "".join(rnd.choice("abé漢 ") for _ in range(size))
            b = "".join(c for c in a if rnd.random() > 0.1) + "".join(rnd.choice("abé") for _ in range(rnd.randint(0, 9)))
            if b:
                assert abs(gazetteer.partial_ratio(a, b) - _slow_ratio(a, b)) < 1e-9


def test_long_names_and_hot_segments(spark, monkeypatch):
    rnd = random.Random(4)
    monkeypatch.setattr(gazetteer, "PER_SALT", 3)  # the shared stem is dealt over several salts
    stem = "The Very Long Registered Name of a Family Company from the Old Town by the River "
    names = [stem + "".join(rnd.choice("abcdefgh") for _ in range(8)) for _ in range(12)] + ["Abc", "Old Town", "x"]
    queries = []
    for n in names[:12]:
        at = rnd.randrange(len(n))
        queries += [f"made by {n[:at]}~{n[at + 1:]}, Pune", n[:at] + n[at + 1:], n[:at] + "qq" + n[at:]]
    queries += ["Old  Town", "Town b", "  ", "River", None]
    for cutoff in (90.0, 93.0):
        got = gazetteer.match_names(spark.createDataFrame([(q,) for q in queries], "query string"),
                                    spark.createDataFrame(list(zip(names, range(len(names)))), "name string, position long"), cutoff=cutoff)
        expected = {}
        for q in {" ".join(q.split()) for q in queries if q}:
            top = max((_slow_ratio(q, n), -i) for i, n in enumerate(names)) if q else (0, 0)
            if len(q) >= 5 and top[0] >= cutoff:
                expected[q] = names[-top[1]]
        assert {r["query"]: r["name"] for r in got.collect()} == expected


def test_names_of_one_template_meet_few_others(spark, monkeypatch):
    monkeypatch.setattr(gazetteer, "PER_SALT", 3)
    names = [f"Supplier#000000{i}" for i in range(100, 180)]
    queries = [n[:at] + "~" + n[at + 1:] for at, n in zip((2, 9, 13, 16, 17, 0), names[5::13])]
    queries += ["Supplier#0000001~~", "by Supplier#0000001", "x~pplier#000000150, Plot 4", "Main Road"]  # two characters lost at an end
    asked = spark.createDataFrame([(q,) for q in queries], "query string")
    known = spark.createDataFrame(list(zip(names, range(len(names)))), "name string, position long")
    assert gazetteer.near_pairs(asked, known, cutoff=93.0).select("query", "name").distinct().count() < 12 * len(queries)
    found = asked.where("query LIKE '%~%' AND query NOT LIKE '%~~%'").where("length(query) = 18").select("query", F.lit(19).alias("least"))
    assert gazetteer.rest_pairs(found, known, cutoff=93.0).count() == 0  # nothing that loses two of 18 characters beats what loses one
    expected = {}
    for q in queries:
        raw, at = max((gazetteer.partial_ratio(q, n), -i) for i, n in enumerate(names))
        if raw >= 93:
            expected[q] = (names[-at], round(raw, 1))
    assert "Supplier#0000001~~" in expected
    assert {r["query"]: (r["name"], r["score"]) for r in gazetteer.match_names(asked, known, cutoff=93.0).collect()} == expected


def test_known_makers_inside_extraction(spark):
    from packlens.operators.extraction import extract_declarations

    names = spark.createDataFrame([("Hindustan Unilever", 0), ("Acme Foods", 1), ("Patanjali Foods", 2), ("Tata", 3)], "name string, position long")
    texts = [
        "Instant Noodles\nHindustan Uniiever Ltd, Mumbai 400001\nNet Qty: 60 g",
        "Instant Noodles\nHindustan Uniiever Ltd\nNet Qty: 60 g",
        "Atta\nManufactured by: Patanjali Foods Limited\nHaridwar 249401",
        "Xyzzy Quux\nCustomer Care: care@example.in 1800-123-456\nPack of 9 tablets",
        "", None,
    ]
    df = spark.createDataFrame([(i, t, 40.0) for i, t in enumerate(texts)], "scan_id long, ocr_text string, ocr_confidence double")
    plain = {r.scan_id: r for r in extract_declarations(df).collect()}
    known = {r.scan_id: r for r in extract_declarations(df, names).collect()}
    assert known.keys() == plain.keys()
    assert known[0].manufacturer_name == known[1].manufacturer_name == "Hindustan Unilever"
    assert known[0].field_sources["manufacturer_name"] == known[1].field_sources["manufacturer_name"] == "inferred"
    assert known[2].manufacturer_name == plain[2].manufacturer_name and known[2].field_sources == plain[2].field_sources
    assert all(known[i].manufacturer_name is None and known[i].field_sources == plain[i].field_sources for i in (3, 4, 5))
    drop = ("manufacturer_name", "field_sources")
    assert all(known[i][c] == plain[i][c] for i in known for c in plain[0].asDict() if c not in drop)


def test_words_dealt_by_scan_are_not_shuffled_again(spark):
    words = spark.createDataFrame([(s, i, f"w{i}", 120 * i, 40 * (i // 3) + s, 50, 20, 50.0) for s in (1, 2) for i in range(9)] + [
        (None, 1, "lost", 0, 0, 50, 20, 50.0)], "scan_id long, ord long, text string, x int, y int, w int, h int, confidence double").repartition("scan_id")
    weak = layout.row_boxes(words).select("*", F.lit("MRP Rs. 10").alias("new_text"))
    for out in (layout.visual_lines(words), layout.weak_rows(words), layout.accepted_rereads(weak.drop("new_text"), weak.select("scan_id", "row_key", "new_text"))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "ENSURE_REQUIREMENTS" not in plan and "InPandas" not in plan
    assert sorted((r.scan_id, r.text) for r in layout.visual_lines(words).collect()) == [(s, f"w{i} w{i + 1} w{i + 2}") for s in (1, 2) for i in (0, 3, 6)]


def test_spliced_rows_replace_their_words_only(spark):
    word = "scan_id long, ord long, text string, x int, y int, w int, h int, confidence double"
    words = spark.createDataFrame([(1, 1, "a", 0, 40, 9, 20, 1.0), (1, 2, "b", 9, 40, 9, 20, 1.0), (1, 3, "c", 0, 80, 9, 20, 1.0),
                                   (2, 1, "d", 0, 40, 9, 20, 1.0), (None, 1, "e", 0, 40, 9, 20, 1.0)], word)
    repairs = spark.createDataFrame([(1, 2, 1, "new", 0, 40, 18, 20, 5.0), (3, 2, 1, "alone", 0, 40, 18, 20, 5.0), (None, 2, 1, "nowhere", 0, 40, 9, 20, 5.0)],
                                    "scan_id long, row_key long, accepted_no int, new_text string, x int, y int, w int, h int, confidence double")
    got = layout.row_repair_splice(words, repairs)
    assert sorted((r.scan_id or 0, r.text) for r in got.collect()) == [(0, "e"), (0, "nowhere"), (1, "c"), (1, "new"), (2, "d"), (3, "alone")]
    assert dict(got.dtypes) == dict(words.dtypes)


def test_large_inputs_are_spread_too(spark):
    from packlens.sources import star
    cores = spark.sparkContext.defaultParallelism
    big = spark.range(0, 1 << 26, 1, 1)  # 512 MB by its statistics, in one piece: what one row group of a large file gives
    assert star.spread(big).rdd.getNumPartitions() >= 8 * cores
    assert star.spread(spark.range(0, 8, 1, 1)).rdd.getNumPartitions() == 1


def test_lines_of_words_dealt_by_scan_are_not_shuffled(spark):
    from packlens.operators import frames
    at = [(0, 0, 0), (0, 0, 0), (0, 0, 1), (0, 0, 0), (None, 0, 0), (None, 0, 0)]
    words = spark.createDataFrame([(s, i, f"w{i}", *p) for s in (1, 2) for i, p in enumerate(at)] + [(None, 1, "lost", 0, 0, 0), (1, None, "lost", 0, 0, 0)],
                                  "scan_id long, ord long, text string, block int, par int, line int").repartition("scan_id")
    out = frames.line_rebuild(words)
    assert "ENSURE_REQUIREMENTS" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in out.collect()) == [(s, *x) for s in (1, 2) for x in ((0, "w0 w1"), (2, "w2"), (3, "w3"), (4, "w4 w5"))]


def test_rescue_looks_at_rows_inside_a_scan(spark):
    from packlens.operators.patches import layout_rescue

    decl = spark.createDataFrame(
        [(1, None, None, None, None, None, {}), (2, 5.0, None, None, "Own", None, {"mrp": "read"}), (3, None, None, None, None, None, {}), (None, None, None, None, None, None, {}), (1, 7.0, None, None, None, "Old", {})],
        "scan_id long, mrp double, mfg_date date, expiry_date date, manufacturer_name string, manufacturer_address string, field_sources map<string,string>")
    texts = ["MRP", "Energy per 100 g 12", "Rs. 45.50", "Mfg: 01/02/2024", "Manufactured by: Acme Foods", "Plot 4, Pune", "Exp", "05/06/2025"]
    rows = [(1, 0.0, k * 30.0, 90.0, k * 30.0 + 20, 80.0, k, t) for k, t in enumerate(texts)]
    rows += [(2, 0.0, 0.0, 90.0, 20.0, 80.0, 1, "Mfg"), (2, 0.0, 0.0, 90.0, 20.0, 80.0, 1, "02/03/2023"), (2, 0.0, 17.0, 90.0, 40.0, 80.0, 2, "03/04/2022")]
    lines = spark.createDataFrame(rows, "scan_id long, x0 double, y0 double, x1 double, y1 double, conf double, first_ord long, text string")
    out = layout_rescue(decl, lines)
    got = sorted((tuple(str(v) for v in r[:5]) for r in out.select("scan_id", "mrp", "mfg_date", "expiry_date", "manufacturer_name").collect()))
    assert got == sorted([
        ("1", "45.5", "2024-02-01", "2025-06-05", "Acme Foods"), ("1", "7.0", "2024-02-01", "2025-06-05", "Acme Foods"),
        ("2", "5.0", "2023-03-02", "None", "Own"), ("3", "None", "None", "None", "None"), ("None", "None", "None", "None", "None")])
    assert out.where("scan_id = 1 AND mrp = 7").first()["manufacturer_address"] == "Old"
    # A scan's rows come to its declaration once: one join on them, and one for the scans that have a gap.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def test_first_where_stops_at_the_first_hit(spark):
    from packlens.functions.fields import first_where

    items = spark.createDataFrame([(["1", "2", "x"],), (["x"],), ([],), (None,)], "a array<string>")
    # Casting 'x' fails: behind the first hit nothing is looked at.
    got = items.where("a IS NULL OR size(a) <> 1").select(first_where(F.col("a"), "string", lambda s: s.cast("int") > 1).alias("v")).collect()
    assert [r["v"] for r in got] == ["2", None, None]


def test_names_are_not_copied_to_the_driver(spark, monkeypatch):
    from packlens.operators import gazetteer

    names = spark.createDataFrame([(f"Supplier#{k:09d}", k) for k in range(300)] + [("Acme Foods", 900)], "name string, position long")
    decl = spark.createDataFrame([(k, f"Supplier#{k:09d}".replace("lier", "l~er") if k % 2 else f"by Supplier#{k:09d}") for k in range(40)] + [(99, None), (98, "Acme Foods"), (98, "Acme Fodds")],
                                 "scan_id long, manufacturer_name string")
    got = {}
    for held in (gazetteer.HELD_ROWS, -1):
        monkeypatch.setattr(gazetteer, "HELD_ROWS", held)
        out = gazetteer.gazetteer_fix(decl, names)
        assert held > 0 or "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
        got[held] = sorted((r["scan_id"], r["manufacturer_name"], r["rewritten"]) for r in out.where("scan_id <> 99").collect())
    assert len({str(x) for x in got.values()}) == 1
    assert (1, "Supplier#000000001", True) in got[-1] and (0, "by Supplier#000000000", False) in got[-1] and (98, "Acme Foods", False) in got[-1]
