"""Lines by characters, and short lines."""

import itertools

import numpy as np


def test_line_edits_count_characters(spark):
    from packlens.llm import line_dedup as ld

    rng = np.random.default_rng(11)
    alphabet = list("abc déñ日本語文字😀🎉")
    base = ["".join(rng.choice(alphabet, rng.integers(17, 40))) for _ in range(12)] + ["plain words of a line in ascii"]
    lines = list(base)
    for _ in range(70):
        line = str(rng.choice(base))
        for _ in range(int(rng.integers(4))):
            at = int(rng.integers(len(line)))
            line = line[:at] + "".join(rng.choice(alphabet, rng.integers(2))) + line[at + int(rng.integers(2)) :]
        lines.append(line)
    points = {x: np.array([ord(c) for c in x]) for x in lines if len(x) >= ld.SHORTEST}
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string").repartition(3)
    for threshold in (1, 2):
        want = sum(ld._plain_distance(points[a], points[b]) <= threshold for a, b in itertools.combinations(points, 2))
        assert ld.linked_lines(ld._slim(df, "doc_id", "text"), threshold, characters=True).count() == want > 0
    two = spark.createDataFrame([(1, "これは二十文字より長い日本語の一行であります甲"), (2, "これは二十文字より長い日本語の一行であります乙")], "doc_id long, text string")
    assert {r["n_links"] for r in ld.line_classes(two).collect()} == {1}


def test_equal_short_lines_have_one_class(spark):
    from packlens.llm import line_dedup as ld

    df = spark.createDataFrame([(1, "short\n日本語\na line that is long enough to be one"), (2, "日本語\n\nshort"), (3, "shore")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in ld.line_classes(df).collect()}
    assert rows[1]["line_classes"][:2] == rows[2]["line_classes"][::-1] and rows[3]["line_classes"][0] not in rows[1]["line_classes"]
    assert [(rows[k]["n_long_lines"], rows[k]["n_kept"]) for k in (1, 2, 3)] == [(1, 1), (0, 0), (0, 0)]
    assert {r["doc_id"] for r in ld.drop_repeated_lines(df, short_lines=True).collect()} == {1, 3}
