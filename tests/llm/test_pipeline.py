"""The pipeline against brute force, each stage on its own input."""

import itertools
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    import corpus_pipeline
    from packlens.llm import line_dedup as ld
    from packlens.llm import order_minhash as om
    from test_operators import _hits

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [{r["doc_id"]: r for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns
            seen.append({r["doc_id"]: r for r in docs.collect()})
    start, identified, lined, single, clean = seen
    assert set(start) == set(identified)  # every text here has a language

    # Lines of twenty characters or more within two edits of an earlier one go; brute force over distinct lines of near lengths.
    where = {}
    for key in sorted(identified):
        for n, line in enumerate(identified[key]["text"].split("\n")):
            where.setdefault(line, (key, n))
    long = [x for x in where if len(x) >= ld.SHORTEST]
    codes = {x: np.array([ord(c) for c in x], np.int64) for x in long}
    parent = {x: x for x in long}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_size = defaultdict(list)
    for x in long:
        by_size[len(x)].append(x)
    for size, own in by_size.items():
        for a in own:
            for b in itertools.chain(own, by_size.get(size + 1, ()), by_size.get(size + 2, ())):
                if (size < len(b) or a < b) and sum((Counter(a) - Counter(b)).values()) <= 2 and ld._plain_distance(codes[a], codes[b]) <= 2:
                    low, high = sorted((root(a), root(b)))
                    parent[high] = low
    seen_classes, gone = set(), set()
    for key in sorted(identified):
        lines = identified[key]["text"].split("\n")
        kept = [x for x in lines if len(x) < ld.SHORTEST or not (root(x) in seen_classes or seen_classes.add(root(x)))]
        if key not in lined:
            gone.add(key)
            assert not "\n".join(kept).strip()
        else:
            assert lined[key]["text"] == "\n".join(kept)
            assert lined[key]["n_chars"] == len(lined[key]["text"])

    ids = sorted(lined)
    labelled, bounds = om.shingles(pa.array([lined[k]["text"] for k in ids]))
    sets = [set(labelled[a:b].tolist()) for a, b in itertools.pairwise(bounds)]
    parent = dict(zip(ids, ids))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(enumerate(ids), 2):
        if lined[a]["text"] == lined[b]["text"] or sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    assert set(single) == {find(k) for k in ids}

    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    ids = sorted(single)
    assert set(clean) == {k for k, (_, hit, _) in zip(ids, _hits([single[k]["text"] for k in ids], bench)) if not hit}
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} == set(clean)
    assert corpus_pipeline.run(spark, SF).count() == docs.count()
