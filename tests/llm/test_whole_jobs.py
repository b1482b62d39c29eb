"""Cases that bounds and shortcuts of the numbered operators used to lose."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F


def test_near_copies_behind_a_far_hub(spark):
    from packlens.llm import order_minhash as om

    rng = np.random.default_rng(7)
    words = lambda n: list(rng.choice([f"w{k}" for k in range(5000)], n))
    passages = [words(20) for _ in range(8)]
    mosaic = lambda which, own: " ".join(sum((passages[k] for k in which), []) + own)
    own = words(40)
    hub, one, two = mosaic((0, 1, 2, 3), words(40)), mosaic((0, 4, 5, 6), own), mosaic((0, 4, 5, 6), own[:-6] + words(6))
    inside = " ".join(hub.split()[:40])  # nothing of it is outside the hub
    docs = spark.createDataFrame(list(enumerate((hub, one, two, inside, inside + " a"))), "doc_id long, text string")
    slim = om._identified(docs, "doc_id", "text")
    uid = {r["text"]: bytes(r["uid"]) for r in slim.collect()}
    # One bucket with the hub, and nothing else known: both hidden pairs come back.
    pairs = om._hidden_pairs(slim.select("uid", F.col("uid").alias("class"), "text"), om.SIMILAR).collect()
    found = {frozenset((bytes(r["hub"]), bytes(r["uid"]))) for r in pairs}
    for a, b in ((one, two), (inside, inside + " a")):
        sets = [om.shingles(pa.array([t]))[0] for t in (hub, a, b)]
        assert om.aligned(sets[0], sets[1]) < 0.5 and om.aligned(sets[0], sets[2]) < 0.5 and om.aligned(sets[1], sets[2]) >= om.SIMILAR
        assert frozenset((uid[a], uid[b])) in found


def _near_classes(om, texts):
    labelled, bounds = om.shingles(pa.array(texts))
    sets = [set(labelled[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
    arrays = [labelled[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    return [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= om.SIMILAR * len(sets[i] | sets[j]) and om.aligned(arrays[i], arrays[j]) >= om.SIMILAR]


def test_mosaics_of_frequent_passages(spark):
    """Near copies among texts made of passages that many share: every bucket is hot, every hub hides most."""
    from packlens.llm import order_minhash as om

    rng = np.random.default_rng(11)
    words = lambda n: list(rng.choice([f"w{k}" for k in range(9000)], n))
    passages = [words(30) for _ in range(12)]
    texts = []
    for _ in range(220):
        parts = [passages[k] for k in rng.permutation(12)[:6]]
        texts.append(sum(parts, []) + words(36))
    for k in range(40):  # near copies: a few words changed
        copy = list(texts[k])
        for _ in range(3):
            copy[int(rng.integers(len(copy)))] = str(rng.choice(words(1)))
        texts.append(copy)
    texts = [" ".join(t) for t in texts]
    near = _near_classes(om, texts)
    got = {r["doc_id"]: r["class_id"] for r in om.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    caught = sum(got[i] == got[j] for i, j in near)
    assert len(near) >= 30 and caught >= 0.99 * len(near)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in near:
        a, b = sorted((find(i), find(j)))
        parent[b] = a
    assert all(find(i) == find(got[i]) for i in got)  # and nothing else is joined


def test_prefixes_meet():
    from packlens.llm import order_minhash as om

    rng = np.random.default_rng(3)
    for _ in range(300):
        pool, ranks = rng.permutation(400).astype(np.uint64), rng.integers(0, 5, 400)
        size = int(rng.integers(1, 120))
        a, b = pool[:size], np.concatenate([pool[: size - int(rng.integers(0, size // 5 + 1))], pool[200 : 200 + int(rng.integers(0, size // 5 + 1))]])
        if len(np.intersect1d(a, b)) >= om.SIMILAR * len(np.union1d(a, b)):
            first = [x[om.prefix(x, ranks[x.astype(int)], om.SIMILAR)].tolist() for x in (a, b)]
            assert set(first[0]) & set(first[1])
            # The first shared one leaves room for all that must be shared.
            shared = min(set(a.tolist()) & set(b.tolist()), key=lambda v: (ranks[int(v)], v))
            room = min(len(x) - sorted(x.tolist(), key=lambda v: (ranks[int(v)], v)).index(shared) for x in (a, b))
            assert room >= np.ceil((len(a) + len(b)) * om.SIMILAR / (1 + om.SIMILAR) - 1e-9)


def test_parities_never_differ_more_than_texts():
    from packlens.llm import order_minhash as om

    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    sets = [rng.permutation(pool)[: int(rng.integers(0, 1500))] for _ in range(40)]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    odd = om.parities(np.concatenate(sets), bounds).view(np.uint64)
    for i in range(len(sets)):
        for j in range(i):
            assert int(np.bitwise_count(odd[i] ^ odd[j]).sum()) <= len(np.setxor1d(sets[i], sets[j]))
