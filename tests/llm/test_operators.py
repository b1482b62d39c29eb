"""Small cases of the numbered operators: brute force, round trips, and the defined odd cases."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

SF = "/root/testdata/sf0.001"
LONG = "The quick brown fox jumps over the lazy dog and runs away. " * 4000
TEXTS = [
    (1, "The weather of today is nice and the sun shines over the old town hall.\nSecond line of some words here."),
    (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, "é à 日本語 ñ <|endoftext|> x"), (7, "12 34 !!"),
    (8, "The weather of today is nice and the sun shines over the old town hall.\nSecond line of some words here."),
    (8, "The weather of today is nice and the sun shines over the old town hall.\nSecond line of some words here."),
    (None, "a b"), (9, "a"), (10, "Line line line line line one\nLine line line line line one\nother words"), (2, None),
]
CLASH = "size shard slot row uid key line hub number class text_key n_words lang_pred score node a b n word window_id _gone _row _id"


@pytest.fixture(scope="module")
def messy(spark):
    extra = CLASH.split()
    rows = [(i, t, None if k % 3 else "en", "s", len(t) if t else None, *["x"] * len(extra)) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def items(spark):
    return spark.createDataFrame([(1, "of today is nice and the sun shines over the old town hall"), (2, None), (3, "!!"), (None, "a b"), (4, "quick brown fox")], "item_id long, text string")


def test_sharding(spark, messy, docs):
    from packlens.llm.sharding import assign, choose_splitters, range_of, shard

    for df in (messy, docs, messy.limit(0)):
        got = shard(df, 4, keep=["doc_id", "text"]).collect()
        assert Counter(r["row"]["doc_id"] for r in got) == Counter(r["doc_id"] for r in df.select("doc_id").collect())
        by, homes = defaultdict(list), defaultdict(set)
        for r in got:
            assert r["size"] == len((r["row"]["text"] or "").encode()) + 1
            by[r["shard"]].append(r["slot"])
            homes[r["row"]["text"]].add(r["shard"])
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
        assert all(len(v) == 1 for v in homes.values())
    loads = Counter()
    for r in shard(docs, 4).select("shard", "size").collect():
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) < 1.05 * min(loads.values())
    # One text with half of all rows is subdivided, and its parts are spread.
    h = np.array([7] * 500 + list(range(1000, 1500)), np.int64)
    k = np.arange(1000, dtype=np.int64)
    cut_h, cut_k = choose_splitters(h, k, np.ones(1000), 40)
    where = range_of(h, k, cut_h, cut_k)
    keys = list(zip(cut_h.tolist(), cut_k.tolist()))
    assert where.tolist() == [sum(c <= x for c in keys) for x in zip(h.tolist(), k.tolist())]
    sizes = np.bincount(where, minlength=len(keys) + 1)
    home, _ = assign(sizes, sizes, cut_h, cut_k, 4)
    assert sizes.max() < 60 and np.bincount(home, sizes).max() < 265


def test_edit_distance_and_line_links(spark):
    from packlens.llm import line_dedup as ld

    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("abcd efgé"), rng.integers(15, 40))) for _ in range(25)]

    def changed(s, times):
        for _ in range(times):
            at = int(rng.integers(len(s)))
            s = s[:at] + str(rng.choice(list("xé "))) * int(rng.integers(2)) + s[at + int(rng.integers(2)) :]
        return s

    lines = base + [changed(str(rng.choice(base)), int(rng.integers(4))) for _ in range(80)]
    raw = [np.frombuffer(x.encode(), np.uint8).astype(np.int64) for x in lines]
    pairs = list(itertools.combinations(range(len(lines)), 2))
    plain = {p: ld._plain_distance(raw[p[0]], raw[p[1]]) for p in pairs if abs(len(raw[p[0]]) - len(raw[p[1]])) < 6}
    for most in (1, 2, 4):
        got = ld.edit_distances([raw[a] for a, _ in plain], [raw[b] for _, b in plain], most)
        assert all(g == want if want <= most else g > most for g, want in zip(got, plain.values()))
    df = spark.createDataFrame([(k, "\n".join(lines[k : k + 3])) for k in range(0, len(lines), 3)], "doc_id long, text string").repartition(3)
    unique = {x: k for k, x in enumerate(lines) if len(x.encode()) >= ld.SHORTEST}
    for threshold in (1, 2, 3):
        want = sum(plain.get((min(a, b), max(a, b)), 99) <= threshold for a, b in itertools.combinations(unique.values(), 2))
        assert ld.linked_lines(ld._slim(df, "doc_id", "text"), threshold).count() == want


def test_line_dedup_cases(spark, messy):
    from packlens.llm import line_dedup as ld

    first, last = "a line that is long enough number one", "a line that is long enough number two"
    df = spark.createDataFrame(
        [(1, f"{first}\nshort\n{last}"), (2, f"{first}!\nshort\nsomething else that is new and long"), (3, first), (4, "short"), (5, None), (6, ""), (7, f"{first}\n\n{first}"), (4, "short")],
        "doc_id long, text string",
    )
    got = sorted(ld.drop_repeated_lines(df).collect(), key=str)
    want = [(1, f"{first}\nshort\n{last}"), (2, "short\nsomething else that is new and long"), (4, "short"), (4, "short"), (5, None), (6, "")]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    rows = {r["doc_id"]: r for r in ld.line_classes(df).collect()}
    assert rows[7]["line_classes"] == rows[3]["line_classes"] * 2 and rows[7]["n_kept"] == 0
    assert rows[2]["n_links"] == 1 and rows[2]["line_classes"][0] == rows[1]["line_classes"][0]
    kept = ld.drop_repeated_lines(messy, n_chars="n_chars")
    assert kept.columns == messy.columns and ld.line_classes(messy).count() == messy.count()
    text = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert text[5] == LONG and text[10] == "Line line line line line one\nother words" and 2 in text
    assert ld.drop_repeated_lines(messy.limit(0)).count() == ld.line_classes(messy.limit(0)).count() == 0


def test_language_id(spark, docs, messy):
    from pyspark.sql import functions as F

    from packlens.llm import language_id as li

    model = li.train(docs)
    got = li.detect(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(li.held_out(F.col("doc_id"))).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)
    # The forward sum equals the sum over all segmentations.
    table = {int(k): model.p[i] for i, k in enumerate(model.keys.tolist())}

    def brute(word: bytes):
        if not word:
            return np.ones(len(model.languages))
        return sum((table[int.from_bytes(word[:k], "big")] * brute(word[k:]) for k in range(1, min(li.LONGEST, len(word)) + 1) if int.from_bytes(word[:k], "big") in table), np.zeros(len(model.languages)))

    for word in (b"the", b"nation", "élève".encode(), b"x" * 12):
        score = model.word_scores(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0]
        assert np.allclose(score, np.log(brute(word)))
    data = np.frombuffer(b"thestreetofthe" * 20, np.uint8)
    wide = li._forward(li._spans(data[None, :60], model.keys, li.LONGEST), model.p)[0, 60]
    assert np.allclose(model._long(data[:60]), np.log(wide))
    seen = {(r["doc_id"], r["lang_pred"] == "und") for r in li.detect(messy, model).collect()}
    assert {(2, True), (3, True), (4, True), (7, True), (1, False), (6, False), (None, False)} <= seen
    assert li.keep_identified(messy, model).columns == messy.columns
    nothing = li.train(docs.limit(0))
    assert {r["lang_pred"] for r in li.detect(messy, nothing).collect()} == {"und"} and li.detect(messy.limit(0), model).count() == 0


def test_pseudo_likelihood(docs, messy):
    from packlens.llm import pseudo_likelihood as pl
    from packlens.llm import wordbytes as wb

    model = pl.train(docs)
    top, order, net = model
    around = np.random.default_rng(1).integers(0, pl.CLASSES, (5, len(pl.SIDES)))
    total = sum(np.exp(net.log_probability(around, np.full(5, c))) for c in range(pl.CLASSES))
    assert np.allclose(total, 1, atol=1e-4)
    start = pl.score(docs, (top, order, pl.Network.start())).groupBy().sum("log_likelihood").first()[0]
    assert pl.score(docs, model).groupBy().sum("log_likelihood").first()[0] > start
    assert np.allclose(pl.Network.of(net.rows()).out, net.out)
    for r, (_, text) in zip(pl.score(messy, model).collect(), TEXTS):
        words = wb.words(pa.array([text or ""]), wb.ALNUM, True)
        ids = [0, 0, *pl._classes(words, top, order).tolist(), 0, 0]
        sides = np.array([[ids[k - 2], ids[k - 1], ids[k + 1], ids[k + 2]] for k in range(2, len(ids) - 2)]).reshape(-1, 4)
        want = net.log_probability(sides, np.array(ids[2:-2], np.int64)).astype(float).sum() if len(sides) else 0
        assert r["n_tokens"] == len(ids) - 4 and abs(r["log_likelihood"] - want) < 1e-3 * max(1, abs(want))
        assert (r["mean_log_likelihood"] is None) == (len(ids) == 4)
    assert pl.score(messy.limit(0), pl.train(messy.limit(0))).count() == 0


def test_near_duplicates(spark, docs, messy):
    from packlens.llm import order_minhash as om

    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(4000)]
    rows, want = [], []
    for group in range(12):
        base = list(rng.choice(words, 150))
        for copy in range(int(rng.integers(1, 9))):
            text = list(base)
            for _ in range(int(rng.integers(0, 4))):
                text[int(rng.integers(len(text)))] = str(rng.choice(words))
            rows.append((len(rows), " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labelled, bounds = om.shingles(pa.array([t for _, t in rows]))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        one, two = (set(labelled[bounds[x] : bounds[x + 1]].tolist()) for x in (a, b))
        if len(one & two) >= om.SIMILAR * len(one | two):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    want = {k: find(k) for k in range(len(rows))}
    assert {r["doc_id"]: r["class_id"] for r in om.near_duplicates(df).collect()} == want
    assert sorted(r["doc_id"] for r in om.drop_near_duplicates(df).collect()) == sorted(set(want.values()))
    classes = [(r["doc_id"], r["class_id"]) for r in om.near_duplicates(messy).collect()]
    assert len(classes) == len(TEXTS) and classes.count((8, 1)) == 2 and classes.count((2, 2)) == 2
    kept = om.drop_near_duplicates(messy)
    assert kept.columns == messy.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 2, 3, 4, 5, 6, 7, None, 9, 10])
    assert om.near_duplicates(messy.limit(0)).count() == om.drop_near_duplicates(messy.limit(0)).count() == 0


def test_order_counts():
    from packlens.llm import order_minhash as om

    a = np.arange(100, dtype=np.uint64)
    assert om.aligned(a, a) == 1 and om.aligned(a, np.concatenate([a[50:], a[:50]])) < 0.4
    keys = om.sketches(np.concatenate([a, a, a[::-1]]), np.array([0, 100, 200, 300]))
    assert (keys[0] == keys[1]).all() and (keys[0] != keys[2]).all()


def test_packing(spark, docs, messy):
    from tokenizers import Tokenizer

    from packlens.llm import packing as pk

    sizes = np.random.default_rng(0).integers(1, 257, 700)
    where, bins = pk.balance(sizes, 1024)
    loads = np.bincount(where, sizes, bins)
    assert loads.max() <= 1024 and loads.sum() == sizes.sum() and bins <= -(-sizes.sum() // 1024) * 1.02
    library = Tokenizer.from_file(pk.vocabulary())
    odd = spark.createDataFrame([(k, t) for k, t in enumerate(["  a  b ", "x <|endoftext|> y", " \u3000 a\u00a0b c\x85 d", "it's 'll  we've\n\n x", " a", "a  "])], "doc_id long, text string")
    for df in (messy.dropDuplicates(["doc_id"]), docs, odd):
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in pk.pack(df).collect():
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"])
            pieces[r["doc_id"]].append((r["start"], r["ids"], r["doc_tokens"]))
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for d in df.select("doc_id", "text").collect():
            own = sorted(pieces[d["doc_id"]])
            assert [s for s, _, _ in own] == list(itertools.accumulate([len(i) for _, i, _ in own], initial=0))[:-1]
            ids = [i for _, part, _ in own for i in part]
            assert ids == library.encode(d["text"] or "", add_special_tokens=False).ids + [0] and own[0][2] == len(ids)
        for parts in sequences.values():
            parts.sort()
            ends = list(itertools.accumulate((n for _, n in parts), initial=0))
            assert [o for o, _ in parts] == ends[:-1] and ends[-1] <= 1024
    assert pk.pack(messy.limit(0)).count() == 0 and pk.pack(messy).where("start = 0").count() == len(TEXTS)


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _lower_words(text):
    return _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _hits(texts, entries):
    wins = defaultdict(set)
    for item, text in entries:
        words = _lower_words(text)
        n = min(10, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            wins[tuple(words[k : k + n])].add(item)
    out = []
    for text in texts:
        words, hit, found = _lower_words(text), set(), set()
        for n in {len(w) for w in wins}:
            for k in range(len(words) - n + 1):
                if (w := tuple(words[k : k + n])) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[w]
        out.append((len(words), len(hit), sorted(str(i) for i in found if i is not None)))
    return out


def test_decontamination(spark, docs, messy):
    from packlens.llm import decontaminate as dc

    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for df, entries in ((messy, items(spark)), (docs, bench), (messy, bench.limit(0))):
        rows = df.select("doc_id", "text").collect()
        want = Counter((r["doc_id"], n, h, tuple(i)) for r, (n, h, i) in zip(rows, _hits([r["text"] for r in rows], [tuple(r) for r in entries.select("item_id", "text").collect()])))
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["hit_items"])) for r in dc.contamination(df, entries).collect()) == want
    assert dc.contamination(messy.limit(0), bench).count() == 0
    kept = dc.drop_contaminated(messy, items(spark))
    assert kept.columns == messy.columns and {r["doc_id"] for r in kept.collect()} == {2, 3, 4, 6, 7, 9, 10}


def test_quality(spark, docs, messy):
    from packlens.llm import quality as q

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    models = q.train(docs, labels)
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for df in (messy, docs):
        rows = df.select("text").collect()
        for r, got in zip(rows, q.score(df, models).collect()):
            text = r["text"] or ""
            words = word.findall(text)
            triples = Counter(zip(words, words[1:], words[2:]))
            repeat = {k + j for k, t in enumerate(zip(words, words[1:], words[2:])) if triples[t] > 1 for j in range(3)}
            lines = [x for x in text.split("\n") if word.search(x)]
            want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat))
            assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"]) == want
            assert got["base_failed"] == (len(words) < 50 or 100 * len(repeat) > 50 * len(words)) and not (got["base_failed"] and got["kept"])
    nothing = q.train(docs, labels.limit(0))
    assert set(nothing.values()) == {None}
    assert all(r["kept"] != r["base_failed"] for r in q.score(docs, nothing).collect()) and q.score(messy.limit(0), nothing).count() == 0


def test_quality_held_out(spark):
    from packlens.llm import quality as q

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where("doc_id % 5 = 0")  # not trained on
    models = q.train(docs, labels.where("doc_id % 5 <> 0"), bound=3000)
    scored = q.score(docs, models).join(held, "doc_id")
    r = scored.selectExpr("avg(if(toxic = 1, int(p_toxic >= 0.5), null)) caught", "avg(if(toxic = 0, int(p_toxic < 0.5), null)) clean", "avg(int((p_quality >= 0.5) = (quality = 1))) quality").first()
    assert r["caught"] > 0.75 and r["clean"] > 0.99 and r["quality"] > 0.97


def test_token_counts(spark, docs, messy):
    from tokenizers import Tokenizer

    from packlens.llm import token_counts as tc

    library = Tokenizer.from_file(tc.vocabulary())
    odd = ["<|startoftext|>x <|endoftext|>", "don't WE'LL 'S 've", "ΣΑΣ ΟΔΟΣ İstanbul ẞ", "é ́x ½ ٣٤", "a" * 300, "\x1c a \x85 b\u3000c", None]
    odd = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "doc_id long, text string")
    for df in (messy, docs, odd):
        for d, r in zip(df.select("text").collect(), tc.count_tokens(df).collect()):
            text = d["text"] or ""
            assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(library.encode(text, add_special_tokens=False).ids))
    assert tc.count_tokens(messy.limit(0)).count() == 0


def test_url_filters(spark):
    from packlens.llm.queries import URL_RULES
    from packlens.llm.url_filters import judge

    urls = ["http://example.com/en/1", "http://www.EXAMPLE.com/en/", "https://a.b.net/es/x?q#f", "ftp://net/fr/", "http://xnet/es/", "no scheme", None, "", "http://", "http://com", "http://com?x/", "http://COM/en#a",
            "x://y://example.com/en/", "http://example.com/en", "http://sub.www.example.com/en/a", "http://example.com:80/en/", "http://.net/es/", "http://example.com/EN/"]
    pages = spark.createDataFrame([(k, u, "html", "h", "p") for k, u in enumerate(urls + urls[:2])], "page_id long, url string, html string, host string, path string")
    more = [*URL_RULES, ("example.com", "/e", "allow"), ("org", "", "block"), ("www.example.com", "/en/", "block"), (None, "/", "block")]
    for rules in (list(URL_RULES), more):
        table = spark.createDataFrame(rules, "host string, path string, action string")
        for r in judge(pages, table).collect():
            url = (urls + urls[:2])[r["page_id"]]
            rest = url.split("://", 1)[1] if url and "://" in url else ""
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = host.lower()
            fits = [(len(h + p), len(h), h + p, a) for h, p, a in rules if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
            best = max(fits, default=None, key=lambda f: (f[0], f[1], f[3] == "block"))
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, best[2] if best else None, best[3] if best else "allow")
    assert judge(pages.limit(0), spark.createDataFrame(more, "host string, path string, action string")).count() == 0
    assert {r["verdict"] for r in judge(pages, spark.createDataFrame([], "host string, path string, action string")).collect()} == {"allow"}


def test_long_words_and_hashes():
    from packlens.llm import wordbytes as wb

    words = wb.words(pa.array(["Ab cd", None, "", "ab", "x" * 70000 + " ab"]), wb.ALNUM, True)
    assert words.counts.tolist() == [2, 0, 0, 1, 2]
    assert words.hashes[0] == words.hashes[2] == words.hashes[4] != words.hashes[1]
    memo = wb.Memo(1, np.int64, 4)
    for keys in ([1, 2, 3], [2, 5], [7, 8, 9], [1, 9]):
        assert memo.get(np.array(keys, np.uint64), lambda at, k=keys: np.array([[k[x] * 10] for x in at])).ravel().tolist() == [k * 10 for k in keys]


def test_components(spark):
    from packlens.llm.graphs import Sieve, components

    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 200), (5, 5)]
    got = {r["node"]: r["class"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)} | {200: 200, 201: 200}
    sieve = Sieve(spark.createDataFrame([(x,) for x in (1, -7, 1 << 50)], "v long"), "v")
    assert sieve.passes(np.array([1, -7, 1 << 50, 2], np.int64)).tolist() == [True, True, True, False]


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
