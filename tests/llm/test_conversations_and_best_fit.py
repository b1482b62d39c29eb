"""Turn repair, the prefix trie and best-fit packing: brute force, round trips, and the defined odd cases."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
ROWS = [
    (1, 0, "user", "Hi there."), (1, 1, "assistant", "Hello."), (1, 1, "assistant", "Hello."), (1, 4, "user", "So"), (1, 5, None, None),
    (2, None, "system", "Rules."), (2, 0, "tool", "Out."), (2, 1, "user", "\t \n"), (2, -3, "user", "Why?"), (2, 2, "assistant", "As it is!"),
    (3, 0, "assistant", "First."), (3, 1, "user", "Second."), (None, 0, "user", "Whose?"), (None, 1, "", "Mine."), (4, 0, "user", ""),
    (5, 0, "user", "word " * 30000 + "."), (5, 1, "assistant", "ok."), (6, None, "user", "a."), (6, None, "assistant", "b."), (7, 3, "system", "Alone."),
]
CLASH = "c s n at block same key piece script edits line depth low bin place home role_ first last options"


@pytest.fixture(scope="module")
def messy(spark):
    extra = CLASH.split()
    return spark.createDataFrame([(*r, *["x"] * len(extra)) for r in ROWS], "conv_id long, turn long, role string, text string, " + ", ".join(f"{c} string" for c in extra))


def cheapest(turns):
    """The least (cost, audit) and its repaired lines, trying every edit script over the turns' own grammar check."""
    legal = re.compile(r"(s?(ua)+)?")
    seen, marked = set(), []
    for role, text in turns:
        solid = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        marked.append((role, text, fault))
    # Ways are told apart by all that was said so far, up to what the pattern can still tell: s, and whether a u is open.
    shape = lambda said: ("s" in said, said[-1:], len(said) > 1)
    ways = {shape(""): (0, "", "", [])}

    def offer(out, way):
        k = shape(way[2])
        if k not in out or way[:2] < out[k][:2]:
            out[k] = way

    def started(said):
        return bool(re.fullmatch(r"(s?(ua)*u?)?", said))

    def insertions(ways):
        out = dict(ways)
        for _ in range(3):
            for cost, audit, said, lines in list(out.values()):
                for role in ("user", "assistant"):
                    if started(said + role[0]):
                        offer(out, (cost + 5, audit + "I", said + role[0], [*lines, f"{role}:"]))
        return out

    for role, text, fault in marked:
        out = {}
        for cost, audit, said, lines in insertions(ways).values():
            offer(out, (cost + 2, audit + "D", said, lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 * (fault == "truncated")
            for letter, new, price in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                if new[:1] and started(said + new[0]):
                    offer(out, (cost + price + more, audit + letter, said + new[0], [*lines, f"{new}:{text}"]))
        ways = out
    return min(w for w in insertions(ways).values() if legal.fullmatch(w[2])), [m[2] for m in marked]


def repaired(spark, df):
    from packlens.llm.turn_repair import repair

    fixed = repair(df)
    lines = defaultdict(list)
    for r in fixed.turns.orderBy("at").collect():
        lines[r["conv_id"]] += r["lines"]
    return {r["conv_id"]: r for r in fixed.conversations.collect()}, lines, fixed


def ordered(rows):
    same = lambda r: hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()
    rows = [(r[0], r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in rows]
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, same(r))):
        by[r[0]].append(r)
    return by


def agree(spark, df, rows):
    got, lines, _ = repaired(spark, df)
    by = ordered(rows)
    assert set(got) == set(by)
    for conv, turns in by.items():
        (cost, audit, _, text), faults = cheapest([t[2:] for t in turns])
        initials = [t[2][:1] for t in turns]
        numbers = [t[1] for t in turns if t[1] is not None]
        r = got[conv]
        assert (r["cost"], r["audit"]) == (cost, audit) and lines[conv] == text
        assert [r[f] for f in ("blank", "duplicate", "truncated")] == [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        assert r["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        assert r["gaps"] == (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0)


def test_repair_odd_rows(spark, messy):
    agree(spark, messy, ROWS)
    got, lines, _ = repaired(spark, messy.limit(0))
    assert not got and not lines


def test_repair_random_and_blocks(spark, monkeypatch):
    from packlens.llm import sequences

    rng = np.random.default_rng(3)
    roles, texts = ["system", "user", "assistant", "assistant", "user", "tool", ""], ["Yes.", "No!", "cut", "", "Why?", *[f"{k}." for k in range(400)]]
    rows = [(int(c), int(t), str(rng.choice(roles)), str(rng.choice(texts))) for c in range(60) for t in range(int(rng.integers(1, 9)))]
    rows += [(99, t // 2, str(rng.choice(roles)), str(rng.choice(texts))) for t in range(150)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    agree(spark, df, rows)
    monkeypatch.setattr(sequences, "BLOCK_BITS", 2)  # one conversation over many blocks
    agree(spark, df, rows)


def test_damage(spark, messy):
    from packlens.llm.turn_repair import damage

    want = []
    for c, t, role, text in ROWS:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            want += [(c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * (1 + (kind == 3))
    assert sorted(map(repr, map(tuple, damage(messy).collect()))) == sorted(map(repr, want))


def brute_trie(seqs):
    nodes = defaultdict(list)
    for conv, turns in seqs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(conv)
    kids = defaultdict(int)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    own = {p: (int(not kids[p]), (len(m) - 1) * (len(p[-1][1]) if p else 0)) for p, m in nodes.items()}
    sums = defaultdict(lambda: [0, 0])
    for p, (leaf, saved) in own.items():
        for d in range(len(p) + 1):
            sums[p[:d]][0] += leaf
            sums[p[:d]][1] += saved
    out = []
    for p, m in nodes.items():
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(p))
        out.append((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], *sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def tries(spark, df, rows, shared):
    from packlens.llm import prefix_trie as pt
    from packlens.session import settle

    items = settle(pt.turn_items(df), "items")
    turns = pt.share_heads(items) if shared else items
    got = pt.trie(turns, items.select("conv_id").distinct()).drop("key").collect()
    rows = [(r[0], r[1], r[2] or "", r[3] or "") for r in rows if r[0] is not None]
    item = lambda r: hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()
    seqs = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, item(r))):
        seqs[r[0]].append(r[2:])
    if shared:
        own = dict(seqs)
        for c in own:
            h = zlib.crc32(str(c).encode()) % 6
            seqs[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    assert sorted(map(tuple, got), key=repr) == brute_trie(seqs)


def test_trie(spark, messy):
    tries(spark, messy, ROWS, True)
    tries(spark, messy, ROWS, False)
    assert tries(spark, messy.limit(0), [], True) is None
    real = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    tries(spark, spark.read.parquet(f"{SF}/conversations.parquet"), real, True)


def test_trie_deeper_than_bands(spark, monkeypatch):
    from packlens.llm import prefix_trie as pt

    monkeypatch.setattr(pt, "BAND", 3)
    rng = np.random.default_rng(8)
    rows = []
    for c in range(30):
        stem = int(rng.integers(0, 45))
        rows += [(c, t, "user", f"t{t}" if t < stem else f"own{int(rng.integers(3))}") for t in range(int(rng.integers(1, 50)))]
    rows += [(c + 200, t, "user", f"t{t}") for c in range(5) for t in range(46)]
    tries(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4), rows, False)
    tries(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4), rows, True)


def test_best_fit_rule():
    from packlens.llm.best_fit import best_fit

    rng = np.random.default_rng(1)
    for n in (0, 1, 50, 3000):
        sizes = rng.integers(1, 101, n)
        where, place, loads = best_fit(sizes, 100)
        assert (np.bincount(where, sizes, len(loads)) == loads).all() and loads.max(initial=0) <= 100
        for b in range(len(loads)):  # places follow on without a gap
            mine = np.flatnonzero(where == b)
            mine = mine[np.argsort(place[mine])]
            assert (place[mine] == np.cumsum(sizes[mine]) - sizes[mine]).all()
        rooms, bins = [], 0  # the rule itself, slowly
        for s in sorted(sizes.tolist(), reverse=True):
            fits = [r for r in rooms if r >= s]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - s)
            else:
                bins += 1
                rooms.append(100 - s)
        assert bins == len(loads)


def test_best_fit_packing(spark):
    from packlens.llm import best_fit as bf
    from tokenizers import Tokenizer

    rows = [(k, t) for k, t in enumerate(["a b c", None, "", " \n ", "word " * 9000, "É à 日本語 ñ <|endoftext|> x's 12", "same", "same", "x" * 700, "don't STOP now"])]
    rows += [(100 + k, "one two three four five " * (k % 37 + 1)) for k in range(300)] + [(None, "a"), (100, "repeated")]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "doc_id long, text string, bin string, load string").repartition(5)
    for window, meet in ((4096, 1 << 18), (64, 40)):
        got = bf.pack(df, window=window, meet=meet).collect()
        names = Tokenizer.from_file(bf.vocabulary())
        ids = defaultdict(list)
        for k, t in rows:
            ids[k].append(names.encode(t or "", add_special_tokens=False).ids + [1])
        pieces = defaultdict(list)
        for k, texts in ids.items():
            for own in texts:
                for n, at in enumerate(range(0, len(own), window)):
                    pieces[k].append((n, at, len(own[at : at + window]), zlib.crc32(np.array(own[at : at + window], "<u4").tobytes())))
        found, bins = defaultdict(list), defaultdict(list)
        for r in got:
            found[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in pieces.items()}
        for placed in bins.values():
            end = 0
            for offset, length in sorted(placed):
                assert offset == end
                end += length
            assert end <= window
        total = sum(length for placed in bins.values() for _, length in placed)
        assert len(bins) <= (1.0 if window == 4096 else 1.2) * -(-total // window) + 1
    assert bf.pack(df.limit(0)).count() == 0


def test_digests_in_chunks(spark, monkeypatch):
    from packlens.llm import sequences

    monkeypatch.setattr(sequences, "CHUNK", 20)
    rows = [(k % 3, k, "x" * (k % 40)) for k in range(200)]
    got = sequences.digests(spark.createDataFrame(rows, "k long, o long, p string").repartition(7), "k", "o", "p", ";", "sha")
    assert {r["k"]: r["sha"] for r in got.collect()} == {k: hashlib.sha256(";".join(r[2] for r in rows if r[0] == k).encode()).hexdigest() for k in range(3)}
