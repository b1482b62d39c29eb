"""Conversation structure repair by generalised LR parsing with weighted edits.

A legal conversation reads, by the initials of its roles, ``(s?(ua)+)?``:

    Conversation -> nothing | Dialog        Opening -> nothing | s
    Dialog -> Opening u a | Dialog u a

The LR automaton of this grammar runs over a conversation's turns. Every turn may be kept, given another role or deleted, and turns
may be inserted before it; each choice is one way on, and all ways go on side by side in a graph-structured stack. Stack nodes are
shared: a node is its LR state and the node below it. Ways that end in equal stack tops are merged, the one with the least (cost, audit)
stays. Under this grammar a top fixes what lies below it, so no merged way could have gone on otherwise.

A conversation of any length is cut into blocks of at most 1024 turns. A block is parsed from every top it may be entered with; the
small tables of costs are then chained along the conversation, and the chosen edits go back to their turns by a join. Merging is exact
across blocks too: of two ways of equal cost through the same turns, neither audit is the start of the other.

Defined cases: turns stand by turn number (nulls first); turns of one number by a digest of role and text. A null role or text is one space.
A role of another initial, or an empty one, can be given a role or deleted but not kept. A null conversation id is a conversation of
its own. An empty or very long text is a text like others; repeated rows are duplicates. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlens.llm.sequences import batches_of, block, in_order, tuples
from packlens.session import settle

FAULTS = ("blank", "duplicate", "truncated")
LEGAL = ("su", "ua", "au")
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
NAMES = {"s": "system", "u": "user", "a": "assistant"}
GIVEN = "ua"  # roles that an edit can give
_BLANKS = " \t\n\x0b\x0c\r"

# LR states: 0 start, 1 Opening, 2 Opening u, 3 Opening u a, 4 Dialog, 5 Dialog u, 6 Dialog u a, 7 s
_SHIFT = {(0, "s"): 7, (1, "u"): 2, (2, "a"): 3, (4, "u"): 5, (5, "a"): 6}
_REDUCE = {3: (3, "Dialog"), 6: (3, "Dialog"), 7: (1, "Opening")}
_REDUCE_AHEAD = {(0, "u"): (0, "Opening")}
_GOTO = {(0, "Opening"): 1, (0, "Dialog"): 4}
_ACCEPT = {0, 4}


class Node:
    """A stack top: its LR state and the node it stands on. Equal tops are one object."""

    __slots__ = ("state", "below", "above", "steps")

    def __init__(self, state: int, below: Node | None) -> None:
        self.state, self.below = state, below
        self.above: dict[int, Node] = {}
        self.steps: dict[str, Node | None] = {}

    def push(self, state: int) -> Node:
        if state not in self.above:
            self.above[state] = Node(state, self)
        return self.above[state]

    def reduce(self, rule: tuple[int, str]) -> Node:
        size, made = rule
        top = self
        for _ in range(size):
            top = top.below
        return top.push(_GOTO[top.state, made])

    def step(self, symbol: str) -> Node | None:
        """The top after one more symbol, or None where the grammar ends."""
        if symbol not in self.steps:
            top = self
            while (rule := _REDUCE_AHEAD.get((top.state, symbol))) is not None:
                top = top.reduce(rule)
            state = _SHIFT.get((top.state, symbol))
            new = None
            if state is not None:
                new = top.push(state)
                while new.state in _REDUCE:
                    new = new.reduce(_REDUCE[new.state])
            self.steps[symbol] = new
        return self.steps[symbol]


@cache
def tops() -> dict[int, Node]:
    """Every top that can stand between two turns, by its state."""
    start = Node(0, None)
    found, new = {}, [start]
    for node in new:
        found[node.state] = node
        new += [n for s in NAMES if (n := node.step(s)) and n.state not in found and n not in new]
    return found


Ways = dict[Node, tuple[int, str]]


def _offer(ways: Ways, top: Node, cost: int, script: str) -> bool:
    old = ways.get(top)
    if old is None or (cost, script) < old:
        ways[top] = (cost, script)
        return True
    return False


def inserted(ways: Ways) -> Ways:
    """The ways, and those with turns inserted behind them."""
    out, open_ = dict(ways), list(ways)
    for top in open_:
        cost, script = out[top]
        for symbol in GIVEN:
            new = top.step(symbol)
            if new and _offer(out, new, cost + INSERT, f"{script}I{symbol}"):
                open_.append(new)
    return out


def advance(ways: Ways, symbol: str, fault: str | None) -> Ways:
    """All ways past one more turn. Scripts name the role after R and I; they sort as audits do."""
    out: Ways = {}
    extra = TRUNCATED if fault == "truncated" else 0
    for top, (cost, script) in inserted(ways).items():
        _offer(out, top, cost + DELETE, script + "D")
        if fault in ("blank", "duplicate"):
            continue
        if symbol and (new := top.step(symbol)):
            _offer(out, new, cost + extra, script + "K")
        for given in GIVEN:
            if new := top.step(given):
                _offer(out, new, cost + REROLE + extra, f"{script}R{given}")
    return out


def damage(conversations: DataFrame) -> DataFrame:
    """A copy with planted faults, dealt by crc32 of ``conv_id:turn``: rows dropped, emptied, cut short, repeated or of the wrong role."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _faults(turns: DataFrame) -> DataFrame:
    """Turns in order with their first fault and role initial."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    slim = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"))
    slim = slim.withColumn("same", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    ordered = in_order(slim, F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("same"))
    firsts = ordered.groupBy(F.col("conv_id").alias("c"), F.col("same").alias("s")).agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("n")).where("n > 1")
    marked = ordered.join(firsts, ordered["conv_id"].eqNullSafe(firsts["c"]) & (F.col("same") == F.col("s")), "left")
    solid = F.rtrim(F.col("text"), F.lit(_BLANKS))
    fault = (
        F.when(solid == "", "blank")
        .when(F.col("at") > F.col("first_at"), "duplicate")
        .when(~F.substring(solid, -1, 1).isin(".", "!", "?"), "truncated")
    )
    return marked.select("conv_id", "turn", "role", "text", "at", block().alias("block"), F.substring("role", 1, 1).alias("symbol"), fault.alias("fault"))


def _tables(turns: DataFrame) -> DataFrame:
    """One row per block: its counts, and the cheapest edits from each top it may be entered with to each it may end with."""
    kind, when = (turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    opening = turns.groupBy(F.col("conv_id").alias("c")).agg(F.min("block").alias("opening"))
    slim = turns.select("conv_id", "block", "at", "turn", "symbol", "fault")
    slim = slim.join(opening, slim["conv_id"].eqNullSafe(opening["c"])).withColumn("opens", F.col("block") == F.col("opening")).drop("c", "opening")
    names = ["conv_id", "block", "low_at", "low", "high", "numbers", *FAULTS, "illegal", "first", "last", "options"]

    def parsed(batches: Iterator[pa.RecordBatch], kinds: list) -> Iterator[tuple]:
        for (conv, number), rows in groupby(tuples(batches, kinds), itemgetter(0, 1)):
            counts = dict.fromkeys(FAULTS, 0)
            illegal = numbers = 0
            low = high = first = last = low_at = None
            ways: dict[int, Ways] = {}
            for _, _, at, turn, symbol, fault, opens in rows:
                if first is None:
                    first, low_at = symbol, at
                    ways = {s: {top: (0, "")} for s, top in tops().items() if s == 0 or not opens}
                else:
                    illegal += last + symbol not in LEGAL
                last = symbol
                if fault:
                    counts[fault] += 1
                if turn is not None and turn != high:
                    numbers += 1
                    low, high = turn if low is None else low, turn
                ways = {s: advance(w, symbol, fault) for s, w in ways.items()}
            options = [
                {"entry": s, "leave": top.state, "cost": cost, "script": script}
                for s, w in sorted(ways.items()) for top, (cost, script) in sorted(w.items(), key=lambda x: x[1][1])
            ]
            yield conv, number, low_at, low, high, numbers, *counts.values(), illegal, first, last, options

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list = []
        option = pa.list_(pa.struct([("entry", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("script", pa.string())]))
        types = lambda: [kinds[0], pa.int64(), pa.int64(), kinds[3], kinds[3], *[pa.int64()] * 5, pa.string(), pa.string(), option]
        yield from batches_of(parsed(batches, kinds), names, types, size=200)

    near = slim.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "at")
    schema = (f"conv_id {kind}, block bigint, low_at bigint, low {when}, high {when}, numbers bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
              "first string, last string, options array<struct<entry:int, leave:int, cost:bigint, script:string>>")
    return settle(near.mapInArrow(run, schema), "repair")


def _chain(tables: DataFrame) -> DataFrame:
    """For every block the top it is entered with and ends with on its conversation's cheapest way; the last one also has what is inserted at the end."""
    kind = tables.schema["conv_id"].dataType.simpleString()
    steps = F.transform("options", lambda o: F.struct(o["entry"].alias("entry"), o["leave"].alias("leave"), o["cost"].alias("cost")))
    slim = tables.select("conv_id", "block", "first", "last", "low", "high", steps.alias("steps"))

    def chained(batches: Iterator[pa.RecordBatch], kinds: list) -> Iterator[tuple]:
        for conv, blocks in groupby(tuples(batches, kinds), itemgetter(0)):
            best = {0: (0, 0)}  # state: cost, rank of the audit so far
            back, last, high = [], None, None
            for _, number, first, own_last, low, own_high, steps in blocks:
                ways: dict[int, tuple] = {}
                for order, step in enumerate(steps):
                    entry, leave, cost = step.values()
                    if entry in best:
                        way = (best[entry][0] + cost, best[entry][1], order, entry)
                        if leave not in ways or way < ways[leave]:
                            ways[leave] = way
                ranked = sorted(ways, key=lambda s: ways[s][1:3])
                best = {s: (ways[s][0], rank) for rank, s in enumerate(ranked)}
                clash = last is not None and last + first not in LEGAL
                back.append((number, {s: w[3] for s, w in ways.items()}, int(clash), int(low is not None and low == high)))
                last, high = own_last, high if own_high is None else own_high
            ends = [
                (cost + more, rank, tail, state) for state, (cost, rank) in best.items()
                for top, (more, tail) in inserted({tops()[state]: (0, "")}).items() if top.state in _ACCEPT
            ]
            _, _, tail, state = min(ends)
            for number, entries, clash, overlap in reversed(back):
                yield conv, number, entries[state], state, clash, overlap, tail
                state, tail = entries[state], ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list = []
        names = ["conv_id", "block", "entry", "leave", "clash", "overlap", "tail"]
        yield from batches_of(chained(batches, kinds), names, lambda: [kinds[0], pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()])

    near = slim.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return near.mapInArrow(run, f"conv_id {kind}, block bigint, entry int, leave int, clash bigint, overlap bigint, tail string")


class Repaired(NamedTuple):
    """conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. turns: conv_id, at (their order), turn, role, text, edits and
    lines (the repaired ``role:text`` in the turn's place, none where it was deleted)."""

    conversations: DataFrame
    turns: DataFrame


def repair(turns: DataFrame) -> Repaired:
    """The cheapest edits that make every conversation legal. Columns read: conv_id, turn, role, text."""
    faulty = _faults(turns)
    tables = _tables(faulty)
    picked = _chain(tables).select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "entry", "leave", "tail", "clash", "overlap")
    way = F.filter("options", lambda o: (o["entry"] == F.col("entry")) & (o["leave"] == F.col("leave")))[0]
    blocks = settle(
        tables.join(picked, tables["conv_id"].eqNullSafe(picked["c"]) & (F.col("block") == F.col("b"))).withColumn("script", F.concat(way["script"], "tail"))
        .withColumn("cost", way["cost"] + F.length("tail") * F.lit(INSERT) / 2).drop("c", "b", "options"),
        "repaired",
    )
    audits = F.transform(F.array_sort(F.collect_list(F.struct("block", F.regexp_replace("script", "[a-z]", "").alias("audit")))), lambda x: x["audit"])
    total = lambda c: F.sum(c).cast("bigint")
    gaps = F.max("high") - F.min("low") + 1 - (F.sum("numbers") - F.sum("overlap"))
    conversations = blocks.groupBy("conv_id").agg(
        F.coalesce(gaps, F.lit(0)).cast("bigint").alias("gaps"), *[total(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        (total("illegal") + total("clash")).alias("illegal"), total("cost").alias("cost"), F.array_join(audits, "").alias("audit"),
    )
    tokens = F.regexp_extract_all("script", F.lit("((?:I[ua])*(?:K|D|R[ua])(?:(?:I[ua])+$)?)"), F.lit(1))
    edits = blocks.select("low_at", F.posexplode(tokens).alias("nth", "edits"))
    done = faulty.join(edits.select((F.col("low_at") + F.col("nth")).alias("at"), "edits"), "at")
    return Repaired(conversations, done.select("conv_id", "at", "turn", "role", "text", "edits", _lines().alias("lines")))


def _lines() -> Column:
    """``role:text`` of what a turn's edits leave: inserted turns before and after, and itself unless deleted."""
    name = lambda c: F.when(c == "u", NAMES["u"]).otherwise(NAMES["a"])
    each = F.regexp_extract_all("edits", F.lit("([IR][ua]|K|D)"), F.lit(1))
    line = lambda e: (
        F.when(e == "K", F.concat("role", F.lit(":"), "text"))
        .when(e.startswith("R"), F.concat(name(F.substring(e, 2, 1)), F.lit(":"), "text"))
        .when(e.startswith("I"), F.concat(name(F.substring(e, 2, 1)), F.lit(":")))
    )
    return F.filter(F.transform(each, line), lambda x: x.isNotNull())
