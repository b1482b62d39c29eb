"""A trie of conversation prefixes, rolled up in bands of depths.

Every distinct sequence of first turns is a node, named by a digest of that sequence. Conversations are cut into bands of ``BAND`` turns; digests are
taken inside a band and then chained by the same step over whole bands, so a conversation of any length takes rounds in the logarithm of its length.

Totals over subtrees: each node goes to its ancestors inside its own band only. Roots of bands form a trie themselves, with the totals of their
bands as weights; once its totals are complete (by the same step), each root's total goes to the ancestors in the band above. So no node is
copied more than ``BAND`` times, and the rounds grow with the logarithm of the depth. Every step is a join or a sum on node digests; sums have a map-side
step, so a first turn that a third of all conversations share is one row per task before it is shuffled.

Defined cases: turns stand by turn number (nulls first), turns of one number by a digest of role and text; a null role or text is empty; rows without
a conversation id name no conversation and are left out. Empty and very long texts are texts like others, repeated rows are turns of
their own, equal conversations share all nodes. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlens.llm.sequences import EMPTY_SHA256, digests, in_order, positions
from packlens.session import settle

BAND = 32
#: Conversations share the head of the first one of their hundred, in the query's rebuilt table.
FAMILY, HEADS = 100, 6


def turn_items(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), item (digest of role and text), chars (code points of the text)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    slim = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.md5(F.concat(F.length(text("role")).cast("string"), F.lit(":"), text("role"), text("text"))).alias("item"),
        F.length(text("text")).cast("bigint").alias("chars"),
    )
    return positions(in_order(slim, F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("item")), "conv_id").select("conv_id", "pos", "item", "chars")


def share_heads(turns: DataFrame) -> DataFrame:
    """Each conversation with its first turns taken from the first conversation of its family: a corpus of branching conversations."""
    heads = lambda c: (F.crc32(c.cast("string").cast("binary")) % HEADS).cast("bigint")
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    lent = sizes.select("conv_id", base.alias("base"), heads(F.col("conv_id")).alias("h"))
    given = turns.where(F.col("pos") < HEADS - 1).withColumnRenamed("conv_id", "base")
    first = lent.join(given, "base").where("pos < h").select("conv_id", "pos", "item", "chars")
    # Where the family's first conversation is shorter than the head, or missing, later turns move up.
    own = turns.where(F.col("pos") >= heads(F.col("conv_id")))
    short = lent.join(sizes.select(F.col("conv_id").alias("base"), "n"), "base", "left").select(
        "conv_id", (F.col("h") - F.coalesce("n", F.lit(0))).alias("gap")).where("gap > 0")
    rest = own.join(short, "conv_id", "left").select("conv_id", (F.col("pos") - F.coalesce("gap", F.lit(0))).alias("pos"), "item", "chars")
    return first.unionByName(rest)


def _banded(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per conversation and band: its rows (i, columns) in order."""
    return rows.groupBy("conv_id", F.expr(f"i div {BAND}").alias("band")).agg(F.array_sort(F.collect_list(F.struct("i", *columns))).alias("rows"))


def _paths(rows: DataFrame) -> DataFrame:
    """From conv_id, i, item: conv_id, band, keys (the digest of all items up to each of the band)."""
    items = F.transform("rows", lambda r: r["item"])
    inner = F.transform(F.sequence(F.lit(1), F.size("rows")), lambda n: F.md5(F.array_join(F.slice(items, F.lit(1), n), "")))
    bands = _banded(rows, "item").select("conv_id", "band", inner.alias("inner"))
    if bands.where("band > 0").isEmpty():
        return bands.withColumnRenamed("inner", "keys")
    bands = settle(bands, "bands")
    wholes = _paths(bands.select("conv_id", F.col("band").alias("i"), F.element_at("inner", -1).alias("item")))
    ends = wholes.select("conv_id", F.posexplode("keys").alias("nth", "before"), F.col("band").alias("upper"))
    ends = ends.select("conv_id", (F.col("upper") * BAND + F.col("nth") + 1).alias("band"), "before")
    keys = F.when(F.col("before").isNull(), F.col("inner")).otherwise(F.transform("inner", lambda k: F.md5(F.concat("before", k))))
    return bands.join(ends, ["conv_id", "band"], "left").select("conv_id", "band", keys.alias("keys"))


def rollup(nodes: DataFrame, bands: DataFrame, *measures: str) -> DataFrame:
    """Sums of the measures over every node's subtree, itself included.

    ``nodes``: key, conv_id (any member), depth, measures. ``bands``: conv_id, band, keys on the path of each such member.
    """
    sums = [F.sum(m).alias(m) for m in measures]
    band, nth = F.expr(f"depth div {BAND}"), (F.col("depth") % BAND + 1).cast("int")
    up = nodes.withColumn("band", band).join(bands, ["conv_id", "band"]).select(F.explode(F.slice("keys", F.lit(1), nth)).alias("key"), *measures)
    inside = up.groupBy("key").agg(*sums)
    if nodes.where(F.col("depth") >= BAND).isEmpty():
        return inside
    inside = settle(inside, "inside")
    roots = settle(nodes.where(F.col("depth") % BAND == 0).select("key", "conv_id", band.alias("depth")), "roots")
    upper = _banded(bands.select("conv_id", F.col("band").alias("i"), F.element_at("keys", 1).alias("key")), "key")
    upper = settle(upper.select("conv_id", "band", F.transform("rows", lambda r: r["key"]).alias("keys")), "upper")
    done = rollup(roots.join(inside, "key"), upper, *measures)
    lifts = roots.where("depth > 0").join(done, "key").withColumn("band", F.col("depth") - 1).join(bands, ["conv_id", "band"])
    return inside.unionByName(lifts.select(F.explode("keys").alias("key"), *measures)).groupBy("key").agg(*sums)


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node: key, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: conv_id, pos (from 0 without gaps), item, chars; ``conversations``: conv_id of every conversation, those without turns included.
    """
    tops = conversations.select("conv_id", F.lit(0).cast("bigint").alias("i"), F.lit("").alias("item"), F.lit(0).cast("bigint").alias("chars"))
    rows = settle(tops.unionByName(turns.select("conv_id", (F.col("pos") + 1).alias("i"), "item", "chars")), "turns")
    bands = settle(_paths(rows), "paths")
    keyed = bands.select("conv_id", "band", F.posexplode("keys").alias("nth", "key")).select("conv_id", (F.col("band") * BAND + F.col("nth")).alias("i"), "key")
    placed = keyed.join(rows.select("conv_id", "i", "chars"), ["conv_id", "i"])
    nodes = settle(placed.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.min("i").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars")), "nodes")

    before = keyed.select("conv_id", (F.col("i") + 1).alias("depth"), F.col("key").alias("parent"))
    linked = settle(nodes.join(before, ["conv_id", "depth"], "left"), "linked")
    children = linked.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    whole = settle(linked.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")

    weights = whole.select("key", "conv_id", "depth", (F.col("n_children") == 0).cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    totals = rollup(weights, bands, "n_leaves", "saved_tokens")
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    last = keyed.groupBy("conv_id").agg(F.max_by("key", "i").alias("key")).withColumn("piece", F.col("conv_id").cast("string"))
    ends = digests(last, "key", "conv_id", "piece", ",", "ends_sha256")
    return (
        whole.join(totals, "key").join(parents, "parent", "left").join(ends, "key", "left")
        .select("key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
    )
