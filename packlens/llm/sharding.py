"""Shards of near-equal bytes by sampled splitters.

1. Keys of rows (hash of the text, then hash of the id) are drawn with a chance in proportion to their size, so the
   sample's quantiles are byte quantiles. Its expected size is fixed.
2. Quantile boundaries cut the key space into many ranges. Equal texts are neighbours in it, so a boundary is moved to the
   front of its text unless the text alone fills more than a range: such an overfull range is subdivided by id.
3. Ranges go to shards, largest first, each to the shard with the fewest bytes. The ranges of one text stay together
   where they fit into one shard.

The boundaries and range totals are a few thousand numbers whatever the input. Slots count rows within ranges and
continue over the ranges of a shard, so numbering takes no task more than one range.

Defined cases: a null text has size 1 and the checksum of no bytes, and null texts count as equal; an empty table gives no rows. Rows
equal in id and text are kept, next to each other. Kept columns come in one struct, so no name clashes. One text
longer than a shard's share makes that shard larger; rows are never cut.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 16
RANGES_PER_SHARD = 64
SAMPLES_PER_RANGE = 32
_LEAST = np.iinfo(np.int64).min


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def choose_splitters(h: np.ndarray, k: np.ndarray, weight: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Composite boundaries (h, k), sorted: a row lies behind all boundaries that are not above its key."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((k, h))
    h, k, sums = h[order], k[order], np.cumsum(weight[order])
    at = np.unique(np.searchsorted(sums, sums[-1] * np.arange(1, ranges) / ranges, "right").clip(0, len(h) - 1))
    heads, times = np.unique(h[at], return_counts=True)
    cuts = {(int(x), _LEAST) for x in heads}
    for x in heads[times > 1]:  # one text over several ranges: bounds on both sides, and between its ids
        cuts |= {(int(x), int(y)) for y in k[at][h[at] == x]}
        if x < np.iinfo(np.int64).max:
            cuts.add((int(x) + 1, _LEAST))
    cuts = sorted(cuts)
    return np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts], np.int64)


def range_of(h: np.ndarray, k: np.ndarray, cut_h: np.ndarray, cut_k: np.ndarray) -> np.ndarray:
    low, out = np.searchsorted(cut_h, h, "left"), np.searchsorted(cut_h, h, "right")
    for x in np.unique(low[out - low > 1]):
        mine = (low == x) & (out - low > 1)
        upto = int(out[mine][0])
        out[mine] = x + np.searchsorted(cut_k[x:upto], k[mine], "right")
    return out


def assign(sizes: np.ndarray, rows: np.ndarray, cut_h: np.ndarray, cut_k: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and first slot of every range."""
    units: list[list[int]] = []
    for r in range(len(sizes)):
        inner = r > 1 and cut_k[r - 1] != _LEAST and units  # goes on with the text of the range before
        if inner and cut_h[r - 1] == cut_h[r - 2]:
            units[-1].append(r)
        else:
            units.append([r])
    share = sizes.sum() / shards
    units = [v for u in units for v in ([u] if sizes[u].sum() <= share else [[r] for r in u])]
    shard = np.zeros(len(sizes), np.int64)
    heap = [(0, s) for s in range(shards)]
    for unit in sorted(units, key=lambda u: (-sizes[u].sum(), u[0])):
        load, s = heapq.heappop(heap)
        shard[unit] = s
        heapq.heappush(heap, (load + int(sizes[unit].sum()), s))
    first = np.zeros(len(sizes), np.int64)
    used = np.zeros(shards, np.int64)
    for r in range(len(sizes)):
        first[r] = used[shard[r]]
        used[shard[r]] += rows[r]
    return shard, first


def shard(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", keep: list[Column | str] | None = None, seed: int = 7) -> DataFrame:
    """Columns: row (struct of ``keep``, by default all columns), size, shard, slot."""
    ranges = shards * RANGES_PER_SHARD
    keyed = docs.select(
        F.struct(*(keep or ["*"])).alias("row"), size_of(F.col(text)).alias("size"),
        F.xxhash64(F.col(text)).alias("h"), F.xxhash64(F.col(doc_id)).alias("k"),
    )
    total = keyed.agg(F.sum("size")).first()[0] or 0
    most = ranges * SAMPLES_PER_RANGE
    drawn = keyed.select("h", "k", "size").where(F.rand(seed) * total < F.col("size") * most).toPandas()
    weight = np.maximum(drawn["size"].to_numpy(np.float64), total / most)
    cut_h, cut_k = choose_splitters(drawn["h"].to_numpy(np.int64), drawn["k"].to_numpy(np.int64), weight, ranges)

    @F.pandas_udf("int")
    def located(h: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series(range_of(h.to_numpy(np.int64), k.to_numpy(np.int64), cut_h, cut_k).astype(np.int32))

    found = keyed.withColumn("range", located("h", "k"))
    sizes, rows = np.zeros(len(cut_h) + 1, np.int64), np.zeros(len(cut_h) + 1, np.int64)
    for r in found.groupBy("range").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect():
        sizes[r["range"]], rows[r["range"]] = r["size"], r["rows"]
    where, first = assign(sizes, rows, cut_h, cut_k, shards)

    placed = docs.sparkSession.createDataFrame(pd.DataFrame({"range": np.arange(len(where), dtype=np.int32), "shard": where.astype(np.int32), "first": first}))
    numbered = found.withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy("h", "k")))
    # One row per range, whose number is fixed above: small enough to broadcast whatever the input.
    return numbered.join(F.broadcast(placed), "range").select("row", "size", "shard", (F.col("first") + F.col("place") - 1).alias("slot"))
