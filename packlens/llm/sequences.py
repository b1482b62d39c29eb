"""Long sequences in pieces: a total order without one task per key, and digests of what a key's rows say in a row.

A key may hold a third of all rows. Rows are dealt out by range of (key, order), so a hot key covers many tasks; blocks of
neighbours never cross a task. Only a SHA-256 has to see its sequence from the first byte to the last: neighbours are joined
into chunks where they lie, and one task streams through a key's sorted chunks, holding one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from packlens.session import settle

#: Rows that share all but the lowest bits of their place form a block.
BLOCK_BITS = 10
CHUNK = 1 << 20
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def in_order(rows: DataFrame, *order: Column | str) -> DataFrame:
    """The rows, written once, with ``at``: growing in the given order; places of one task are neighbours."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return settle(dealt.withColumn("at", F.monotonically_increasing_id()), "ordered")


def block() -> Column:
    return F.shiftright("at", BLOCK_BITS)


def positions(ordered: DataFrame, key: str, name: str = "pos") -> DataFrame:
    """Adds each row's position in its key, from 0. ``ordered`` comes from ``in_order``, sorted by the key first."""
    cut = ordered.withColumn("block", block())
    before = W.partitionBy(key).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = cut.groupBy(key, "block").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))
    starts = blocks.select(key, "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("shift"))
    return cut.join(starts, [key, "block"]).withColumn(name, F.col("at") + F.col("shift")).drop("block", "shift")


def tuples(batches: Iterator[pa.RecordBatch], kept: list | None = None) -> Iterator[tuple]:
    """Rows one by one; ``kept`` gets the column types."""
    for batch in batches:
        if kept is not None and not kept:
            kept.extend(batch.schema.types)
        yield from zip(*(c.to_pylist() for c in batch.columns))


def batches_of(rows: Iterator[tuple], names: list[str], types: Callable[[], list[pa.DataType]], size: int = 2000, cells: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``size`` rows, or of the rows whose last column reaches ``cells`` characters. ``types`` is asked when the first row is there."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += len(row[-1]) if isinstance(row[-1], str) else 0
        if len(held) >= size or weight >= cells:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types())], names=names)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types())], names=names)


def digests(pieces: DataFrame, key: str, order: str, piece: str, separator: str, name: str) -> DataFrame:
    """One row per key: the SHA-256 (lowercase hex) of its pieces in order, with the separator between them."""
    types = {c: pieces.schema[c].dataType.simpleString() for c in (key, order)}
    slim = pieces.select(F.col(key).alias("key"), F.col(order).alias("at"), F.col(piece).alias("piece"))
    glue = separator.encode()

    def joined(batches: Iterator[pa.RecordBatch], kinds: list) -> Iterator[tuple]:
        for value, rows in groupby(tuples(batches, kinds), itemgetter(0)):
            first, texts, size = None, [], 0
            for _, at, text in rows:
                if texts and size + len(text) > CHUNK:
                    yield value, first, separator.join(texts)
                    texts, size = [], 0
                if not texts:
                    first = at
                texts.append(text)
                size += len(text)
            yield value, first, separator.join(texts)

    def hashed(batches: Iterator[pa.RecordBatch], kinds: list) -> Iterator[tuple]:
        for value, rows in groupby(tuples(batches, kinds), itemgetter(0)):
            state, more = hashlib.sha256(), False
            for _, _, text in rows:
                if more:
                    state.update(glue)
                state.update(text.encode())
                more = True
            yield value, state.hexdigest()

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list = []
        yield from batches_of(joined(batches, kinds), ["key", "at", "piece"], lambda: [kinds[0], kinds[1], pa.string()])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list = []
        yield from batches_of(hashed(batches, kinds), ["key", name], lambda: [kinds[0], pa.string()])

    near = slim.repartitionByRange("key", "at").sortWithinPartitions("key", "at").mapInArrow(chunks, f"key {types[key]}, at {types[order]}, piece string")
    whole = near.repartition("key").sortWithinPartitions("key", "at").mapInArrow(sums, f"key {types[key]}, {name} string")
    return whole.withColumnRenamed("key", key)
