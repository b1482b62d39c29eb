"""Sequences filled by best fit, with underfull ones merged along a tree.

Every document becomes its token ids and an end id. Documents longer than a sequence are cut; whole pieces are sequences of their own.
All else is an item. Where texts are read, items are placed by decreasing size, each in the bin it leaves least room in. Bins that are nearly full
are done; underfull bins are items themselves in the next round, where bins of several tasks meet. Rounds go on, several tasks merging into
one, until everything met in one task or a round joined nothing: then no two bins of any task fit together.

A task holds sizes, not texts, of at most ``GROUP`` items in the first round, and the number of tasks of a later round follows the
number of bins that are left. A round's result is written, so a rerun of a lost task cannot place a piece anew.

Defined cases: a null text is an empty one and packs as its end id alone; a very long text is cut into many pieces; equal and
repeated rows are packed like any other; a null id is carried like any other; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlens.llm import wordbytes as wb
from packlens.llm.packing import Encoder
from packlens.llm.token_counts import vocabulary
from packlens.session import settle

WINDOW = 4096
GROUP = 1 << 16
#: Room up to which a bin counts as nearly full.
SLACK = 4
#: Bins that one task of a later round is meant for.
MEET = 1 << 18
TASK_BITS, ROUND_BITS = 36, 4


class WordEncoder(Encoder):
    """Ids under a vocabulary that drops white space: every run between ASCII white space is encoded on its own."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        super().__init__(path, None)

    @staticmethod
    def _bounds(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(data)
        cut = np.zeros(n, bool)
        solid = wb.SOLID[data]
        cut[1:] = solid[1:] & ~solid[:-1]
        edges = offsets[:-1]
        cut[edges[edges < n]] = True
        return np.flatnonzero(cut)


@cache
def encoder(path: str) -> WordEncoder:
    """One per worker process, so that tasks find words encoded before."""
    return WordEncoder(path)


def best_fit(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin of each item, the place of each item in its bin, and the load of each bin. Largest items first, each where it leaves least room."""
    where, place = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_: list[list[int]] = [[] for _ in range(window + 1)]  # by room
    rooms = 0  # bit r: some bin has room r
    loads: list[int] = []
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        if fits := rooms >> size:
            room = size + (fits & -fits).bit_length() - 1
            at = open_[room].pop()
            if not open_[room]:
                rooms ^= 1 << room
        else:
            at, room = len(loads), window
            loads.append(0)
        where[k], place[k] = at, loads[at]
        loads[at] += size
        room -= size
        if room:
            open_[room].append(at)
            rooms |= 1 << room
    return where, place, np.array(loads, np.int64)


def _local(docs: DataFrame, path: str, end: int, window: int) -> DataFrame:
    """One row per piece: its ids, its bin, its place there and the bin's load."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "place", "load"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << TASK_BITS
        held: list[tuple] = []
        id_type = None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            if not held:
                return
            sizes = np.array([row[3] for row in held], np.int64)
            where, place, loads = best_fit(sizes, window)
            columns = list(zip(*held))
            yield pa.RecordBatch.from_arrays([
                pa.array(columns[0], id_type), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[2:5]],
                pa.array(number + where), pa.array(place), pa.array(loads[where]),
            ], names=names)
            number += len(loads)
            held.clear()

        for batch in batches:
            id_type = batch.column("doc_id").type
            for part in wb.slices(batch):
                ids, bounds = encode(part.column("text"))
                for key, low, high in zip(part.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    own = np.append(ids[low:high], np.int32(end)).astype("<u4")
                    for piece, at in enumerate(range(0, len(own), window)):
                        cut = own[at : at + window]
                        held.append((key, piece, at, len(cut), zlib.crc32(cut.tobytes())))
                    if len(held) >= GROUP:
                        yield from flush()
        yield from flush()

    slim = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, bin bigint, place bigint, load bigint")


def _merge(bins: DataFrame, tasks: int, window: int) -> DataFrame:
    """One round: bins of neighbouring tasks meet and are best-fitted as items. Columns: bin, new, place, load (of the new bin)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        old, load = (np.concatenate([b.column(c).to_numpy() for b in batches]) for c in ("bin", "load"))
        order = np.argsort(old)
        old, load = old[order], load[order]
        where, place, loads = best_fit(load, window)
        number = TaskContext.get().partitionId() << TASK_BITS
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (old, number + where, place, loads[where])], names=["bin", "new", "place", "load"])

    # A bin's number has its task in the high bits.
    return bins.repartitionByRange(tasks, "bin").mapInArrow(run, "bin bigint, new bigint, place bigint, load bigint")


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end: int = 1, window: int = WINDOW, slack: int = SLACK,
         meet: int = MEET) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    pieces = settle(_local(slim, path or vocabulary(), end, window), "pieces")
    # home: the bin a first bin has gone into; base: its place there.
    homes = pieces.where(F.col("load") < window - slack).groupBy("bin").agg(F.max("load").alias("load"))
    homes = settle(homes.select("bin", F.col("bin").alias("home"), F.lit(0).alias("round"), F.lit(0).cast("bigint").alias("base"), "load"), "bins")
    for round_ in range(1, 1 << ROUND_BITS):
        live = homes.where((F.col("round") == round_ - 1) & (F.col("load") < window - slack))
        bins = live.groupBy(F.col("home").alias("bin")).agg(F.max("load").alias("load"))
        n = bins.count()
        tasks = -(-n // meet)
        if n < 2:
            break
        new = settle(_merge(bins, tasks, window), "round")
        left = new.select("new").distinct().count()
        if left == n:
            break
        moved = live.drop("load", "round").join(new.withColumnRenamed("bin", "home"), "home").select(
            "bin", F.col("new").alias("home"), F.lit(round_).alias("round"), (F.col("base") + F.col("place")).alias("base"), "load")
        rest = homes.where((F.col("round") < round_ - 1) | (F.col("load") >= window - slack))
        homes = settle(rest.unionByName(moved), "bins")
        if tasks == 1:
            break
    spots = homes.select("bin", "home", "round", "base")
    whole = pieces.join(spots, "bin", "left")
    number = F.coalesce("home", "bin") * (1 << ROUND_BITS) + F.coalesce("round", F.lit(0))
    return whole.select(
        F.col("doc_id").alias(doc_id), "piece", "start", "length", "ids_crc32", number.alias("sequence_id"),
        (F.col("place") + F.coalesce("base", F.lit(0))).alias("offset"),
    )
