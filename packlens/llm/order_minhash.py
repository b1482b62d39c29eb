"""Near-duplicate documents by Order MinHash and banded alignment.

A document is the sequence of its five-word shingles, each labelled with its occurrence number so that all differ. A
sketch draws the ``DRAWN`` shingles with the least hash values and keeps them in text order; two documents share a sketch when the
same shingles are drawn and stand in the same order, so sketches follow edit similarity. Documents that share one of
``SKETCHES`` sketches meet in a bucket.

A bucket makes no pairs of all its members. The member with the most bucket mates stands for it and each other member is aligned
with it: common labelled shingles in the same order, within the band that the similarity allows. A member that does not
reach the similarity could be near another member that the bucket's hub hides. So wherever a bucket has such a member and
another one, all its members are dealt once more, by a prefix filter: every text's labelled shingles in one order for
all texts, rarest first, cut to one more than a near text can lack. Two near texts always share one of those, so no pair is lost behind a hub. Texts
that share one meet if they are not in one class already, and if their lengths, the places of the shared shingle and the parities of all
their shingles leave room for the similarity. Rareness comes from counters of fixed size over all texts dealt; any order would find the same pairs.

Similarity is the share of order-keeping common shingles in all shingles, ``SIMILAR`` or more. Linked texts form classes.

Defined cases: equal texts are always in one class; a null text is in a class of its own; texts of one to four words have
one shingle, all their words; texts without words are only like equal texts. Words are lower-cased (A-Z), punctuation
and white space separate them. Texts are used whole. A class is named after its least document id (null if it has none). An
empty table gives no rows; other columns are passed on as they are, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlens.llm import wordbytes as wb
from packlens.llm.graphs import Sieve, components
from packlens.session import settle

SHINGLE = 5
DRAWN = 3
SKETCHES = 16
SIMILAR = 0.8
COUNTER_BITS = 20
PARITIES = 16  # words of 64 bits
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)
_SEEDS = wb.mix(np.arange(1, 2 * 64 + 1, dtype=np.uint64)).reshape(2, 64) | np.uint64(1)


def shingles(column: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Labelled shingles of all texts in a row, in text order, and the bounds of each text."""
    words = wb.words(column, wb.ALNUM, True)
    counts = words.counts
    size = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    out = np.empty(bounds[-1], np.uint64)
    full, first = wb.windows(words.hashes, words.bounds, width)
    rows = np.repeat(np.arange(len(counts)), size)
    out[counts[rows] >= width] = full
    for row in np.flatnonzero((counts > 0) & (counts < width)):
        low, high = words.bounds[row], words.bounds[row + 1]
        out[bounds[row]] = wb.windows(words.hashes[low:high], np.array([0, high - low]), int(high - low))[0][0]
    keyed = wb.mix(out + wb.mix(rows.astype(np.uint64)))
    order = np.argsort(keyed, kind="stable")
    run = np.ones(len(order), bool)
    run[1:] = keyed[order][1:] != keyed[order][:-1]
    head = np.maximum.accumulate(np.where(run, np.arange(len(order)), 0)) if len(order) else np.zeros(0, np.int64)
    label = np.empty(len(order), np.int64)
    label[order] = np.arange(len(order)) - head
    return wb.mix(out + label.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), bounds


def sketches(labelled: np.ndarray, bounds: np.ndarray, n: int = SKETCHES, drawn: int = DRAWN) -> np.ndarray:
    """Bucket keys: one row per text that has shingles, one column per sketch."""
    full = np.flatnonzero(np.diff(bounds))
    starts, size = bounds[:-1][full], np.diff(bounds)[full]
    out = np.zeros((len(full), n), np.uint64)
    if not len(full):
        return out
    for s in range(n):
        value = (labelled ^ _SEEDS[0, s]) * _SEEDS[1, s]
        place = np.full((len(full), drawn), len(labelled), np.int64)
        for d in range(drawn):
            least = np.minimum.reduceat(value, starts)
            hit = np.flatnonzero((value == np.repeat(least, size)) & (value != _MOST))
            owner = np.searchsorted(starts, hit, "right") - 1
            place[owner, d] = hit
            value[hit] = _MOST
        place.sort(1)
        padded = np.append(labelled, np.uint64(0))
        key = np.full(len(full), s + 1, np.uint64)
        for d in range(drawn):
            key = wb.mix(key + padded[place[:, d]])
        out[:, s] = key
    return out


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> float:
    """Share of the labelled shingles of both texts that an order-keeping alignment matches, within the band ``least`` allows."""
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    total = len(a) + len(b)
    if not total:
        return 1.0
    common = len(at_a)
    if common < least * (total - common):
        return common / (total - common)  # even without regard to order it is too little
    band = int((1 - least) / (1 + least) * total) + 1
    near = np.abs(at_a - at_b) <= band
    path = at_b[near][np.argsort(at_a[near])]
    if len(path) > 1 and not (path[1:] > path[:-1]).all():
        tails: list[int] = []
        for x in path.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        matched = len(tails)
    else:
        matched = len(path)
    return matched / (total - matched)


def prefix(text: np.ndarray, rank: np.ndarray, least: float) -> np.ndarray:
    """Positions of the shingles of which a text shares one with every text at least ``least`` like it: the first ones by (rank, shingle)."""
    lacks = len(text) - int(np.ceil(least * len(text) - 1e-9))
    return np.lexsort((text, rank))[: lacks + 1]


def _identified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("uid", F.unhex(F.md5("text")))


def _bucket_rows(slim: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wb.slices(batch):
                labelled, bounds = shingles(part.column("text"))
                keys = sketches(labelled, bounds)
                full = np.repeat(np.flatnonzero(np.diff(bounds)), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), part.column("uid").take(pa.array(full))], names=["key", "uid"])

    return slim.select("text", "uid").where("text IS NOT NULL").mapInArrow(run, "key bigint, uid binary").distinct()


def _stars(rows: DataFrame) -> DataFrame:
    """key, hub, uid: a bucket's members with the member that has most bucket mates."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = settle(rows.join(sizes, "key"), "buckets")
    mates = shared.groupBy("uid").agg(F.sum("n").alias("mates"))
    hubs = shared.select("key", "uid").join(mates, "uid").groupBy("key").agg(F.max(F.struct("mates", "uid")).alias("hub"))
    return shared.join(hubs, "key").where("uid <> hub.uid").select("key", F.col("hub.uid").alias("hub"), "uid")


def _compared(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """hub, uid, near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (small for part in wb.slices(batch, "uid_text") for small in wb.slices(part, "hub_text")):
                (a, a_bounds), (b, b_bounds) = shingles(part.column("hub_text")), shingles(part.column("uid_text"))
                near = [aligned(a[a_bounds[k] : a_bounds[k + 1]], b[b_bounds[k] : b_bounds[k + 1]], least) >= least for k in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("hub"), part.column("uid"), pa.array(near, pa.bool_())], names=["hub", "uid", "near"])

    hub_texts = texts.select(F.col("uid").alias("hub"), F.col("text").alias("hub_text"))
    full = pairs.join(hub_texts, "hub").join(texts.select("uid", F.col("text").alias("uid_text")), "uid")
    return full.select("hub", "uid", "hub_text", "uid_text").mapInArrow(run, "hub binary, uid binary, near boolean")


def parities(labelled: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text, how often shingles fall on each of 1024 bits, modulo 2. Two texts' parities differ in no more bits than the texts in shingles."""
    n = len(bounds) - 1
    slot = np.repeat(np.arange(n), np.diff(bounds)) * (64 * PARITIES) + (wb.mix(labelled) % np.uint64(64 * PARITIES)).astype(np.int64)
    odd = (np.bincount(slot, minlength=n * 64 * PARITIES) & 1).astype(np.uint8).reshape(n, 64 * PARITIES)
    return np.packbits(odd, axis=1, bitorder="little").view("<i8")


def _rareness(texts: DataFrame) -> np.ndarray:
    """How often shingles of each slot occur, as powers of two; 0 where once at most. Its size is fixed (1 MB)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            for part in wb.slices(batch):
                labelled, _ = shingles(part.column("text"))
                counts += np.bincount((labelled & np.uint64(len(counts) - 1)).astype(np.int64), minlength=len(counts))
        slots = np.flatnonzero(counts)
        for at in range(0, len(slots), 1 << 16):
            some = slots[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["slot", "n"])

    found = texts.mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1")
    table = found.select("slot", F.log2("n").cast("int").alias("rank")).toArrow()
    out = np.zeros(1 << COUNTER_BITS, np.uint8)
    out[table.column("slot").to_numpy()] = np.maximum(1, table.column("rank").to_numpy())
    return out


def _hidden_pairs(texts: DataFrame, least: float) -> DataFrame:
    """Pairs (hub, uid) of texts (uid, class, text) of different classes that may be ``least`` alike: a prefix-filtered self-join."""
    ranks = _rareness(texts.select("text"))
    odd_names = [f"odd{k}" for k in range(PARITIES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wb.slices(batch):
                labelled, bounds = shingles(part.column("text"))
                rank = ranks[(labelled & np.uint64(len(ranks) - 1)).astype(np.int64)]
                keys, rows, places = [np.zeros(0, np.uint64)], [], [np.zeros(0, np.int64)]
                for k, (low, high) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    first = prefix(labelled[low:high], rank[low:high], least) if high > low else np.zeros(0, np.int64)
                    shared = rank[low:high][first] > 0  # the others occur nowhere else
                    keys.append(labelled[low:high][first][shared])
                    places.append(np.flatnonzero(shared))
                    rows.append(int(shared.sum()))
                row = np.repeat(np.arange(part.num_rows), rows)
                size, odd = np.diff(bounds)[row], parities(labelled, bounds)[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), part.column("uid").take(pa.array(row)), part.column("class").take(pa.array(row)), pa.array(size), pa.array(np.concatenate(places)), *(pa.array(np.ascontiguousarray(odd[:, k])) for k in range(PARITIES))],
                    names=["key", "uid", "class", "size", "place", *odd_names],
                )

    rows = settle(texts.mapInArrow(run, "key bigint, uid binary, class binary, size bigint, place bigint, " + ", ".join(f"{c} bigint" for c in odd_names)), "prefixes")
    busy = rows.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("key")
    one = rows.join(busy, "key")
    two = one.toDF("key", "other", "other_class", "other_size", "other_place", *(f"other_{c}" for c in odd_names))
    # The first shingle that two texts share leaves at most what follows it in either for the rest.
    needed = F.ceil((F.col("size") + F.col("other_size")) * least / (1 + least) - 1e-9)
    room = F.least(F.col("size") - F.col("place"), F.col("other_size") - F.col("other_place"))
    differ = reduce(Column.__add__, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"other_{c}"))) for c in odd_names])
    fits = (room >= needed) & (differ <= F.col("size") + F.col("other_size") - 2 * needed)
    met = one.join(two, "key").where((F.col("uid") < F.col("other")) & (F.col("class") != F.col("other_class")) & fits)
    return met.select(F.col("other").alias("hub"), "uid").distinct()


def linked_texts(slim: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Links (a, b) between ids of near-equal texts, enough to join every class; slim: text, uid."""
    rows = settle(_bucket_rows(slim), "sketches")
    met = settle(_stars(rows), "stars")
    sieve = Sieve(met.select(F.explode(F.array(F.xxhash64("hub"), F.xxhash64("uid"))).alias("h")), "h")
    some = slim.select("uid", "text").where(F.col("text").isNotNull() & sieve.column(F.xxhash64("uid")))
    texts = settle(some.groupBy("uid").agg(F.min("text").alias("text")), "texts")
    first = settle(_compared(met.select("hub", "uid").distinct(), texts, least), "compared")
    links = first.where("near").select(F.col("hub").alias("a"), F.col("uid").alias("b"))
    # Behind a hub: members of a bucket of which not all are near it. The hub itself has met them all.
    judged = met.join(first, ["hub", "uid"])
    hiding = judged.groupBy("key").agg(F.count("*").alias("n"), F.min("near").alias("all_near")).where("n > 1 AND NOT all_near").select("key")
    behind = settle(judged.join(hiding, "key").select("uid").distinct(), "behind")
    if behind.isEmpty():
        return links
    labels = components(links)
    classed = behind.join(labels, behind["uid"] == labels["node"], "left").select("uid", F.coalesce("class", "uid").alias("class"))
    dealt = settle(texts.join(classed, "uid"), "dealt")
    pairs = settle(_hidden_pairs(dealt, least), "pairs")
    second = _compared(pairs, dealt.select("uid", "text"), least).where("near")
    return settle(links.union(second.select(F.col("hub").alias("a"), F.col("uid").alias("b"))), "links")


def _classes(slim: DataFrame, least: float) -> DataFrame:
    """One row per distinct text: uid, class_id, class_size, keep_id, keep_uid (the document that stays)."""
    own = slim.where("text IS NOT NULL").groupBy("uid").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    labels = components(linked_texts(slim, least))
    named = settle(own.join(labels, own["uid"] == labels["node"], "left").select("uid", "first_id", "n", F.coalesce("class", "uid").alias("class")), "named")
    whole = named.groupBy("class").agg(F.min("first_id").alias("class_id"), F.sum("n").alias("class_size"), F.min(F.struct(F.col("first_id").isNull(), "first_id", "uid")).alias("keep"))
    return named.join(whole, "class").select("uid", "class_id", "class_size", F.col("keep.first_id").alias("keep_id"), F.col("keep.uid").alias("keep_uid"))


def near_duplicates(docs: DataFrame, least: float = SIMILAR, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size."""
    slim = _identified(docs, doc_id, text)
    classes = _classes(slim, least).select("uid", "class_id", "class_size")
    return slim.select("doc_id", "uid").join(classes, "uid", "left").select(
        "doc_id", F.when(F.col("uid").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size")
    )


def drop_near_duplicates(docs: DataFrame, least: float = SIMILAR, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class (the least id), all columns as they are; null texts all stay."""
    slim = _identified(docs, doc_id, text)
    keep = _classes(slim, least).where("uid = keep_uid").select("keep_uid", "keep_id")
    times = slim.where("text IS NOT NULL").groupBy(F.col("uid").alias("same_uid"), F.col("doc_id").alias("same_id")).agg(F.count("*").alias("n"))
    keep = keep.join(times, (keep["keep_uid"] == times["same_uid"]) & keep["keep_id"].eqNullSafe(times["same_id"])).select("keep_uid", "keep_id", "n", F.xxhash64("keep_id").alias("keep_h"))
    rows = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_id"), F.unhex(F.md5(F.col(text).cast("string"))).alias("_uid"), F.xxhash64(doc_id).alias("_h"))
    # The id's hash is part of the key, so copies of one text are spread over tasks.
    met = rows.where("_uid IS NOT NULL").join(keep, (F.col("_uid") == F.col("keep_uid")) & (F.col("_h") == F.col("keep_h")) & F.col("_id").eqNullSafe(F.col("keep_id")))
    single = met.where("n = 1").select("_row.*")
    several = met.where("n > 1").groupBy("_uid", "_h").agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row.*")
    return single.unionByName(several).unionByName(docs.where(F.col(text).isNull()))
