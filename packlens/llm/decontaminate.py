"""Benchmark passages in documents: a prefix-filtered set join over word shingles, confirmed word by word.

A window is ``width`` consecutive words of an item (the whole item if it has fewer). A document can hold a window only
if it holds every shingle of it, so one necessary shingle per window is enough to join on: the one rarest in the
documents. Its place in the window bounds where the window must begin, the window's length bounds where it ends, and
the words there are compared exactly.

1. Count the items' shingles over all documents (the rarity order).
2. Documents give up only shingles that may be some window's rarest, with the words around them. A bit map of fixed size
   does that; it passes on too much when full, never too little, so its broadcast does not grow with the items.
3. Equi-join with the windows on the shingle, compare the words, and gather spans and items per document.

Defined cases: a null or wordless text has no words and is never hit; a null or wordless item has no window; items with
a null id mark words but are not listed. Rows with equal doc_id and text are one document and each get its result.
Empty tables give no hits, or no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlens.llm import wordbytes as wb
from packlens.session import settle

WIDTH = 10
SHINGLE = 5
MAP_BITS = 23

_WINDOWS = "item_id {}, size int, words array<string>, shingles array<bigint>"
_HITS = "doc_id {}, text_key bigint, n_words bigint, found array<struct<token: bigint, at: bigint, skip: int, around: array<string>>>"


def _shingles(words: wb.Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    hashes, first = wb.windows(words.hashes, words.bounds, length)
    return hashes.view(np.int64), first


def _texts(words: wb.Words, low: int, high: int) -> list[str]:
    return [words.raw(k).decode("utf-8", "replace") for k in range(low, high)]


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WIDTH, shingle: int = SHINGLE) -> DataFrame:
    """Distinct windows of every item with the hashes of their shingles, in order."""
    kind = items.schema[item_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wb.slices(batch):
                words = wb.words(part.column("text"), wb.ALNUM, True)
                rows: list[tuple] = []
                for row, (low, high) in enumerate(zip(words.bounds[:-1], words.bounds[1:])):
                    size = int(min(width, high - low))
                    if not size:
                        continue
                    length = min(shingle, size)
                    hashes = wb.windows(words.hashes[low:high], np.array([0, high - low]), length)[0].view(np.int64)
                    texts = _texts(words, low, high)
                    for at in range(high - low - size + 1):
                        rows.append((row, size, texts[at : at + size], hashes[at : at + size - length + 1].tolist()))
                if rows:
                    where, sizes, texts, hashes = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("item_id").take(pa.array(where)), pa.array(sizes, pa.int32()), pa.array(texts, pa.list_(pa.string())), pa.array(hashes, pa.list_(pa.int64()))],
                        names=["item_id", "size", "words", "shingles"],
                    )

    plain = items.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(run, _WINDOWS.format(kind)).distinct()


def _bit_map(tokens: DataFrame) -> dict[int, np.ndarray]:
    """For each shingle length a bit map of the hashes; its size is fixed, whatever the number of hashes."""
    slot = F.col("token").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    words = tokens.select("length", F.shiftright(slot, 6).alias("word"), F.expr("shiftleft(1L, cast(token & 63 as int))").alias("bit"))
    maps: dict[int, np.ndarray] = {}
    for r in words.groupBy("length", "word").agg(F.bit_or("bit").alias("bits")).collect():
        maps.setdefault(r["length"], np.zeros(1 << (MAP_BITS - 6), np.int64))[r["word"]] = r["bits"]
    return maps


def _flags(maps: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    return {k: np.unpackbits(v.view(np.uint8), bitorder="little").view(bool) for k, v in maps.items()}


def _in_map(flags: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return flags[(hashes & np.int64((1 << MAP_BITS) - 1))]


def shingle_counts(docs: DataFrame, maps: dict[int, np.ndarray]) -> DataFrame:
    """How often each shingle that the maps let through stands in the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacked = _flags(maps)
        for batch in batches:
            for part in wb.slices(batch):
                words = wb.words(part.column("text"), wb.ALNUM, True)
                for length, flags in unpacked.items():
                    hashes, _ = _shingles(words, length)
                    token, n = np.unique(hashes[_in_map(flags, hashes)], return_counts=True)
                    if len(token):
                        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(n)], names=["token", "n"])

    return docs.mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def document_tokens(docs: DataFrame, maps: dict[int, np.ndarray], kind: str, width: int = WIDTH) -> DataFrame:
    """Per document its word count, and the shingles the maps let through with the words around them."""
    found_type = pa.list_(pa.struct([("token", pa.int64()), ("at", pa.int64()), ("skip", pa.int32()), ("around", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacked = _flags(maps)
        for batch in batches:
            for part in wb.slices(batch):
                words = wb.words(part.column("text"), wb.ALNUM, True)
                rows = words.rows()
                found: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for length, flags in unpacked.items():
                    hashes, first = _shingles(words, length)
                    for k in np.flatnonzero(_in_map(flags, hashes)):
                        row, at = rows[first[k]], int(first[k])
                        low = max(int(words.bounds[row]), at - (width - length))
                        high = min(int(words.bounds[row + 1]), at + width)
                        found[row].append({"token": int(hashes[k]), "at": at - int(words.bounds[row]), "skip": at - low, "around": _texts(words, low, high)})
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(words.counts, pa.int64()), pa.array(found, found_type)],
                    names=["doc_id", "text_key", "n_words", "found"],
                )

    return docs.mapInArrow(run, _HITS.format(kind))


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  width: int = WIDTH, shingle: int = SHINGLE) -> DataFrame:
    """Per row of ``docs``: doc_id, text_key, n_words, n_hit, hit_items (ids as sorted strings)."""
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    slim = slim.withColumn("text_key", F.xxhash64("text"))
    wins = settle(item_windows(items, item_id, item_text, width, shingle).withColumn("length", F.least(F.lit(shingle), "size")), "windows")
    all_tokens = wins.select("length", F.explode("shingles").alias("token")).distinct()
    counts = shingle_counts(slim.select("text"), _bit_map(all_tokens))
    placed = wins.select("item_id", "size", "length", "words", F.posexplode("shingles").alias("place", "token"))
    ranked = (
        placed.join(counts, "token", "left")
        .groupBy("item_id", "size", "length", "words")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "place")).alias("rarest"))
        .where(F.col("rarest.n") > 0)
    )
    needles = settle(ranked.select("item_id", "size", "length", "words", "rarest.token", "rarest.place"), "needles")
    base = settle(document_tokens(slim, _bit_map(needles.select("length", "token").distinct()), kind, width), "tokens")
    hits = (
        base.select("doc_id", "text_key", F.explode("found").alias("f"))
        .select("doc_id", "text_key", "f.*")
        .join(needles, "token")
        .where((F.col("place") <= F.col("skip")) & (F.col("skip") - F.col("place") + F.col("size") <= F.size("around")))
        .where(F.slice("around", F.col("skip") - F.col("place") + 1, F.col("size")) == F.col("words"))
        .select("doc_id", "text_key", F.col("item_id").cast("string").alias("item"), (F.col("at") - F.col("place")).alias("start"), "size")
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set(F.struct("start", "size")).alias("spans"), F.collect_set("item").alias("items"))
    )
    marked = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1))))
    per_doc = hits.select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), F.size(marked).cast("bigint").alias("n_hit"), F.sort_array("items").alias("hit_items"))
    plain = base.select("doc_id", "text_key", "n_words")
    return plain.join(per_doc, plain.doc_id.eqNullSafe(per_doc.hit_id) & (plain.text_key == per_doc.hit_key), "left").select(
        "doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("hit_items", F.array().cast("array<string>")).alias("hit_items"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that no window of any item occurs in, with all their columns."""
    marks = contamination(docs, items, doc_id, text)
    bad = marks.where("n_hit > 0").select(F.col("doc_id").alias("_hit_id"), F.col("text_key").alias("_hit_key")).distinct()
    row = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_id"), F.xxhash64(F.col(text).cast("string")).alias("_key"))
    return row.join(bad, row["_id"].eqNullSafe(bad["_hit_id"]) & (row["_key"] == bad["_hit_key"]), "left_anti").select("_row.*")
