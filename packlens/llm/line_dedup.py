"""Near-equal lines by a segment-partition edit join.

A line is split into ``threshold + 1`` segments. Two lines within the threshold share at least one segment unchanged,
shifted by no more than the edits before it; so every line is indexed under its own segments, looks up its substrings
under the segments of all lengths it may match, and only lines that meet there are compared: rows are dealt out and
sorted by segment, and each task matches neighbours. There a check sum is compared first, in which an edit changes few
bits, so that many variants of one line make no rows for pairs that differ by more; what is left is settled by a banded
bit-parallel edit distance over all pairs at once. Lengths and edits are counted in characters (code points), which are
bytes where a slice of texts is ASCII.

Equal lines are one line from the start. Linked lines form classes; the first occurrence of a class, by document id, then
text, then line, stays, and later ones go. Lines shorter than ``SHORTEST`` characters
are in one class if they are equal, and never otherwise; empty lines have no class. ``drop_repeated_lines`` drops short
lines only with ``short_lines``.

Defined cases: a null text has no lines and stays null; empty lines are short ones; a document that had lines and loses all of its
words is a copy of others and goes. Rows equal in id and text are one document: they get the same result. Null ids come
first. Empty tables give no rows. All other columns are passed on as they are, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlens.llm import wordbytes as wb
from packlens.llm.graphs import Sieve, components
from packlens.session import settle

THRESHOLD = 2
SHORTEST = 20
# Bits of a check sum.
_SINGLES = np.int64(0x7FFFFFFF << 1)
_PAIRS = np.int64(0x7FFFFFFF << 32)
_SAME_LENGTH = np.int64(-(1 << 63))
# Bytes of lines compared at a time.
_AREA = 1 << 21


class Lines:
    """The lines of several texts that are long enough, as spans of bytes (starts, ends) and of characters (low, high).

    With ``characters`` false every byte counts as a character.
    """

    def __init__(self, column: pa.Array, shortest: int = SHORTEST, characters: bool = True) -> None:
        self.data, offsets = wb.text_buffer(column)
        feeds = np.flatnonzero(self.data == 10)
        cuts = np.unique(np.concatenate([offsets[:-1], feeds + 1]))  # where lines begin
        cuts = cuts[cuts < len(self.data)]
        ends = np.append(cuts[1:], len(self.data))[: len(cuts)]
        ends = ends - (self.data[ends - 1] == 10)
        self.sums = wb.running_sums(wb.BYTE_CODE[self.data])
        self.letters, self.place = self.data, np.arange(len(self.data) + 1)
        low, high = cuts, ends
        if characters and (self.data >= 0x80).any():
            heads = (self.data & 0xC0) != 0x80
            heads[cuts] = True
            self.place = np.append(np.flatnonzero(heads), len(self.data))
            low, high = np.searchsorted(self.place, cuts), np.searchsorted(self.place, ends)
            # One byte for each character, the same for equal ones.
            self.letters = self.data[self.place[:-1]]
            codes = self.hashes(self.place[:-1], self.place[1:])
            self.letters = np.where(self.letters < 0x80, self.letters, (codes % np.uint64(128)).astype(np.uint8) + np.uint8(128))
        keep = high - low >= shortest
        self.starts, self.ends, self.low, self.high = cuts[keep], ends[keep], low[keep], high[keep]
        self.row = np.searchsorted(offsets, self.starts, "right") - 1
        self.number = np.searchsorted(feeds, self.starts) - np.searchsorted(feeds, offsets[self.row])
        self.ids = self.hashes(self.starts, self.ends).view(np.int64)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return wb.hashes_of(self.sums, starts, ends)

    def text(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()

    def check_sums(self, which: np.ndarray) -> np.ndarray:
        """Parities of how often letters (bits 1-31) and letter pairs (bits 32-62) of each kind stand in some of the lines."""
        if not len(which):
            return np.zeros(0, np.int64)
        pairs = _PAIR_BIT[(self.letters[:-1].astype(np.uint16) << 8) | self.letters[1:]]
        singles = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(_BYTE_BIT[self.letters])])
        pairs = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(pairs)])
        starts, ends = self.low[which], self.high[which]
        return (singles[ends] ^ singles[starts] ^ pairs[ends - 1] ^ pairs[starts]).view(np.int64)


_BYTE_BIT = np.uint64(1) << (wb.BYTE_CODE % np.uint64(31) + np.uint64(1))
_PAIR_BIT = np.uint64(1) << (wb.mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)) % np.uint64(31) + np.uint64(32))


def _segment(length: np.ndarray, i: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i of lines of a length: as equal as possible, longer ones last."""
    parts = threshold + 1
    size, longer = length // parts, length % parts
    short = parts - longer
    return i * size + np.maximum(0, i - short), size + (i >= short)


def _keys(lines: Lines, starts: np.ndarray, ends: np.ndarray, length: np.ndarray, i: int) -> np.ndarray:
    return wb.mix(lines.hashes(lines.place[starts], lines.place[ends]) + wb.mix((length * 64 + i).astype(np.uint64))).view(np.int64)


def segment_rows(lines: Lines, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, lines and check sums: index rows (lowest bit of the check sum 0), and look-ups (1; highest bit set for equal lengths)."""
    _, first = np.unique(lines.ids, return_index=True)
    starts, size = lines.low[first], (lines.high - lines.low)[first]
    ids, sums = lines.ids[first], lines.check_sums(first)
    rows = []
    for i in range(threshold + 1):
        at, width = _segment(size, i, threshold)
        rows.append((_keys(lines, starts + at, starts + at + width, size, i), ids, sums))
        for less in range(threshold + 1):  # lines at most so much shorter
            length = size - less
            at, width = _segment(length, i, threshold)
            for shift in range(max(-i, less - (threshold - i)), min(i, less + (threshold - i)) + 1):
                low = at + shift
                ok = (width > 0) & (low >= 0) & (low + width <= size) & (length > 0)
                mark = np.int64(1) if less else np.int64(1) | _SAME_LENGTH
                rows.append((_keys(lines, (starts + low)[ok], (starts + low + width)[ok], length[ok], i), ids[ok], sums[ok] | mark))
    return tuple(np.concatenate(x) for x in zip(*rows))


def meetings(key: np.ndarray, line: np.ndarray, sums: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs among rows sorted by key: an index row and a look-up under one key, with check sums that edits can explain."""
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    if not len(heads):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Nearly every key has the rows of one line only.
    several = np.minimum.reduceat(line, heads) != np.maximum.reduceat(line, heads)
    sizes = np.diff(np.append(heads, len(key)))
    found = []
    for head, size in zip(heads[several].tolist(), sizes[several].tolist()):
        own, mark = line[head : head + size], sums[head : head + size]
        looks = mark & 1 == 1
        if looks.all() or not looks.any():
            continue
        _, a = np.unique(own[~looks], return_index=True)
        a, a_sums = own[~looks][a], mark[~looks][a]
        _, b = np.unique(np.stack([own[looks], mark[looks]], 1), axis=0, return_index=True)
        b, b_sums = own[looks][b], mark[looks][b]
        for at in range(0, len(b), max(1, (1 << 20) // len(a))):
            some, some_sums = b[at : at + max(1, (1 << 20) // len(a))], b_sums[at : at + max(1, (1 << 20) // len(a))]
            differ = a_sums[:, None] ^ some_sums
            ok = (a[:, None] != some) & ((some_sums >= 0) | (a[:, None] < some))
            ok &= (np.bitwise_count(differ & _SINGLES) <= 2 * threshold) & (np.bitwise_count(differ & _PAIRS) <= 4 * threshold)
            one, two = np.nonzero(ok)
            found.append((a[one], some[two]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one, two = (np.concatenate(x) for x in zip(*found))
    return np.minimum(one, two), np.maximum(one, two)


def edit_distances(a: list[np.ndarray], b: list[np.ndarray], most: int) -> np.ndarray:
    """Edit distance of each pair of byte or code point arrays if it is at most ``most``, else any larger number.

    Bit-parallel over a band of ``2 * most + 1`` diagonals, whose differences sit in one word per pair; one step reads
    one element of every ``b``. The score runs down the band's last diagonal and then along the last row.
    """
    n = len(a)
    len_a, len_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    out = np.full(n, most + 1, np.int64)
    tiny = (np.minimum(len_a, len_b) <= most) & (np.abs(len_a - len_b) <= most)
    for k in np.flatnonzero(tiny):
        out[k] = _plain_distance(a[k], b[k])
    todo = np.flatnonzero(~tiny & (np.abs(len_a - len_b) <= most))
    one = np.uint64(1)
    todo = todo[np.argsort(-len_b[todo], kind="stable")]
    while len(todo):  # blocks of bounded area, longest first
        part = todo[: max(1, _AREA // int(len_b[todo[0]] + 1))]
        todo = todo[len(part) :]
        m, la, lb = len(part), len_a[part], len_b[part]
        steps = int(lb.max())
        # Rows shifted so that step i sees a[i - most .. i + most] in columns i .. i + 2 * most.
        left = np.full((m, steps + 3 * most + 1), -1, np.int32)
        right = np.full((m, steps), -2, np.int32)
        for r, k in enumerate(part):
            left[r, most : most + len(a[k])] = a[k]
            right[r, : len(b[k])] = b[k]
        plus = np.full(m, (~0 << (63 - most)) & 0xFFFFFFFFFFFFFFFF, np.uint64)
        minus = np.zeros(m, np.uint64)
        score = np.full(m, most, np.int64)
        for i in range(steps):
            match = np.zeros(m, np.uint64)
            for d in range(2 * most + 1):
                match |= (left[:, i + d] == right[:, i]).astype(np.uint64) << np.uint64(63 - 2 * most + d)
            zero = (((match & plus) + plus) ^ plus) | match | minus
            up, down = minus | ~(zero | plus), zero & plus
            diagonal = i < la - most
            bit = np.where(diagonal, np.uint64(63), np.uint64(62) - (i - (la - most)).clip(0, 62).astype(np.uint64))
            change = np.where(diagonal, 1 - ((zero >> bit) & one).astype(np.int64), ((up >> bit) & one).astype(np.int64) - ((down >> bit) & one).astype(np.int64))
            score += np.where(i < lb, change, 0)
            plus, minus = down | ~((zero >> one) | up), (zero >> one) & up
        out[part] = score
    return out


def _plain_distance(a: np.ndarray, b: np.ndarray) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _slim(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))


def occurrences(slim: DataFrame, shortest: int = SHORTEST, short_lines: bool = False) -> DataFrame:
    """doc_id, text_key, number, line, short: every line that is long enough; with ``short_lines`` all that are not empty."""
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wb.slices(batch):
                lines = Lines(part.column("text"), 1 if short_lines else shortest)
                row = pa.array(lines.row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(row), part.column("text_key").take(row), pa.array(lines.number, pa.int64()), pa.array(lines.ids), pa.array(lines.high - lines.low < shortest)],
                    names=["doc_id", "text_key", "number", "line", "short"],
                )

    return slim.mapInArrow(run, f"doc_id {kind}, text_key bigint, number bigint, line bigint, short boolean")


def _points(line: bytes) -> np.ndarray:
    return np.frombuffer(line.decode("utf-8", "replace").encode("utf-32-le"), np.int32)


def linked_lines(slim: DataFrame, threshold: int = THRESHOLD, shortest: int = SHORTEST, characters: bool = False) -> DataFrame:
    """Pairs a < b of different lines within the threshold, each once, measured in characters or in bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wb.slices(batch):
                made = segment_rows(Lines(part.column("text"), shortest, characters), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["key", "line", "sums"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the rows of the last key so far, which may go on in the next batch
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                new = [batch.column(c).to_numpy() for c in ("key", "line", "sums")]
                held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if held is None or not len(held[0]):
                continue
            upto = len(held[0]) if batch is None else int(np.searchsorted(held[0], held[0][-1]))
            a, b = meetings(*(x[:upto] for x in held), threshold)
            held = [x[upto:] for x in held]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    made = slim.select("text").mapInArrow(rows, "key bigint, line bigint, sums bigint")
    pairs = made.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a bigint, b bigint")
    pairs = settle(pairs.distinct(), "pairs")

    sieve = Sieve(pairs.select(F.explode(F.array("a", "b")).alias("line")), "line")

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wb.slices(batch):
                lines = Lines(part.column("text"), shortest, characters)
                _, first = np.unique(lines.ids, return_index=True)
                first = first[sieve.passes(lines.ids[first])]
                yield pa.RecordBatch.from_arrays([pa.array(lines.ids[first]), pa.array([lines.text(k) for k in first], pa.binary())], names=["line", "words"])

    texts = settle(slim.select("text").mapInArrow(wanted, "line bigint, words binary").groupBy("line").agg(F.min("words").alias("words")), "lines")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = [[_points(x) if characters else np.frombuffer(x, np.uint8) for x in batch.column(c).to_pylist()] for c in ("a_words", "b_words")]
            near = pa.array(edit_distances(*points, threshold) <= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(near) for c in ("a", "b")], names=["a", "b"])

    one = texts.select(F.col("line").alias("a"), F.col("words").alias("a_words"))
    two = texts.select(F.col("line").alias("b"), F.col("words").alias("b_words"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "a_words", "b_words")
    return settle(both.mapInArrow(verify, "a bigint, b bigint"), "linked")


def _judged(slim: DataFrame, threshold: int, shortest: int, short_lines: bool) -> tuple[DataFrame, DataFrame]:
    """Occurrences with class and links of their line, and the occurrence of each class that stays."""
    links = linked_lines(slim, threshold, shortest, characters=True)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    known = settle(components(links).join(degree, "node"), "classes")
    seen = occurrences(slim, shortest, short_lines).distinct()
    full = seen.join(known, seen["line"] == known["node"], "left").select(
        "doc_id", "text_key", "number", "line", "short", F.coalesce("class", "line").alias("class"), F.coalesce("links", F.lit(0)).alias("links")
    )
    full = settle(full, "occurrences")
    first = full.groupBy("class").agg(F.min(F.struct("doc_id", "text_key", "number", "short")).alias("first")).select("class", "first.*")
    return full, first


def line_classes(docs: DataFrame, threshold: int = THRESHOLD, shortest: int = SHORTEST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, n_long_lines, n_kept (of the long lines), n_links, line_classes (of all lines that are not empty, in order)."""
    slim = _slim(docs, doc_id, text)
    full, first = _judged(slim, threshold, shortest, True)
    per_doc = full.groupBy("doc_id", "text_key").agg(
        F.count_if(~F.col("short")).alias("n_long_lines"), F.sum("links").alias("n_links"), F.sort_array(F.collect_list(F.struct("number", "class"))).alias("in_order")
    )
    kept = first.groupBy(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key")).agg(F.count_if(~F.col("short")).alias("n_kept"))
    per_doc = per_doc.join(kept, per_doc["doc_id"].eqNullSafe(kept["kept_id"]) & (per_doc["text_key"] == kept["kept_key"]), "left").select(
        F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key"), "n_long_lines", "n_links", "n_kept", F.col("in_order.class").alias("line_classes")
    )
    base = slim.select("doc_id", "text_key")
    zero = F.lit(0).cast("bigint")
    return base.join(per_doc, base["doc_id"].eqNullSafe(per_doc["found_id"]) & (base["text_key"] == per_doc["found_key"]), "left").select(
        "doc_id", "text_key", F.coalesce("n_long_lines", zero).alias("n_long_lines"), F.coalesce("n_kept", zero).alias("n_kept"),
        F.coalesce("n_links", zero).alias("n_links"), F.coalesce("line_classes", F.array().cast("array<bigint>")).alias("line_classes"),
    )


def drop_repeated_lines(docs: DataFrame, threshold: int = THRESHOLD, shortest: int = SHORTEST, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = None, short_lines: bool = False) -> DataFrame:
    """The documents without their repeated lines, all other columns as they are; ``n_chars``: a column to count anew."""
    full, first = _judged(_slim(docs, doc_id, text), threshold, shortest, short_lines)
    gone = full.join(first.withColumn("stays", F.lit(True)).drop("class", "short"), (full["doc_id"].eqNullSafe(first["doc_id"])) & (full["text_key"] == first["text_key"]) & (full["number"] == first["number"]), "left")
    gone = gone.where("stays IS NULL").groupBy(full["doc_id"].alias("_gone_id"), full["text_key"].alias("_gone_key")).agg(F.collect_list(full["number"]).alias("_gone"))
    rows = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_id"), F.xxhash64(F.col(text).cast("string")).alias("_key"))
    names = docs.columns
    free = "_gone" + "_" * max(map(len, names))  # longer than any name of the documents
    met = rows.join(gone, rows["_id"].eqNullSafe(gone["_gone_id"]) & (rows["_key"] == gone["_gone_key"]), "left").select("_row.*", F.col("_gone").alias(free))
    place, count = names.index(text), names.index(n_chars) if n_chars else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wb.slices(batch, text):
                columns = part.columns[:-1]
                whole, stays = part.column(text).to_pylist(), np.ones(part.num_rows, bool)
                for k, lost in enumerate(part.columns[-1].to_pylist()):
                    if lost:
                        lost = set(lost)
                        whole[k] = "\n".join([x for i, x in enumerate(whole[k].split("\n")) if i not in lost])
                        stays[k] = bool(whole[k].strip())
                columns[place] = pa.array(whole, columns[place].type)
                if count is not None:
                    columns[count] = pa.array([x if t is None else len(t) for x, t in zip(columns[count].to_pylist(), whole)], columns[count].type)
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stays))

    return met.mapInArrow(run, docs.schema)
