"""Fixed-length training windows by multiway number differencing.

Every document becomes its token ids plus an end id. Whole windows are cut off its front; what is left over, and less
than a window, is packed: remainders are gathered in groups, and each group is split over windows by Karmarkar-Karp
differencing. A partial partition is a list of window loads; the two with the largest spread are merged, heaviest load
onto lightest, until one is left, so loads come out nearly equal. Where a load exceeds the window, the window count
rises by one and the group is split again.

Remainders are cut to at most ``piece`` ids first (cuts are free), which lets loads balance to within a few ids.
All of it runs inside the tasks that read the texts: no shuffle, and memory is one group of remainders plus one slice
of texts. A task's windows carry its partition number, so ids do not meet, and a rerun of a lost task gives the same rows.

Defined cases: a null text is an empty one and packs as its end id alone; a very long text is cut into many windows; equal
and repeated rows are packed like any other; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlens.llm import wordbytes as wb

WINDOW = 1024
PIECE = 256
GROUP = 512

_ROWS = ("doc_id {}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids array<int>")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _quick(path: str):
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


class Encoder:
    """Ids of many texts by one byte-level tokenizer, each distinct stretch of text encoded once.

    A stretch begins at a single space between two other characters that are not white space. The vocabulary's
    splitting pattern always begins a token there and nothing before or after changes what it finds, so ids of a text
    are the ids of its stretches in a row. ``tests/llm`` hold this against the library on whole texts.
    """

    def __init__(self, path: str, rank_path: str | None, most: int = 3 << 19) -> None:
        """``rank_path``: the same vocabulary as ranks, which is faster on short stretches without special strings."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.quick = _quick(rank_path) if rank_path else None
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.memo = wb.Memo(2, np.int64, 1 << 62)
        self.pool = np.zeros(1 << 16, np.int32)
        self.used = 0

    @staticmethod
    def _bounds(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where stretches begin: row starts, and the single spaces."""
        n = len(data)
        cut = np.zeros(n, bool)
        if n >= 3:
            solid = data > 0x20
            # Leads of the characters that are white space beyond ASCII; next to them nothing is cut.
            lead = (data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3))
            near = lead.copy()
            near[1:] |= lead[:-1]
            near[2:] |= lead[:-2]
            cut[1:-1] = (data[1:-1] == 0x20) & solid[:-2] & solid[2:] & ~lead[2:] & ~near[:-2]
        edges = offsets[1:-1]
        cut[edges[edges > 0] - 1] = False  # a row's last character has nothing behind it
        edges = offsets[:-1]
        cut[edges[edges < n]] = True
        return np.flatnonzero(cut)

    def _learn(self, spans: list[str]) -> np.ndarray:
        if self.quick:
            one = self.quick.encode_ordinary
            found = [one(x) if "<|" not in x else self.tokenizer.encode(x, add_special_tokens=False).ids for x in spans]
        else:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(spans, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        begin = self.used + np.cumsum(sizes) - sizes
        need = self.used + int(sizes.sum())
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(need, 2 * len(self.pool)) - len(self.pool), np.int32)])
        self.pool[self.used : need] = np.fromiter(chain.from_iterable(found), np.int32, need - self.used)
        self.used = need
        return np.stack([begin, sizes], 1)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and, for each text, where its ids begin."""
        if len(self.memo.keys) > self.most:
            self._forget()
        data, offsets = wb.text_buffer(column)
        starts = self._bounds(data, offsets)
        ends = np.append(starts[1:], len(data))
        keys, first, which = np.unique(wb.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        spans = lambda at: [data[starts[k] : ends[k]].tobytes().decode("utf-8", "replace") for k in first[at]]
        found = self.memo.get(keys, lambda at: self._learn(spans(at)))[which]
        begin, size = found[:, 0], found[:, 1]
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        ids = self.pool[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, offsets)]


def difference(sizes: np.ndarray, bins: int) -> np.ndarray:
    """The bin of each size by Karmarkar-Karp differencing over ``bins`` partial sums."""
    n = len(sizes)
    if bins == 1 or not n:
        return np.zeros(n, np.int64)
    single = np.zeros(bins, np.int64)
    loads: list[np.ndarray | None] = [None] * n
    children: list[tuple | None] = [None] * n
    heap = [(-int(s), k) for k, s in enumerate(sizes)]
    heapq.heapify(heap)

    def load(k: int) -> np.ndarray:
        if loads[k] is not None:
            return loads[k]
        out = single.copy()
        out[0] = sizes[k]
        return out

    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = load(a) + load(b)[::-1]  # heaviest first meets lightest first
        order = np.argsort(-both, kind="stable")
        both = both[order]
        loads[a] = loads[b] = None
        loads.append(both)
        children.append((a, b, order))
        heapq.heappush(heap, (-int(both[0] - both[-1]), len(loads) - 1))
    out = np.zeros(n, np.int64)
    names: dict[int, np.ndarray] = {heap[0][1]: np.arange(bins)}
    for k in range(len(loads) - 1, n - 1, -1):
        a, b, order = children[k]
        mine = np.empty(bins, np.int64)
        mine[order] = names.pop(k)
        for child, labels in ((a, mine), (b, mine[::-1])):
            if child < n:
                out[child] = labels[0]
            else:
                names[child] = labels
    return out


def balance(sizes: np.ndarray, window: int) -> tuple[np.ndarray, int]:
    """A window for each piece so that none exceeds ``window``; one more window whenever a split does."""
    bins = max(1, -(-int(sizes.sum()) // window))
    while True:
        where = difference(sizes, bins)
        if np.bincount(where, sizes, bins).max(initial=0) <= window:
            return where, bins
        bins += 1


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, rank_path: str | None = None, end: int = 0, window: int = WINDOW,
         piece: int = PIECE, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids."""
    kind = docs.schema[doc_id].dataType.simpleString()
    if path is None:
        path, rank_path = vocabulary(), ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, rank_path)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        types = [pa.int64()] * 6 + [pa.list_(pa.int32())]
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 40
        left: list[tuple] = []  # doc_id, start, ids, doc_tokens
        heads = 0

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found))
            flat = np.concatenate(columns[7])
            where = np.concatenate([[0], np.cumsum([len(x) for x in columns[7]])])
            ids = pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(flat, pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *[pa.array(c, t) for c, t in zip(columns[1:7], types)], ids], names=names)

        def piece_row(key, start, ids, total, sequence, offset) -> tuple:
            return key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset, ids

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            cut = [(key, start + at, ids[at : at + piece], total) for key, start, ids, total in left for at in range(0, len(ids), piece)]
            left.clear()
            sizes = np.array([len(c[2]) for c in cut], np.int64)
            where, bins = balance(sizes, window)
            used = np.zeros(bins, np.int64)
            out = []
            for k in np.argsort(where, kind="stable"):
                key, start, ids, total = cut[k]
                out.append(piece_row(key, start, ids, total, number + int(where[k]), int(used[where[k]])))
                used[where[k]] += len(ids)
            number += bins
            yield rows(out)

        id_type = None
        for batch in batches:
            id_type = batch.column("doc_id").type
            for part in wb.slices(batch):
                ids, bounds = encoder.encode(part.column("text"))
                whole = []
                for key, low, high in zip(part.column("doc_id").to_pylist(), bounds[:-1], bounds[1:]):
                    own = np.append(ids[low:high], np.int32(end))
                    full = len(own) // window * window
                    for at in range(0, full, window):
                        whole.append(piece_row(key, at, own[at : at + window], len(own), number, 0))
                        number += 1
                    if full < len(own):
                        left.append((key, full, own[full:], len(own)))
                    if len(left) >= group:
                        yield from flush()
                if whole:
                    yield rows(whole)
        if left:
            yield from flush()

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return slim.mapInArrow(run, _ROWS.format(kind))
