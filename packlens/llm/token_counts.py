"""Token counts by byte-pair merging, without ever naming a token.

Each piece of a text is a linked list of symbols and a heap of adjacent pairs by merge rank; the lowest-ranked pair is
popped and merged until no pair is in the merge table. The count is the number of first symbols minus the merges.
Pieces never cross ASCII white space, so a text's count is the sum over its stretches between white space; each distinct
stretch is counted once per task and then looked up by hash.

Rules of the vocabulary file that matter here: NFC, white space folded, lower case; letter runs, single digits and other
runs are pieces, as are a few English endings; a piece's last symbol carries the word-end mark; special strings inside
a text are one token each, recognised before anything else.

Defined cases: a null or empty text has no bytes and no tokens; a text is never cut, whatever its length; equal and repeated rows
get equal counts; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlens.llm import wordbytes as wb


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@cache
def byte_symbols() -> list[str]:
    """The character that stands for each byte in vocabulary files: itself where it prints, else one from 256 on."""
    printed = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printed else chr(next(spare)) for b in range(256)]


def merges_of(piece: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> int:
    """How many merges the lowest-rank-first rule makes in a list of symbols."""
    n = len(piece)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = []
    for k in range(n - 1):
        if (found := pairs.get((piece[k], piece[k + 1]))) is not None:
            heap.append((found[0], k, piece[k], piece[k + 1], found[1]))
    heapq.heapify(heap)
    merged = 0
    while heap:
        _, k, left, right, new = heapq.heappop(heap)
        r = after[k]
        if piece[k] != left or r >= n or piece[r] != right:
            continue  # one of the two has gone into another symbol since
        merged += 1
        piece[k], piece[r] = new, -1
        after[k] = after[r]
        if after[r] < n:
            before[after[r]] = k
            if (found := pairs.get((new, piece[after[r]]))) is not None:
                heapq.heappush(heap, (found[0], k, new, piece[after[r]], found[1]))
        if before[k] >= 0 and (found := pairs.get((piece[before[k]], new))) is not None:
            heapq.heappush(heap, (found[0], before[k], piece[before[k]], new, found[1]))
    return merged


class Counter:
    """Token counts of stretches of text under one vocabulary file."""

    def __init__(self, path: str, most: int = 1 << 20, most_words: int = 1 << 19) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        number: dict[str, int] = {}
        self.mark = spec["model"]["end_of_word_suffix"] or ""
        first = [number.setdefault(s, len(number)) for s in byte_symbols()]
        last = [number.setdefault(s + self.mark, len(number)) for s in byte_symbols()]
        self.first, self.last, self.pairs = first, last, {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            ids = [number.setdefault(x, len(number)) for x in (a, b, a + b)]
            self.pairs.setdefault((ids[0], ids[1]), (rank, ids[2]))
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.words: dict[str, int] = {}
        self.most_words = most_words
        self.memo = wb.Memo(1, np.int32, most)

    def piece(self, text: str) -> int:
        have = self.words.get(text)
        if have is None:
            if len(self.words) >= self.most_words:
                self.words.clear()
            raw = text.encode()
            symbols = [self.first[b] for b in raw]
            symbols[-1] = self.last[raw[-1]]
            have = self.words[text] = len(raw) - merges_of(symbols, self.pairs)
        return have

    def plain(self, text: str) -> int:
        """Tokens of a stretch that holds no special string."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = "".join([c.lower() for c in text]) if "Σ" in text else text.lower()  # by character: no final-sigma rule
        else:
            text = text.lower()
        piece = self.piece
        return sum([piece(p) for p in self.pieces.findall(text)])

    def stretch(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        between = self.special.split(text)
        return sum(map(self.plain, between)) + len(between) - 1

    def count(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and tokens of every text."""
        words = wb.words(column, wb.SOLID, False)
        keys, first, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        new = lambda at: np.array([[self.stretch(words.raw(k).decode("utf-8", "replace"))] for k in first[at]], np.int32)
        each = self.memo.get(keys, new)[:, 0][which]
        sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(each, dtype=np.int64)])
        return np.diff(words.offsets), sums[words.bounds[1:]] - sums[words.bounds[:-1]]


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Columns: doc_id, n_bytes, n_tokens."""
    kind = docs.schema[doc_id].dataType.simpleString()
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            for part in wb.slices(batch):
                size, tokens = counter.count(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
