"""Language of texts by unigram piece models, summed over all ways to cut each word into pieces.

Pieces are byte strings of a fixed public vocabulary. Each language has its own piece probabilities, learned by
expectation maximisation from labelled texts. A word's probability under a language is the sum over all its
segmentations (the forward algorithm); a text's is the product over its words. Distinct words are scored once per task
and looked up by hash.

At most ``SAMPLE`` texts per language are learned from, one for each of so many hash buckets of the document id; that bound is
a parameter. Every text is predicted whole.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, and so is everything when there is nothing to learn
from. Rows with a null language, or whose id's remainder holds them out, are never learned from; a null id is not held
out. Equal languages in the labels are one language; ties go to the first by name. Repeated rows get equal results; an empty table
gives no rows. Other columns are ignored or, when filtering, passed on.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlens.llm import wordbytes as wb

SAMPLE = 500
LONGEST = 6
ROUNDS = 4
UNKNOWN = "und"
_FLOOR = 0.02
_BLOCKS = (8, 16, 32, 64)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def piece_keys(path: str, longest: int = LONGEST) -> np.ndarray:
    """Letter pieces of the vocabulary file, and all single letter bytes, packed into sorted 64-bit numbers."""
    letter = wb.ALPHA & (wb.LOWER == np.arange(256))
    found = {bytes([b]) for b in np.flatnonzero(letter)}
    with open(path, "rb") as lines:
        for token, _ in map(bytes.split, lines):
            raw = base64.b64decode(token).lower()
            if 0 < len(raw) <= longest and letter[list(raw)].all():
                found.add(raw)
    return np.array(sorted(int.from_bytes(x, "big") for x in found), np.uint64)


def _spans(block: np.ndarray, keys: np.ndarray, longest: int) -> np.ndarray:
    """For words in the rows of a zero-padded byte matrix: the piece that starts at i and has k + 1 bytes, or len(keys)."""
    n, length = block.shape
    out = np.full((n, length, longest), len(keys), np.int32)
    packed = np.zeros((n, length), np.uint64)
    for k in range(min(longest, length)):
        width = length - k
        packed = (packed[:, :width] << np.uint64(8)) | block[:, k:].astype(np.uint64)
        at = np.minimum(np.searchsorted(keys, packed), len(keys) - 1)
        hit = (keys[at] == packed) & (block[:, k:] != 0)
        out[:, :width, k] = np.where(hit, at, len(keys))
    return out


def _forward(spans: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Summed probability of every prefix: (word, bytes read, language)."""
    n, length, longest = spans.shape
    alpha = np.zeros((n, length + 1, p.shape[1]))
    alpha[:, 0] = 1
    for j in range(1, length + 1):
        for k in range(min(longest, j)):
            alpha[:, j] += alpha[:, j - k - 1] * p[spans[:, j - k - 1, k]]
    return alpha


def _expected(spans: np.ndarray, sizes: np.ndarray, counts: np.ndarray, p: np.ndarray, total: np.ndarray) -> None:
    """Add each piece's expected uses over all segmentations (forward-backward) to ``total``; counts: (word, language)."""
    n, length, longest = spans.shape
    alpha = _forward(spans, p)
    beta = np.zeros_like(alpha)
    beta[np.arange(n), sizes] = 1
    whole = alpha[np.arange(n), sizes]
    share = np.where(whole > 0, counts / np.where(whole > 0, whole, 1), 0)
    for i in range(length - 1, -1, -1):
        for k in range(min(longest, length - i)):
            piece = spans[:, i, k]
            step = p[piece] * beta[:, i + k + 1]
            beta[:, i] += step
            use = alpha[:, i] * step * share
            for m in range(p.shape[1]):
                total[:, m] += np.bincount(piece, use[:, m], len(total))


def _matrix(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    at = np.minimum(starts[:, None] + np.arange(width), max(len(data) - 1, 0))
    return np.where(np.arange(width) < sizes[:, None], data[at], 0).astype(np.uint8)


@dataclass
class Model:
    """Languages, piece keys, and piece probabilities with a last row of zeros for what is no piece."""

    languages: list[str]
    keys: np.ndarray
    p: np.ndarray
    longest: int = LONGEST

    def word_scores(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log-probability of each word (byte span) under each language."""
        out = np.empty((len(starts), len(self.languages)))
        low = 0
        for width in _BLOCKS:
            mine = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for at in range(0, len(mine), 8192):
                pick = mine[at : at + 8192]
                spans = _spans(_matrix(data, starts[pick], sizes[pick], width), self.keys, self.longest)
                out[pick] = np.log(np.maximum(_forward(spans, self.p)[np.arange(len(pick)), sizes[pick]], 1e-300))
        for k in np.flatnonzero(sizes > low):
            out[k] = self._long(data[starts[k] : starts[k] + sizes[k]])
        return out

    def _long(self, word: np.ndarray) -> np.ndarray:
        """The same for one long run of bytes, with the running sums rescaled on the way."""
        scale = np.zeros(len(self.languages))
        last = np.zeros((self.longest, len(self.languages)))
        last[-1] = 1
        for at in range(0, len(word), 4096):
            upto = min(len(word), at + 4096)
            low = max(0, at - self.longest + 1)
            spans = _spans(word[None, low:upto], self.keys, self.longest)[0]
            for j in range(at + 1, upto + 1):
                new = np.zeros(len(self.languages))
                for k in range(min(self.longest, j)):
                    new += last[-1 - k] * self.p[spans[j - k - 1 - low, k]]
                last = np.concatenate([last[1:], new[None]])
                if j % 16 == 0:
                    most = np.maximum(last.max(0), 1e-300)
                    last /= most
                    scale += np.log(most)
        return scale + np.log(np.maximum(last[-1], 1e-300))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, path: str | None = None, rounds: int = ROUNDS) -> Model:
    """Piece probabilities from labelled texts whose id does not hold them out."""
    path = path or vocabulary()
    slim = docs.where(~held_out(F.col(doc_id)) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.xxhash64(doc_id).alias("h")
    )
    picks = slim.select("lang", "h", F.pmod("h", F.lit(sample)).alias("slot")).groupBy("lang", "slot").agg(F.min("h").alias("h")).select("lang", "h")
    chosen = slim.join(F.broadcast(picks), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wb.slices(batch):
                words = wb.words(part.column("text"), wb.ALPHA, True)
                keys = wb.mix(words.hashes + wb.mix(words.rows().astype(np.uint64)))
                _, first, times = np.unique(keys, return_index=True, return_counts=True)
                if len(first):
                    yield pa.RecordBatch.from_arrays(
                        [part.column("lang").take(pa.array(words.rows()[first])), pa.array([words.raw(k) for k in first], pa.binary()), pa.array(times, pa.int64())],
                        names=["lang", "word", "n"],
                    )

    got = chosen.select("lang", "text").mapInArrow(run, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])
    languages = sorted(set(got.column("lang").to_pylist()))
    keys = piece_keys(path)
    if not languages:
        return Model([], keys, np.zeros((len(keys) + 1, 0)))
    word_list = sorted(set(got.column("word").to_pylist()))
    counts = np.zeros((len(word_list), len(languages)))
    place, number = {w: k for k, w in enumerate(word_list)}, {x: k for k, x in enumerate(languages)}
    counts[[place[w] for w in got.column("word").to_pylist()], [number[x] for x in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
    data = np.frombuffer(b"".join(word_list), np.uint8)
    sizes = np.array([len(w) for w in word_list])
    starts = np.cumsum(sizes) - sizes
    blocks, low = [], 0
    for width in _BLOCKS[:-1]:
        mine = np.flatnonzero((sizes > low) & (sizes <= width))
        low = width
        for at in range(0, len(mine), 16384):
            pick = mine[at : at + 16384]
            blocks.append((_spans(_matrix(data, starts[pick], sizes[pick], width), keys, LONGEST), sizes[pick], counts[pick]))
    p = np.zeros((len(keys) + 1, len(languages)))
    for spans, _, n in blocks:  # to begin with, how often each piece stands in the words at all
        for m in range(len(languages)):
            p[:, m] += np.bincount(spans.ravel(), np.repeat(n[:, m], spans[0].size), len(p))
    for _ in range(rounds + 1):
        p[:-1] += _FLOOR
        p[-1] = 0
        p /= p.sum(0)
        if _ == rounds:
            break
        total = np.zeros_like(p)
        for spans, size, n in blocks:
            _expected(spans, size, n, p, total)
        p = total
    return Model(languages, keys, p)


class Detector:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.memo = wb.Memo(max(1, len(model.languages)), np.float64, max(1 << 14, (4 << 20) // max(4, len(model.languages))))

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of the most likely language (-1: unknown), and its share of the probability."""
        n = len(column)
        words = wb.words(column, wb.ALPHA, True)
        letter = np.zeros(n, bool)
        rows = words.rows()
        ascii_word = (words.data[words.starts] < 0x80) if len(words.starts) else np.zeros(0, bool)
        letter[rows[ascii_word]] = True
        for row in np.flatnonzero(~letter & (words.counts > 0)):  # no word begins with an ASCII letter: look closely
            letter[row] = any(map(str.isalpha, column[int(row)].as_py()))
        if not self.model.languages:
            return np.full(n, -1), np.zeros(n)
        keys, first, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        new = lambda at: self.model.word_scores(words.data, words.starts[first[at]], (words.ends - words.starts)[first[at]])
        each = self.memo.get(keys, new)[which]
        sums = np.concatenate([np.zeros((1, each.shape[1])), np.cumsum(each, 0)])
        total = sums[words.bounds[1:]] - sums[words.bounds[:-1]]
        best = total.argmax(1)
        share = 1 / np.exp(np.clip(total - total.max(1, keepdims=True), -700, 0)).sum(1)
        return np.where(letter, best, -1), np.where(letter, share, 0.0)


def detect(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns: doc_id, lang_pred, score."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector(model)
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            for part in wb.slices(batch):
                best, share = detector.predict(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names[best], pa.string()), pa.array(share)], names=["doc_id", "lang_pred", "score"])

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5, text: str = "text") -> DataFrame:
    """The documents with a language that is at least so likely, all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector(model)
        for batch in batches:
            for part in wb.slices(batch, text):
                best, share = detector.predict(part.column(text))
                yield part.filter(pa.array((best >= 0) & (share >= least)))

    return docs.mapInArrow(run, docs.schema)
