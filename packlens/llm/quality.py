"""Quality rules: counted base rules, and logistic regressions over hashed word and character n-grams.

Two calibrated models are trained on labelled rows, one for quality and one for toxicity: sparse (L1) logistic
regressions over the set of words, the rates of three-byte sequences and a few rates of the base rules. A fifth of the
labelled rows is kept back to fit the probability scale. Texts are scored in Arrow batches against fixed thresholds.

At most ``LABELLED_ROWS`` labelled rows, the first by a hash of their id, are used for training; that bound is a
parameter. All documents are scored, over their whole texts.

Defined cases: a null text has no words and fails the base rule; labels with a null id or a null mark are not used; when a
document has several labels the lower quality and the higher toxicity count, and of several texts of one id the least is
trained on. With no labelled rows of both kinds a model is left out and rejects nothing. Equal rows get equal results;
empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlens.llm import wordbytes as wb

LABELLED_ROWS = 8000
QUALITY_AT_LEAST = 0.5
TOXIC_BELOW = 0.5
SYMBOLS = b"#*$%&|<>"
GRAM_BITS = 16
RATES = 6
#: Feature numbers: rates first, then buckets of three-byte sequences, then words by 62-bit hash.
_GRAMS_AT = 64
_WORDS_AT = _GRAMS_AT + (1 << GRAM_BITS)

_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(flags, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _keyed(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return wb.mix(hashes + wb.mix(rows.astype(np.uint64) + np.uint64(1)))


def base_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every text."""
    words = wb.words(column, wb.SOLID, False)
    data, offsets, n = words.data, words.offsets, len(column)
    solid = wb.SOLID[data]
    lines = wb.words(column, wb.LINE, False)
    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(solid, dtype=np.int64)])
    real = sums[lines.ends] > sums[lines.starts]
    line_rows = lines.rows()[real]
    _, first = np.unique(_keyed(line_rows, lines.hashes[real]), return_index=True)
    triples, at = wb.windows(words.hashes, words.bounds, 3)
    rows = words.rows()
    _, which, times = np.unique(_keyed(rows[at], triples), return_inverse=True, return_counts=True)
    twice = at[times[which] > 1] if len(at) else at
    covered = np.zeros(len(rows), bool)
    for k in range(3):
        covered[twice + k] = True
    return {
        "n_words": words.counts,
        "word_chars": _per_row(solid & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _per_row(_IS_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(line_rows, minlength=n) - np.bincount(line_rows[first], minlength=n),
        "n_repeat_words": np.bincount(rows[covered], minlength=n),
    }


def features(column: pa.Array, base: dict[str, np.ndarray], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature number and value of all features that are not zero, or only of the ``known`` (sorted) numbers."""
    n = len(column)
    words = wb.words(column, wb.ALNUM, True)
    number = (words.hashes >> np.uint64(2)).astype(np.int64) + _WORDS_AT
    rows = words.rows()
    if known is not None:
        keep = _among(known, number)
        number, rows = number[keep], rows[keep]
    _, first = np.unique(_keyed(rows, number.view(np.uint64)), return_index=True)
    out = [(rows[first], number[first], np.ones(len(first)))]

    data, offsets = wb.text_buffer(column)
    size = np.diff(offsets)
    if len(data) >= 3:
        wide = data.astype(np.uint32)
        code = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
        bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_BITS)).astype(np.int64) + _GRAMS_AT
        keep = np.ones(len(bucket), bool)
        for back in (1, 2):  # not across texts
            edge = offsets[1:-1] - back
            keep[edge[(edge >= 0) & (edge < len(keep))]] = False
        if known is not None:
            flags = np.zeros(_WORDS_AT, bool)
            flags[known[known < _WORDS_AT]] = True
            keep &= flags[bucket]
        place = np.flatnonzero(keep)
        row = np.searchsorted(offsets, place, "right") - 1
        pair, times = np.unique(row * _WORDS_AT + bucket[place], return_counts=True)
        row = pair // _WORDS_AT
        out.append((row, pair % _WORDS_AT, np.log1p(1000 * times / size[row]) / np.log(1001)))

    total = np.maximum(base["n_words"], 1)
    upper = _per_row((data >= 0x41) & (data <= 0x5A), offsets)
    rates = np.stack([
        base["n_symbols"] / np.maximum(size, 1), base["n_dup_lines"] / total, base["n_repeat_words"] / total,
        base["word_chars"] / total / 20, upper / np.maximum(size, 1), np.log1p(base["n_words"]) / 10,
    ], 1)
    row, which = np.nonzero(rates)
    out.append((row, which.astype(np.int64), rates[row, which]))
    row, number, value = (np.concatenate(x) for x in zip(*out))
    return row, number, value


def _among(known: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(numbers), bool)
    at = np.minimum(np.searchsorted(known, numbers), len(known) - 1)
    return known[at] == numbers


@dataclass
class Model:
    """Weights by feature number, and the probability scale."""

    numbers: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def scores(self, n: int, row: np.ndarray, number: np.ndarray, value: np.ndarray) -> np.ndarray:
        if not len(self.numbers):
            return np.full(n, self.bias)
        at = np.minimum(np.searchsorted(self.numbers, number), len(self.numbers) - 1)
        hit = self.numbers[at] == number
        return self.bias + np.bincount(row[hit], self.weights[at[hit]] * value[hit], n)

    def probability(self, z: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * z + self.shift)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _sparse_logistic(row, col, value, y, n_cols, penalty: float, steps: int = 200) -> tuple[np.ndarray, float]:
    """L1 logistic regression by accelerated proximal steps; rare classes weigh as much as common ones."""
    n = len(y)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / n
    size = np.bincount(row, value**2, n) + 1
    rate = 4 / max(float((weight * size).sum()), 1e-9)
    w, b = np.zeros(n_cols), 0.0
    ahead_w, ahead_b, t = w, b, 1.0
    for _ in range(steps):
        error = weight * (_sigmoid(np.bincount(row, ahead_w[col] * value, n) + ahead_b) - y)
        step = ahead_w - rate * np.bincount(col, error[row] * value, n_cols)
        new_w = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        new_b = ahead_b - rate * error.sum()
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pull = (t - 1) / new_t
        ahead_w, ahead_b = new_w + pull * (new_w - w), new_b + pull * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return w, b


def fit(row, col, numbers, value, y: np.ndarray, held: np.ndarray, penalty: float = 1e-3, least: int = 4) -> Model | None:
    """A model of the rows that are not held out, with its probability scale from those that are.

    Entry k of the sparse matrix says that text ``row[k]`` has ``value[k]`` of feature ``numbers[col[k]]``.
    """
    train = ~held
    if len(set(y[train])) < 2:
        return None
    used = train[row]
    often = np.bincount(col[used], minlength=len(numbers)) >= least
    # Features whose pull at the start is far below the penalty stay at zero; leave them out from the beginning.
    share = np.where(y == 1, 0.5 / y[train].mean(), 0.5 / (1 - y[train].mean())) / train.sum()
    pull = np.bincount(col, (share * (0.5 - y) * train)[row] * value, len(numbers))
    often &= np.abs(pull) >= 0.5 * penalty
    keep = used & often[col]
    renumber, position = np.cumsum(often) - 1, np.cumsum(train) - 1
    w, b = _sparse_logistic(position[row[keep]], renumber[col[keep]], value[keep].astype(float), y[train].astype(float), int(often.sum()), penalty)
    kept = np.flatnonzero(w)
    model = Model(numbers[often][kept], w[kept], float(b))
    mine = np.flatnonzero(often[col] & held[row])
    z = model.scores(len(y), row[mine], numbers[col[mine]], value[mine].astype(float))[held]
    if len(set(y[held])) == 2:
        # Platt's two parameters by Newton steps on smoothed targets.
        pos, neg = y[held].sum(), (1 - y[held]).sum()
        target = np.where(y[held] == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
        x = np.stack([z, np.ones_like(z)], 1)
        ab = np.array([1.0, 0.0])
        for _ in range(50):
            p = _sigmoid(x @ ab)
            curve = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-3
            ab = ab - np.linalg.solve(curve, x.T @ (p - target) + 1e-3 * (ab - [1.0, 0.0]))
        if np.isfinite(ab).all() and ab[0] > 0:
            model.slope, model.shift = float(ab[0]), float(ab[1])
    return model


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", bound: int = LABELLED_ROWS) -> dict[str, Model | None]:
    """Models of ``quality`` and ``toxic`` from at most ``bound`` labelled documents."""
    marks = (
        labels.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
        .na.drop()
        .groupBy("label_id")
        .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(bound)
    )
    slim = docs.select(F.col(doc_id).alias("label_id"), F.col(text).cast("string").alias("text"))
    rows = slim.join(F.broadcast(marks), "label_id").groupBy("label_id", "quality", "toxic").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wb.slices(batch):
                column = part.column("text")
                row, number, value = features(column, base_counts(column))
                order = np.argsort(row, kind="stable")
                where = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))])
                lists = [pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(x)) for x in (number[order], value[order].astype(np.float32))]
                yield pa.RecordBatch.from_arrays([part.column("label_id"), part.column("quality"), part.column("toxic"), *lists], names=["label_id", "quality", "toxic", "number", "value"])

    kind = docs.schema[doc_id].dataType.simpleString()
    got = rows.mapInArrow(run, f"label_id {kind}, quality int, toxic int, number array<bigint>, value array<float>").toArrow().sort_by("label_id").combine_chunks()
    if not got.num_rows:
        return {"quality": None, "toxic": None}
    number, value = (got.column(c).combine_chunks() for c in ("number", "value"))
    row = np.repeat(np.arange(got.num_rows, dtype=np.int32), number.value_lengths().to_numpy(zero_copy_only=False))
    marks = {name: got.column(name).to_numpy().clip(0, 1) for name in ("quality", "toxic")}
    numbers = np.unique(number.flatten().to_numpy())
    col = np.searchsorted(numbers, number.flatten().to_numpy()).astype(np.int32)
    value = value.flatten().to_numpy()
    held = np.arange(got.num_rows) % 5 == 4
    del got, number
    return {name: fit(row, col, numbers, value, y, held) for name, y in marks.items()}


def score(docs: DataFrame, models: dict[str, Model | None], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Base counts, p_quality, p_toxic, base_failed and kept of every document."""
    kind = docs.schema[doc_id].dataType.simpleString()
    numbers = [m.numbers for m in models.values() if m is not None]
    known = np.unique(np.concatenate(numbers)) if numbers else np.zeros(0, np.int64)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wb.slices(batch):
                column = part.column("text")
                base = base_counts(column)
                found = features(column, base, known)
                p = {k: np.full(part.num_rows, float(k == "quality")) if m is None else m.probability(m.scores(part.num_rows, *found)) for k, m in models.items()}
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(base[n], pa.int64()) for n in names], pa.array(p["quality"]), pa.array(p["toxic"])],
                    names=["doc_id", *names, "p_quality", "p_toxic"],
                )

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    scored = slim.mapInArrow(run, f"doc_id {kind}, {', '.join(n + ' bigint' for n in names)}, p_quality double, p_toxic double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    good = (F.col("p_quality") >= QUALITY_AT_LEAST) & (F.col("p_toxic") < TOXIC_BELOW)
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & good)
