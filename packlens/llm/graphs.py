"""Helpers for joins on pairs: sieves of fixed size, and classes of linked nodes without collecting a link."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlens.session import settle

SIEVE_BITS = 23


class Sieve:
    """A bit map of 64-bit values: passes every value put in, and few others until it fills up. Its size is fixed (1 MB)."""

    def __init__(self, values: DataFrame, column: str) -> None:
        slot = F.col(column).bitwiseAND(F.lit((1 << SIEVE_BITS) - 1))
        bits = values.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))").alias("bit"))
        self.words = np.zeros(1 << (SIEVE_BITS - 6), np.int64)
        for r in bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
            self.words[r["word"]] = r["bits"]

    def passes(self, values: np.ndarray) -> np.ndarray:
        slot = values & np.int64((1 << SIEVE_BITS) - 1)
        return (self.words[slot >> 6] >> (slot & 63)) & 1 == 1

    def column(self, values: Column) -> Column:
        @F.pandas_udf("boolean")
        def passed(x: pd.Series) -> pd.Series:
            return pd.Series(self.passes(x.to_numpy(np.int64)))

        return passed(values)


def components(links: DataFrame) -> DataFrame:
    """Columns node, class (the least node reachable) of all nodes in ``links`` (a, b).

    Least labels spread over links and labels point on to their own labels, so the rounds grow with the logarithm of
    the longest path; each round is written, so nothing is recomputed.
    """
    both = settle(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("class")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("class").alias("near"))
        spread = labels.join(near, labels["node"] == near["a"]).select("node", F.col("class").alias("old"), F.least("class", "near").alias("class"))
        ahead = labels.select(F.col("node").alias("there"), F.col("class").alias("further"))
        new = settle(spread.join(ahead, spread["class"] == ahead["there"]).select("node", "old", F.least("class", "further").alias("class")), "labels")
        labels = new.select("node", "class")
        if new.where("old <> class").isEmpty():
            return labels
