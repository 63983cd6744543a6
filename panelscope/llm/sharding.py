"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..n-1 in the order of (id, checksum, size); a keyed balanced Feistel
network over the next even power of two, applied again while it leaves 0..n-1, permutes
the numbers. Shard and slot of a row are remainder and quotient of its permuted number,
so anyone who knows n, the key and a row's number can compute where the row lies.

Shard counts differ by at most one, whatever ids, texts or copies there are. A null text
has no bytes; null ids come first; rows that are the same in all three are
interchangeable. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.llm._common import global_offsets, table

SHARDS, ROUNDS, KEY = 24, 6, 20240229
_PRIME = (1 << 31) - 1


class Feistel:
    """A permutation of 0..n-1 for n up to 2^62."""

    def __init__(self, n: int, key: int = KEY, rounds: int = ROUNDS):
        self.n, self.half = n, max(1, -(-max(n - 1, 1).bit_length() // 2))
        self.mask = (1 << self.half) - 1
        r = np.random.default_rng(key)
        self.keys = [(int(a), int(b)) for a, b in zip(r.integers(1 << 29, _PRIME, rounds), r.integers(1, _PRIME, rounds), strict=True)]

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for a, b in self.keys:
            f = (right * a + b) % _PRIME
            left, right = right, left ^ ((f ^ (f >> 13)) & self.mask)
        return (left << self.half) | right

    def permute(self, x: np.ndarray) -> np.ndarray:
        y = self._once(np.asarray(x, np.int64))
        while (out := y >= self.n).any():
            y[out] = self._once(y[out])
        return y

    def invert(self, y: np.ndarray) -> np.ndarray:
        x = np.asarray(y, np.int64).copy()
        todo = np.ones(len(x), bool)
        while todo.any():
            left, right = x[todo] >> self.half, x[todo] & self.mask
            for a, b in reversed(self.keys):
                f = (left * a + b) % _PRIME
                left, right = right ^ ((f ^ (f >> 13)) & self.mask), left
            x[todo] = (left << self.half) | right
            todo = x >= self.n
        return x


def shard(docs: DataFrame, shards: int = SHARDS, key: int = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row, shard, slot for every row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit(1).cast("long").alias("one"),
    )
    numbered, n = global_offsets(narrow, ["doc_id", "text_crc32", "size"], "one", "row", "rows")
    feistel = Feistel(n, key)
    place = F.pandas_udf("long")(lambda s: pd.Series(feistel.permute(s.to_numpy()), dtype="int64"))
    return numbered.withColumn("_p", place("row")).select(
        "doc_id", "size", "text_crc32", "row", (F.col("_p") % shards).cast("int").alias("shard"), F.expr(f"_p div {shards}").alias("slot")
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
