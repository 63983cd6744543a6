"""Packing in the order of a space-filling curve.

A document's vector is the mean of fixed random vectors of its token ids, in three
dimensions. Vectors are measured against the mean and spread of all documents' vectors, so
that they fill the cube whatever the language of the corpus; the place of a document's cell
on a Hilbert curve is its key. Documents lie end to end in the order of (key, id, hash of
the text), and the whole is cut every 2048 ids: neighbours on the curve share sequences,
every id lies in exactly one piece, and only the last sequence has padding.

Only keys and lengths are sorted; ids meet their positions by the row's number, so
copies, which share a key, never fill one task. A null or empty text is its end id
alone. Repeated rows are packed each; they are alike, so their order among themselves is
all that may differ between runs. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.llm._common import global_offsets, materialize, table
from panelscope.llm._tokenize import encoded
from panelscope.llm.records import vocabulary_path

VOCABULARY, END_ID, LENGTH = "byte_bpe_50k.json", 1, 2048
DIMS, BITS = 3, 10


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of (n, dims) cells below 2^bits (Skilling 2004)."""
    x = np.array(cells, np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        q, p = 1 << b, (1 << b) - 1
        for i in range(dims):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            if i:
                x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t ^= np.where((x[-1] >> b) & 1, (1 << b) - 1, 0)
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b) & 1
    return key


def directions(n: int = 1 << 16, dims: int = DIMS, seed: int = 11) -> np.ndarray:
    """One fixed random direction for every id, dimension by dimension."""
    return np.ascontiguousarray(np.random.default_rng(seed).standard_normal((n, dims)).astype(np.float32).T)


def vectors(ids: np.ndarray, n: np.ndarray, way: np.ndarray) -> list[np.ndarray]:
    """The mean direction of each document's ids, dimension by dimension."""
    begin = np.cumsum(n) - n
    return [np.add.reduceat(w.take(ids), begin, dtype=np.float64) / n for w in way]


def cell(x: np.ndarray, mean: float, spread: float) -> np.ndarray:
    """Cells along one dimension: normally spread values fill them about evenly."""
    z = (x - mean) / spread if spread > 0 else np.zeros(len(x))
    return np.clip((0.5 + 0.5 * np.tanh(0.8 * z)) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def curve_key(rows: DataFrame, names: list[str]):
    """The Hilbert key of each row's vector, against the mean and spread of all rows (one row to the driver)."""
    seen = rows.agg(*(f(c).alias(f"{f.__name__}_{c}") for c in names for f in (F.avg, F.stddev_pop))).first()
    place = [(seen[f"avg_{c}"] or 0.0, seen[f"stddev_pop_{c}"] or 0.0) for c in names]
    of = F.pandas_udf("long")(lambda *xs: pd.Series(hilbert(np.stack([cell(x.to_numpy(), *p) for x, p in zip(xs, place, strict=True)], 1))))
    return of(*names)


def encoded_rows(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """uid, doc_id (as text), h (a hash of the text), n, ids (16-bit) and the vector of every row, written."""
    names = [f"x{i}" for i in range(DIMS)]

    way = docs.sparkSession.sparkContext.broadcast(directions())  # 65,536 ids of three numbers

    def add(batch, ids, n):
        return [pa.array(x) for x in vectors(ids, n, way.value)]

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return materialize(encoded(rows, vocabulary, end_id, add, ", ".join(f"{c} double" for c in names)), "encoded")


def cut(start: int, n: int, length: int = LENGTH):
    """(start in the document, piece length, sequence, offset) for ids [start, start + n)."""
    at = 0
    while at < n:
        seq, off = divmod(start + at, length)
        k = min(length - off, n - at)
        yield at, k, seq, off
        at += k


def pack(docs: DataFrame, vocabulary: str, end_id: int = END_ID, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids (32-bit)."""
    rows = encoded_rows(docs, vocabulary, end_id)
    narrow = rows.select("doc_id", "h", "uid", "n", curve_key(rows, [f"x{i}" for i in range(DIMS)]).alias("key"))
    placed, _ = global_offsets(narrow, ["key", "doc_id", "h", "uid"], "n", "at", "curve")

    def run(batches):
        for b in batches:
            out = []
            for doc_id, at, n, ids in zip(*(b.column(c).to_pylist() for c in ("doc_id", "at", "n", "ids")), strict=True):
                wide = memoryview(np.frombuffer(ids, "<u2").astype("<u4").tobytes())
                for s, k, seq, off in cut(at, n, length):
                    piece = wide[4 * s : 4 * (s + k)]
                    out.append((doc_id, s, k, zlib.crc32(piece), n, seq, off, *([bytes(piece)] if with_ids else [])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    schema = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.string(), *[pa.int64()] * 6, *([pa.binary()] if with_ids else [])]
    met = rows.select("uid", "doc_id", "n", "ids").join(placed.select("uid", "at"), "uid")
    pieces = met.select("doc_id", "at", "n", "ids").mapInArrow(run, schema)
    return pieces.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, vocabulary_path(VOCABULARY), with_ids=False)
