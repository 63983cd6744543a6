"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text becomes the set of its lower-cased character n-grams of 3 to 8 characters, white space
as one space, hashed into 2^22 cells. Eight characters hold the beginnings that mark a word in
German, French and Spanish; shorter n-grams are shared with clean words. Each present cell counts with its log-count ratio times a
learnt weight; a ratio counts only if it stands EVIDENCE standard errors from chance, so
that thousands of stray n-grams can't outvote a telling one. Only cells with such a ratio
reach the driver and the executors. Ratios are one aggregation over the training rows by
block of cells, weights a logistic regression whose gradient is summed over Spark's
partitions each step.

A null or empty text has no n-grams; its score is that of the intercept. Texts are read
whole, however long. Repeated rows are scored alike. If the training rows hold one class
only, or there are none, the score is the smoothed share of class 1 everywhere.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.llm._common import discard, materialize, table
from panelscope.llm._labels import MAX_TRAIN_ROWS, held_out, labelled_sample

BITS, SIZES, THRESHOLD = 22, (3, 4, 5, 6, 7, 8), 0.3
STEPS, RATE, L2, SMOOTHING, EVIDENCE = 25, 0.05, 1e-4, 1.0, 4.0
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_BLOCK = 1 << 20
_RANGE = 1 << 16  # cells whose counts meet in one group


def _hashes(text: str | None):
    """The cells of a text's n-grams by block and size, repeats included."""
    raw = f" {' '.join((text or '').lower().split())} "
    b = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    for at in range(0, len(b), _BLOCK):  # blocks overlap by the longest n-gram
        part = b[at : at + _BLOCK + max(SIZES) - 1]
        code = part + np.uint64(1)
        for n in range(2, max(SIZES) + 1):
            if len(part) < n:
                break
            code = code[: len(part) - n + 1] * _STEP + part[n - 1 :] + np.uint64(1)
            if n in SIZES:
                yield ((code ^ code >> np.uint64(31)) * _MIX >> np.uint64(64 - BITS)).astype(np.int32)


def cells(text: str | None) -> np.ndarray:
    """The distinct cells of a text's n-grams, ascending."""
    found = list(_hashes(text))
    if not found:
        return np.zeros(0, np.int32)
    every = np.concatenate(found)
    if len(every) < 1_000_000:
        return np.unique(every)
    seen = np.zeros(1 << BITS, bool)
    seen[every] = True
    return np.flatnonzero(seen).astype(np.int32)


class Kept:
    """The cells that count, ascending."""

    def __init__(self, on: np.ndarray):
        self.on, self.known = on.astype(np.int32), None

    def __getstate__(self):
        return {"on": self.on, "known": None}  # the table is rebuilt where it is used

    def of(self, text: str | None) -> np.ndarray:
        """Positions of a text's distinct cells among those that count, ascending."""
        if self.known is None:
            self.known = np.zeros(1 << BITS, bool)
            self.known[self.on] = True
        found = [x[self.known[x]] for x in _hashes(text)]
        return np.searchsorted(self.on, np.unique(np.concatenate(found))) if found else np.zeros(0, np.int64)


class Model:
    """Weights (ratio times learnt weight) of the cells that count, and the intercept."""

    def __init__(self, on: np.ndarray, weights: np.ndarray, intercept: float):
        self.kept, self.weights, self.intercept = Kept(on), weights.astype(np.float32), float(intercept)

    def score(self, text: str | None) -> float:
        z = self.intercept + float(self.weights[self.kept.of(text)].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _counts(frames):
    """One partition's texts by cell and label, a row for each range of cells it touches."""
    n = np.zeros((2, 1 << BITS), np.int32)
    for f in frames:
        for t, y in zip(f["text"], f["y"], strict=True):
            n[int(y), cells(t)] += 1
    on = np.flatnonzero(n.any(0)).astype(np.int32)
    for r, x in zip(np.unique(on // _RANGE), np.split(on, np.flatnonzero(np.diff(on // _RANGE)) + 1), strict=False):
        yield pd.DataFrame({"range": [int(r)], "cells": [x.tobytes()], "n0": [n[0, x].tobytes()], "n1": [n[1, x].tobytes()]})


def _telling(n0: float, n1: float):
    """The cells of one range whose ratio stands far enough from chance, with their counts."""
    share = n1 / (n0 + n1)

    def run(key, f):  # one row of each partition of a bounded sample
        total = np.zeros((2, _RANGE))
        for c, a, b in zip(f["cells"], f["n0"], f["n1"], strict=True):
            at = np.frombuffer(c, np.int32) % _RANGE
            total[0, at] += np.frombuffer(a, np.int32)
            total[1, at] += np.frombuffer(b, np.int32)
        seen = total.sum(0)
        on = np.flatnonzero((seen >= 3) & (np.abs(total[1] - seen * share) >= EVIDENCE * np.sqrt(seen * share * (1 - share))))
        return pd.DataFrame({"cell": on + int(key[0]) * _RANGE, "n0": total[0, on], "n1": total[1, on]})

    return run


def _only(kept: Kept):
    """Texts as positions among the kept cells."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"at": [kept.of(t).astype(np.int32).tobytes() for t in f["text"]], "y": f["y"]})

    return run


def _gradient(now: np.ndarray, bias: float):
    """One partition's gradient by position; position len(now) is the intercept's."""

    def run(frames):
        g = np.zeros(len(now) + 1)
        for f in frames:
            for x, y in zip(f["at"], f["y"], strict=True):
                at = np.frombuffer(x, np.int32)
                e = 1 / (1 + np.exp(-np.clip(bias + float(now[at].sum()), -40, 40))) - y
                g[at] += e
                g[-1] += e
        on = np.flatnonzero(g)
        yield pd.DataFrame({"k": on, "g": g[on]})

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_TRAIN_ROWS) -> Model:
    sample = materialize(labelled_sample(docs, labels, label, max_rows).select("text", "y"), "sample")
    n1, n0 = sample.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first()
    if not n0 or not n1:
        discard(sample)
        share = (n1 + 1) / (n0 + n1 + 2)
        return Model(np.zeros(0, np.int32), np.zeros(0), np.log(share / (1 - share)))
    counts = sample.mapInPandas(_counts, "range int, cells binary, n0 binary, n1 binary")
    kept = counts.groupBy("range").applyInPandas(_telling(n0, n1), "cell int, n0 double, n1 double").orderBy("cell").toPandas()  # at most 2^BITS rows; far fewer stand so far from chance
    on = kept["cell"].to_numpy()
    p, q = kept["n1"].to_numpy() + SMOOTHING, kept["n0"].to_numpy() + SMOOTHING
    scale = np.log(p / (n1 + 2 * SMOOTHING)) - np.log(q / (n0 + 2 * SMOOTHING))
    few = materialize(sample.mapInPandas(_only(Kept(on)), "at binary, y int"), "telling")
    discard(sample)
    w, bias, m = np.zeros(len(on)), np.log(n1 / n0), np.zeros(len(on) + 1)
    for _ in range(STEPS):
        summed = few.mapInPandas(_gradient((scale * w).astype(np.float32), bias), "k int, g double").groupBy("k").agg(F.sum("g").alias("g")).toPandas()
        g = np.zeros(len(on) + 1)
        g[summed["k"].to_numpy()] = summed["g"].to_numpy() / (n0 + n1)
        g[:-1] = g[:-1] * scale + L2 * w
        m = 0.9 * m + g
        w, bias = w - RATE * m[:-1], bias - RATE * m[-1]
    discard(few)
    return Model(on, scale * w, bias)


def with_score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)  # 8 bytes for each cell kept, so 32 MB at the very most
    return docs.withColumn(out, F.pandas_udf("double")(lambda s: pd.Series([held.value.score(t) for t in s], dtype=float))(text_col))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return with_score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
