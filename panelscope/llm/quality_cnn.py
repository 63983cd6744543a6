"""Quality classifier: a byte-level convolutional network in numpy.

Each byte has a small learnt vector; filters of eight bytes slide over overlapping chunks
that cover the whole document; every filter's strongest response in a chunk is pooled, the
pooled chunks are averaged, and two dense layers give one probability. Training runs in
rounds: the shards of the sample train from the same weights, each in its own partition,
and their weights are averaged. Learning and scoring both see every chunk of a text.

A null or empty text is one chunk of padding. Texts are learnt from and scored whole,
however long, in blocks of chunks. Repeated rows score alike. With one class only, or no training rows,
the score is the smoothed share of class 1 everywhere.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.llm._common import discard, materialize, table
from panelscope.llm._labels import held_out, labelled_sample

CHUNK, OVERLAP, WIDTH, STRIDE = 512, 64, 8, 2
EMBED, FILTERS, HIDDEN, THRESHOLD = 6, 24, 16, 0.7
#: Training: about so many labelled rows at most, their whole texts.
MAX_TRAIN_ROWS, SHARDS, ROUNDS, BATCH, RATE = 4000, 4, 8, 8, 0.015
_BLOCK = 256  # chunks in memory at once
_POSITIONS = (CHUNK - WIDTH) // STRIDE + 1


def chunks(text: str | None) -> np.ndarray:
    """(n, CHUNK) bytes; chunks overlap by OVERLAP and cover every byte; 0 pads."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(b) - OVERLAP) // step))
    padded = np.zeros((n - 1) * step + CHUNK, np.uint8)
    padded[: len(b)] = b
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


def start(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    f = lambda *s, k: (r.standard_normal(s) * k).astype(np.float32)
    return {
        "emb": f(256, EMBED, k=0.5),
        "conv": f(WIDTH * EMBED, FILTERS, k=(WIDTH * EMBED) ** -0.5),
        "cb": np.zeros(FILTERS, np.float32),
        "h": f(FILTERS, HIDDEN, k=FILTERS**-0.5),
        "hb": np.zeros(HIDDEN, np.float32),
        "o": f(HIDDEN, 1, k=HIDDEN**-0.5),
        "ob": np.zeros(1, np.float32),
    }


def _windows(p: dict, x: np.ndarray) -> np.ndarray:
    e = p["emb"][x]  # (n, CHUNK, EMBED)
    v = np.lib.stride_tricks.sliding_window_view(e.reshape(len(x), -1), WIDTH * EMBED, axis=1)
    return v[:, :: STRIDE * EMBED]  # (n, positions, WIDTH * EMBED)


def strongest(p: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, FILTERS): the position of each filter's strongest response in each chunk, and the response."""
    w = _windows(p, x).reshape(-1, WIDTH * EMBED)
    r = (w @ p["conv"]).reshape(len(x), _POSITIONS, FILTERS)
    where = r.argmax(1)
    return where, np.take_along_axis(r, where[:, None], 1)[:, 0] + p["cb"]


def pooled(p: dict, x: np.ndarray) -> np.ndarray:
    """(n, FILTERS): each filter's strongest response in each chunk, at least zero."""
    return np.maximum(strongest(p, x)[1], 0)


def probability(p: dict, mean: np.ndarray) -> np.ndarray:
    z = np.maximum(mean @ p["h"] + p["hb"], 0) @ p["o"] + p["ob"]
    return 1 / (1 + np.exp(-np.clip(z[:, 0].astype(np.float64), -40, 40)))


def score_texts(p: dict, texts) -> np.ndarray:
    """One probability for each text, chunk by chunk in bounded blocks."""
    sums, counts, rows, held, n_held = np.zeros((len(texts), FILTERS), np.float64), np.zeros(len(texts)), [], [], 0

    def flush():
        nonlocal rows, held, n_held
        if held:
            np.add.at(sums, np.concatenate(rows), pooled(p, np.concatenate(held)))
        rows, held, n_held = [], [], 0

    for i, t in enumerate(texts):
        x = chunks(t)
        counts[i] = len(x)
        for at in range(0, len(x), _BLOCK):
            part = x[at : at + _BLOCK]
            rows.append(np.full(len(part), i))
            held.append(part)
            n_held += len(part)
            if n_held >= _BLOCK:
                flush()
    flush()
    return probability(p, (sums / counts[:, None]).astype(np.float32)) if len(texts) else np.zeros(0)


def train_shard(p: dict, docs: list[tuple[np.ndarray, int]], weight: tuple[float, float], seed: int, rate: float) -> dict:
    """One pass of Adam over (chunks, label) pairs from the given weights."""
    p = {k: v.copy() for k, v in p.items()}
    m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    order = np.random.default_rng(seed).permutation(len(docs))
    for at in range(0, len(docs), BATCH):
        some = [docs[i] for i in order[at : at + BATCH]]
        n = np.array([len(c) for c, _ in some])
        x, owner = np.concatenate([c for c, _ in some]), np.repeat(np.arange(len(some)), n)
        y = np.array([y for _, y in some], np.float64)
        blocks = [slice(i, i + _BLOCK) for i in range(0, len(x), _BLOCK)]
        where, top = (np.concatenate(c) for c in zip(*(strongest(p, x[i]) for i in blocks), strict=True))
        relu = np.maximum(top, 0)
        mean = np.zeros((len(some), FILTERS), np.float32)
        np.add.at(mean, owner, relu / n[owner, None])
        hid = np.maximum(mean @ p["h"] + p["hb"], 0)
        prob = probability(p, mean)
        dz = ((prob - y) * np.where(y > 0, weight[1], weight[0]) / len(some)).astype(np.float32)[:, None]
        dh = (dz @ p["o"].T) * (hid > 0)
        dtop = ((dh @ p["h"].T) / n[:, None])[owner] * (top > 0)
        g = {"o": hid.T @ dz, "ob": dz.sum(0), "h": mean.T @ dh, "hb": dh.sum(0), "cb": dtop.sum(0).astype(np.float32)}
        g["conv"], g["emb"] = np.zeros_like(p["conv"]), np.zeros_like(p["emb"])
        for i in blocks:
            at_byte = x[i][np.arange(len(x[i]))[:, None, None], where[i][:, :, None] * STRIDE + np.arange(WIDTH)]
            best = p["emb"][at_byte].reshape(len(at_byte), FILTERS, WIDTH * EMBED)
            g["conv"] += np.einsum("nfk,nf->kf", best, dtop[i])
            dbest = (dtop[i][:, :, None] * p["conv"].T[None]).reshape(-1, EMBED)
            for k in range(EMBED):
                g["emb"][:, k] += np.bincount(at_byte.ravel(), weights=dbest[:, k], minlength=256).astype(np.float32)
        t += 1
        for k in p:
            m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.99 * v[k] + 0.01 * g[k] ** 2
            p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return p


def _step(p: dict, weight: tuple[float, float], k: int, rate: float):
    """Round ``k`` of the shard that is one partition: its row count and its weights, in order of their names."""

    def run(frames):
        rows = [(int(s), np.frombuffer(x, np.uint8).reshape(-1, CHUNK), int(y)) for f in frames for s, x, y in zip(f["shard"], f["x"], f["y"], strict=True)]
        for shard in sorted({r[0] for r in rows}):
            mine = sorted(((x, y) for s, x, y in rows if s == shard), key=lambda r: (r[0].tobytes(), r[1]))
            q = train_shard(p, mine, weight, 1000 * k + shard, rate)
            yield pd.DataFrame({"n": [len(mine)], "p": [b"".join(q[name].tobytes() for name in sorted(q))]})

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAIN_ROWS) -> dict:
    encode = F.pandas_udf("binary")(lambda s: s.map(lambda t: chunks(t).tobytes()))
    sample = materialize(labelled_sample(docs, labels, label, max_rows, SHARDS).select("shard", "y", encode("text").alias("x")), "chunks")
    seen = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    p, n0, n1 = start(), seen.get(0, 0), seen.get(1, 0)
    if not n0 or not n1:
        share = (n1 + 1) / (n0 + n1 + 2)
        p["o"][:], p["ob"][:] = 0, np.log(share / (1 - share))
        return p
    weight = (min(3.0, (n0 + n1) / (2 * n0)), min(3.0, (n0 + n1) / (2 * n1)))
    for k in range(ROUNDS):
        rate = RATE * 0.5 * (1 + np.cos(np.pi * k / ROUNDS))
        dealt = sample.repartitionById(SHARDS, "shard")
        parts = dealt.mapInPandas(_step(p, weight, k, rate), "n long, p binary").collect()  # SHARDS small rows
        total = sum(r["n"] for r in parts)
        flat = sum(np.frombuffer(bytes(r["p"]), np.float32).astype(np.float64) * (r["n"] / total) for r in parts)
        at, q = 0, {}
        for name in sorted(p):
            q[name] = flat[at : at + p[name].size].reshape(p[name].shape).astype(np.float32)
            at += p[name].size
        p = q
    discard(sample)
    return p


def with_score(docs: DataFrame, model: dict, text_col: str = "text", out: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` plus the probability of class 1."""
    return docs.withColumn(out, F.pandas_udf("double")(lambda s: pd.Series(score_texts(model, list(s)), dtype=float))(text_col))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return with_score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
