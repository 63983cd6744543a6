"""Hidden Markov language model: Baum-Welch counts summed over partitions, exact forward scores.

Words and one end per text are the tokens. A token's emission has two steps: the state
emits a class, the class emits the token. A token that makes up at least 1/OWN of all
training tokens is a class of its own (so there are at most OWN of these); every other
token falls into one of TAIL classes by its last three bytes. Within a class a token has
probability (c+1)/(C+T+1), from its exact training count c, the class's count C and its
distinct tokens T; what is left is for unseen tokens. So the model covers every token
there can be, while its size is fixed by its parameters, whatever the corpus.

Counts, class statistics and all rounds of Baum-Welch cover every training text. Frequent
tokens (at least 1/HEAD of all: at most HEAD of them) go to the executors with their
counts; occurrences of all others meet their counts in a join, which no hot token is then
part of. Baum-Welch runs over whole texts: segments of SEGMENT tokens go side by side, each from
the exact forward and backward states at its borders, which the products of the segments' steps
give. Scores are exact over whole texts, by the scaled forward recursion.

A null or empty text is its end token alone. Repeated rows count in training as often as
they occur and are scored alike. Without training texts every token is unseen.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.llm._common import fold, materialize, table, words_of

FOLDS, HELD_OUT = 7, 2
STATES, OWN, TAIL, HEAD = 8, 1 << 14, 4096, 1 << 20
ROUNDS, SEGMENT, PRIOR, STICKY, SEED = 5, 1024, 200.0, 0.95, 5
#: Distinct tokens counted in memory before they are passed on.
_FLUSH = 300_000
_AT_ONCE = 512
END = b""  # no word is empty


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, c) over whole texts; the end token is the empty string."""

    def run(batches):
        seen: Counter = Counter()
        for f in batches:
            for t in f[text_col]:
                seen.update(words_of(t))
                seen[END] += 1
                if len(seen) >= _FLUSH:
                    yield pd.DataFrame({"token": [k.decode("utf-8", "surrogatepass") for k in seen], "n": list(seen.values())})
                    seen = Counter()
        if seen:
            yield pd.DataFrame({"token": [k.decode("utf-8", "surrogatepass") for k in seen], "n": list(seen.values())})

    return docs.select(text_col).mapInPandas(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("c"))


class Classes:
    """Class and log10(c + 1) of each frequent token; the class of any other by its ending."""

    def __init__(self, head: list[tuple[bytes, int]], total: int):
        head = sorted(head, key=lambda x: (-x[1], x[0]))
        self.index = {t: i for i, (t, _) in enumerate(head)}
        self.log_count = np.log10(np.array([c for _, c in head], float) + 1)
        self.own = sum(c * OWN >= total for _, c in head)
        self.of = np.array([i if i < self.own else self.own + self.tail(t) for i, (t, _) in enumerate(head)], np.int64)
        self.size = self.own + TAIL

    @staticmethod
    def tail(token: bytes) -> int:
        return zlib.crc32(token[-3:]) % TAIL


def class_stats(counts: DataFrame, classes) -> DataFrame:
    """(g, mass, kinds): training occurrences and distinct tokens of each class."""

    def run(batches):
        for f in batches:
            held = classes.value
            g = [i if (i := held.index.get(t, held.own)) < held.own else held.own + held.tail(t) for t in map(str.encode, f["token"])]
            yield pd.DataFrame({"g": g, "c": f["c"]})

    return counts.mapInPandas(run, "g int, c long").groupBy("g").agg(F.sum("c").alias("mass"), F.count(F.lit(1)).alias("kinds"))


def encoded(docs: DataFrame, classes, log_rest: np.ndarray) -> DataFrame:
    """Written rows: uid, doc_id, held_out, n_tokens, the 16-bit class sequence, the sums over
    frequent tokens, and the other tokens themselves. ``log_rest``: log10(C + T + 1) by class."""

    def run(batches):
        pressed = zstandard.ZstdCompressor(level=1)
        endings: dict[bytes, int] = {}
        for f in batches:
            k = classes.value
            get, out = k.index.get, []
            for t in f["text"]:
                ws = words_of(t)
                ws.append(END)
                at = np.array([get(w, -1) for w in ws], np.int64)
                g = k.of[at] if len(k.of) else np.zeros(len(at), np.int64)
                rare = np.flatnonzero(at < 0)
                tails = [ws[i] for i in rare]
                for i, w in zip(rare, tails, strict=True):
                    e = w[-3:]
                    c = endings.get(e)
                    if c is None:
                        if len(endings) > 200_000:
                            endings.clear()
                        c = endings[e] = k.own + k.tail(w)
                    g[i] = c
                known = at[at >= 0]
                shared = known[k.of[known] >= k.own] if len(known) else known
                out.append(
                    (
                        len(ws),
                        pressed.compress(g.astype("<u2").tobytes()),
                        len(known),
                        float(k.log_count[known].sum()),
                        float(k.log_count[shared].sum() - log_rest[g[g >= k.own]].sum()),
                        [w.decode("utf-8", "surrogatepass") for w in tails],
                    )
                )
            made = pd.DataFrame(out, columns=["n_tokens", "classes", "n_head", "head_log", "within", "tails"])
            yield pd.concat([f[["uid", "doc_id", "held_out"]].reset_index(drop=True), made], axis=1)

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("string").alias("doc_id"), (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "text")
    schema = "uid long, doc_id string, held_out boolean, n_tokens long, classes binary, n_head long, head_log double, within double, tails array<string>"
    return materialize(rows.mapInPandas(run, schema), "sequences")


class HMM:
    """Start, transition and class-emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # (K,), (K, K), (classes, K)

    @classmethod
    def initial(cls, prior: np.ndarray, states: int = STATES, seed: int = SEED) -> "HMM":
        r = np.random.default_rng(seed)
        emit = prior[:, None] * np.exp(r.standard_normal((len(prior), states)))
        move = np.full((states, states), (1 - STICKY) / max(1, states - 1))
        np.fill_diagonal(move, STICKY)
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def log10(self, seqs: list[np.ndarray]) -> np.ndarray:
        """Exact log10 likelihood of whole class sequences, all in step, longest first."""
        n = np.array([len(s) for s in seqs])
        order = np.argsort(-n, kind="stable")
        size, flat = n[order], np.concatenate(seqs) if len(seqs) else np.zeros(0, np.int64)
        begin = np.concatenate(([0], np.cumsum(n)))[:-1][order]
        out, live = np.zeros(len(seqs)), len(seqs)
        a = np.tile(self.start, (len(seqs), 1))
        for t in range(int(size[0]) if len(size) else 0):
            while size[live - 1] <= t:
                live -= 1
            now = (a[:live] @ self.move if t else a[:live]) * self.emit[flat[begin[:live] + t]]
            s = now.sum(1)
            out[order[:live]] += np.log10(s)
            a[:live] = now / s[:, None]
        return out

    def crossed(self, segs: list[np.ndarray], opens: np.ndarray) -> np.ndarray:
        """Of each segment the product of its steps, up to a factor: row i leads from state i before
        the segment (of the first token itself where the segment opens its text) to its last token."""
        k = len(self.start)
        n = np.array([len(s) for s in segs])
        order = np.argsort(-n, kind="stable")
        size, flat = n[order], np.concatenate(segs)
        begin = np.concatenate(([0], np.cumsum(n)))[:-1][order]
        x, live = np.tile(np.eye(k)[:, None], (1, len(segs), 1)), len(segs)  # from state, segment, to state
        x[:, ~opens[order]] = self.move[:, None]
        spare = np.empty_like(x)
        for t in range(int(size[0])):
            while size[live - 1] <= t:
                live -= 1
            now = x[:, :live]
            if t:
                np.matmul(now, self.move, out=spare[:, :live])
                now[:] = spare[:, :live]
            now *= self.emit[flat[begin[:live] + t]]
            if t % 16 == 15:
                now /= now.sum((0, 2))[:, None]
        out = np.empty((len(segs), k, k))
        out[order] = (x / x.sum((0, 2))[:, None]).transpose(1, 0, 2)
        return out

    def borders(self, seqs: list[np.ndarray], length: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Segments of ``length`` tokens with the exact recursion at their borders: ``before``, the
        filtered states of the text just before the segment (zeros where it opens the text), and
        ``after``, the backward vector at its last token, up to a factor (ones where it ends it)."""
        segs = [s[i : i + length] for s in seqs for i in range(0, len(s), length)]
        first = np.concatenate([np.arange(0, len(s), length) == 0 for s in seqs]) if seqs else np.zeros(0, bool)
        before, after = np.zeros((len(segs), len(self.start))), np.ones((len(segs), len(self.start)))
        last = np.append(first[1:], True)
        cut = np.flatnonzero(~(first & last))
        for lo in range(0, len(cut), _AT_ONCE):  # a text's products may lie in two of these
            at = cut[lo : lo + _AT_ONCE]
            step = self.crossed([segs[i] for i in at], first[at])
            if lo == 0:
                products = np.empty((len(cut), *step.shape[1:]))
            products[lo : lo + len(at)] = step
        for j, i in enumerate(cut[:-1]):
            if not last[i]:
                a = (self.start if first[i] else before[i]) @ products[j]
                before[i + 1] = a / a.sum()
        for j in range(len(cut) - 1, 0, -1):
            i = cut[j]
            if not first[i]:
                b = products[j] @ after[i]
                after[i - 1] = b / b.sum()
        return segs, before, after

    def expected(self, seqs: list[np.ndarray], length: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Baum-Welch: expected starts, transitions and emissions of the given whole sequences.

        Sequences of more than ``length`` tokens are cut and their segments run side by side, from
        the exact forward and backward states at the cuts; transitions over the cuts count too."""
        k = len(self.start)
        starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros_like(self.emit)
        segs, before, after = self.borders(seqs, length)
        order = np.argsort([-len(s) for s in segs], kind="stable")
        for lo in range(0, len(order), _AT_ONCE):
            chosen = order[lo : lo + _AT_ONCE]
            some, ahead_of, behind = [segs[i] for i in chosen], after[chosen], before[chosen]
            opens = ~behind.any(1)
            size = np.array([len(s) for s in some])
            b, steps = len(some), int(size[0])
            g = np.zeros((steps, b), np.int64)
            for i, s in enumerate(some):
                g[: len(s), i] = s
            live = [int(np.searchsorted(-size, -t)) for t in range(steps)]  # segments longer than t
            alpha, scale = np.zeros((steps, b, k), np.float32), np.ones((steps, b))
            a = np.where(opens[:, None], self.start, behind @ self.move)
            for t in range(steps):
                m = live[t]
                now = (a[:m] @ self.move if t else a[:m]) * self.emit[g[t, :m]]
                s = now.sum(1)
                a = now / s[:, None]
                alpha[t, :m], scale[t, :m] = a, s
            beta = ahead_of / (alpha[size - 1, np.arange(b)] * ahead_of).sum(1, keepdims=True)
            gamma = np.zeros((steps, b, k), np.float32)
            for t in range(steps - 1, -1, -1):
                m = live[t]
                if t + 1 < steps and live[t + 1]:
                    p = live[t + 1]
                    ahead = self.emit[g[t + 1, :p]] * beta[:p] / scale[t + 1, :p, None]
                    moves += self.move * (alpha[t, :p].T @ ahead)
                    beta[:p] = ahead @ self.move.T
                gamma[t, :m] = alpha[t, :m] * beta[:m]
            starts += gamma[0, opens].sum(0)
            moves += self.move * (behind.T @ (self.emit[g[0]] * beta / scale[0][:, None]))
            on = np.concatenate([g[t, : live[t]] for t in range(steps)])
            weights = np.concatenate([gamma[t, : live[t]] for t in range(steps)])
            for j in range(k):
                emits[:, j] += np.bincount(on, weights=weights[:, j], minlength=len(emits))
        return starts, moves, emits


def train(sequences: DataFrame, prior: np.ndarray, rounds: int = ROUNDS, states: int = STATES) -> HMM:
    """Baum-Welch over every row of ``sequences`` (classes): each partition sums its expected
    counts, Spark adds them up by class, and the few sums make the next model."""
    model, k = HMM.initial(prior, states), states
    cols = [f"s{j}" for j in range(k)]
    for _ in range(rounds):
        held = sequences.sparkSession.sparkContext.broadcast(model)
        summed = sequences.select("classes").mapInPandas(_e_step(held, cols), "g int, " + ", ".join(f"{c} double" for c in cols))
        sums = summed.groupBy("g").agg(*(F.sum(c).alias(c) for c in cols)).toPandas()  # classes + states + 1 rows
        if not len(sums):
            break
        by, v = sums["g"].to_numpy(), sums[cols].to_numpy()
        starts, moves, emits = np.full(k, 1.0), np.full((k, k), 1.0), np.zeros((len(prior), k))
        starts += v[by == -1].sum(0)
        moves[-2 - by[by < -1]] += v[by < -1]
        emits[by[by >= 0]] = v[by >= 0]
        emits += PRIOR * prior[:, None]
        model = HMM(starts / starts.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(0))
    return model


def sequence(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "<u2").astype(np.int64)


def _e_step(held, cols):
    def run(batches):
        total = None
        for f in batches:
            got = held.value.expected([sequence(x) for x in f["classes"]])
            total = got if total is None else tuple(x + y for x, y in zip(total, got, strict=True))
        if total is not None:
            starts, moves, emits = total
            on = np.flatnonzero(emits.any(1))
            out = pd.DataFrame(np.concatenate([starts[None], moves, emits[on]]), columns=cols)
            out.insert(0, "g", np.concatenate([[-1], -2 - np.arange(len(moves)), on]))
            yield out

    return run


def score(docs: DataFrame) -> DataFrame:
    """The contract's columns for every row of ``docs`` (doc_id, text)."""
    sc = docs.sparkSession.sparkContext
    counts = materialize(token_counts(docs.where(fold("doc_id", FOLDS) != HELD_OUT)), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    frequent = F.col("c") * HEAD >= n
    head = [(r["token"].encode("utf-8", "surrogatepass"), r["c"]) for r in counts.where(frequent).collect()]  # at most HEAD
    classes = sc.broadcast(Classes(head, n))
    size = classes.value.size
    mass, kinds = np.zeros(size), np.zeros(size)
    for r in class_stats(counts, classes).collect():  # at most OWN + TAIL
        mass[r["g"]], kinds[r["g"]] = r["mass"], r["kinds"]
    rows = encoded(docs, classes, np.log10(mass + kinds + 1))
    model = train(rows.where("not held_out"), (mass + 1) / (mass + 1).sum())

    held = sc.broadcast(model)
    forward = F.pandas_udf("double")(lambda s: pd.Series(held.value.log10([sequence(x) for x in s]), dtype=float))
    rare = rows.select("uid", F.explode("tails").alias("token")).join(counts.where(~frequent), "token")
    rare = rare.groupBy("uid").agg(F.sum(F.log10(F.col("c") + 1)).alias("rare_log"), F.count(F.lit(1)).alias("n_rare"))
    scored = rows.select("uid", "doc_id", "held_out", "n_tokens", "n_head", "head_log", "within", forward("classes").alias("forward")).join(rare, "uid", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return scored.select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"),
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_log") + rare_log - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"),
        (F.col("forward") + F.col("within") + rare_log).alias("score"),
    )


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
