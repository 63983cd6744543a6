"""Quality rules with risk-controlled cutoffs.

Each rule is a share that is high in poor texts. Candidate cutoffs are quantiles of each
share over all documents of a stratum, drawn before any label is looked at. A third of the
labelled documents, chosen by a hash of the id, puts the candidates of all rules in one
order: next comes the cutoff that rejects most poor documents for each good one, as long as
it rejects more poor ones than good. The other two thirds are the holdout: cutoffs come into
force in that order while the exact binomial upper bound of the good documents rejected by
any rule stays within ALPHA. Testing along one fixed order spends no error on the many cutoffs and rules; Bonferroni shares it among
the strata, so that in all of them at once, with confidence 1 - DELTA, at most ALPHA of the
good documents are rejected. Strata with too few holdout documents for any cutoff to pass
are pooled and tested as one; for them the bound holds for the pool.

A null text has no words and fails the base rule; shares over nothing are zero; a null
language is a stratum of its own. Labels count once per document, and contradicting ones
not at all. Repeated rows are judged alike. Without labels no rule comes into force.
Columns named ``_ps_...`` are reserved for the operator.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelscope.llm._common import discard, materialize, table

WORD_MIN, REPEAT_PERCENT = 50, 50
ALPHA, DELTA = 0.02, 0.05
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
#: Rule: (numerator, denominator).
RULES = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "long_words": ("word_chars", "n_words")}
#: Candidate cutoffs: those that so large a share of all documents exceeds.
LEVELS = [0.001, 0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.07, 0.1, 0.15, 0.2, 0.25, 0.3]
#: Shares are counted in so many cells of x / (1 + x).
CELLS = 4096
POOL = "*"


def repeated_words(words: list, size: int = 3) -> int:
    """Words that lie in a window of ``size`` words found twice or more in the list."""
    n = len(words)
    if n <= size:
        return 0
    place = dict(zip(words, range(n), strict=True))
    ids = np.fromiter(map(place.__getitem__, words), np.int64, n)
    key = ids[: n - size + 1]
    for k in range(1, size):
        if k > 1 and n > 1 << 20:
            key = np.unique(key, return_inverse=True)[1]
        key = key * n + ids[k : n - size + 1 + k]
    _, inv, cnt = np.unique(key, return_inverse=True, return_counts=True)
    at = np.flatnonzero(cnt[inv] > 1)
    hit = np.zeros(n, bool)
    for k in range(size):
        hit[at + k] = True
    return int(hit.sum())


def stats(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The figures of STATS for one whole text."""
    if text is None:
        return (0, 0, 0, 0, 0, 0)
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    again = sum(n - 1 for n in Counter(lines).values() if n > 1)
    chars = len(text) - sum(map(text.count, _SPACES))
    return len(words), chars, sum(map(text.count, SYMBOLS)), again, repeated_words(words), len(lines)


def with_stats(text_col: str = "text"):
    names = [c.split()[0] for c in STATS.split(", ")]
    return F.pandas_udf(STATS)(lambda s: pd.DataFrame([stats(t) for t in s], columns=names))(text_col)


def upper_bound(k: int, n: int, delta: float) -> float:
    """Exact (Clopper-Pearson) upper confidence bound of a share, k of n seen."""
    if n == 0 or k >= n:
        return 1.0

    def at_most_k(p: float) -> float:  # P(X <= k), summed from its largest terms in logs
        lp, lq = math.log(p), math.log1p(-p)
        terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * lp + (n - i) * lq for i in range(k + 1)]
        top = max(terms)
        return math.exp(top) * sum(math.exp(t - top) for t in terms)

    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if at_most_k(mid) > delta else (lo, mid)
    return hi


def needed(delta: float, alpha: float = ALPHA) -> int:
    """The fewest holdout documents with which a cutoff that rejects none of them can pass."""
    return math.floor(math.log(delta) / math.log1p(-alpha)) + 1


def in_order(tuned: dict[tuple[str, float], tuple[int, int]]) -> list[tuple[str, float]]:
    """Candidates (rule, cutoff) in the order in which they are tested: each rule's from the
    laxest on, and next always those up to the one that adds most poor documents for each good
    one, until none adds more poor ones than good. ``tuned``: poor and good tuning documents that each candidate rejects."""
    left = {r: sorted((c for q, c in tuned if q == r), reverse=True) for r in RULES}
    now, path = dict.fromkeys(RULES, (0, 0)), []

    def gain(r, j):
        poor, good = (x - y for x, y in zip(tuned[r, left[r][j]], now[r], strict=True))
        return (poor / (good + 0.5), poor > good, -j, r)

    while any(left.values()):
        _, worth, j, r = max(gain(r, j) for r in RULES for j in range(len(left[r])))
        if not worth:
            break
        now[r] = tuned[r, left[r][-j]]
        path += [(r, c) for c in left[r][: 1 - j]]
        left[r] = left[r][1 - j :]
    return path


def passed(rejected: list[int], n: int, alpha: float, delta: float) -> int:
    """How many steps of a path come into force, if step i rejects rejected[i] of n good ones in all."""
    for i, k in enumerate(rejected):
        if k > alpha * n or upper_bound(k, n, delta) > alpha:
            return i
    return len(rejected)


def base_failed(s: str = "_ps_stats"):
    c = lambda name: F.col(f"{s}.{name}")
    return (c("n_words") < WORD_MIN) | (100 * c("n_repeat_words") > REPEAT_PERCENT * c("n_words"))


def _share(rule: str, s: str = "_ps_stats"):
    top, below = RULES[rule]
    return F.when(F.col(f"{s}.{below}") > 0, F.col(f"{s}.{top}") / F.col(f"{s}.{below}")).otherwise(0.0)


def _shares():
    return F.array(*(_share(r) for r in RULES))


def labelled(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per labelled document that the base rule passes: stratum, good, tuning, shares."""
    known = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("_hi")).where("q = _hi").select("doc_id", (F.col("q") == 1).alias("good"))
    met = measured.where(~base_failed()).join(known, "doc_id").select("doc_id", "stratum", "good", _shares().alias("shares"))
    once = met.groupBy("doc_id").agg(F.min(F.struct("stratum", "good", "shares")).alias("r")).select("doc_id", "r.*")
    return once.withColumn("tuning", F.pmod(F.xxhash64(F.lit("tuning"), "doc_id"), F.lit(3)) == 0)


def candidates(grouped: DataFrame) -> DataFrame:
    """(stratum, rule, cut): the distinct cutoffs of LEVELS, from counts by cell over all documents."""
    rules = F.explode(F.map_from_arrays(F.lit(list(RULES)), _shares()))
    share = F.least(F.col("x") / (1 + F.col("x")), F.lit(1 - 1e-9))
    counts = grouped.where(~base_failed()).select("stratum", rules.alias("rule", "x")).groupBy("stratum", "rule", F.floor(share * CELLS).alias("cell")).count()
    w = Window.partitionBy("stratum", "rule")  # at most CELLS rows
    above = counts.withColumn("above", F.sum("count").over(w.orderBy(F.desc("cell"))) - F.col("count")).withColumn("all", F.sum("count").over(w))
    edge = (F.col("cell") + 1) / CELLS
    found = above.select("stratum", "rule", "above", "all", "cell", F.explode(F.lit(LEVELS)).alias("level")).where("above <= level * all and above > 0")
    # for each level the lowest cell above whose upper edge lie few enough documents, but some
    return found.groupBy("stratum", "rule", "level").agg(F.min(edge).alias("e")).select("stratum", "rule", (F.col("e") / (1 - F.col("e"))).alias("cut")).distinct()


def thresholds(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum that is tested (``*``: the pool of the others): n (holdout documents),
    rejected (of them), and the cutoff of each rule in force, null if off.

    ``measured``: doc_id, stratum and the struct ``_ps_stats``. What reaches the driver is
    counts: a few dozen for each stratum that has enough labels to be tested by itself.
    """
    spark = measured.sparkSession
    known = materialize(labelled(measured, labels), "labelled")
    good = known.where("good and not tuning").groupBy("stratum").count()
    least = needed(delta / (good.count() + 1), alpha)
    own = [r["stratum"] for r in good.where(F.col("count") >= least).collect()]
    pooled = lambda df: df.withColumn("stratum", F.when(F.col("stratum").isin(own), F.col("stratum")).otherwise(POOL))
    known, cuts = pooled(known), materialize(candidates(pooled(measured)), "candidates")

    place = F.map_from_arrays(F.lit(list(RULES)), F.col("shares"))
    tuned = known.where("tuning").join(F.broadcast(cuts), "stratum").where(F.element_at(place, F.col("rule")) > F.col("cut"))
    seen: dict = {(r["stratum"], r["rule"], r["cut"]): (0, 0) for r in cuts.collect()}
    for r in tuned.groupBy("stratum", "rule", "cut").agg(F.count_if(~F.col("good")).alias("poor"), F.count_if("good").alias("good")).collect():
        seen[r["stratum"], r["rule"], r["cut"]] = (r["poor"], r["good"])
    paths = {s: in_order({(r, c): v for (t, r, c), v in seen.items() if t == s}) for s in {k[0] for k in seen}}

    steps = spark.createDataFrame([(s, [(i, c) for i, c in ((list(RULES).index(r), c) for r, c in p)]) for s, p in sorted(paths.items())], "stratum string, path array<struct<rule:int,cut:double>>")
    over = F.transform("path", lambda p: F.get("shares", p["rule"]) > p["cut"])
    first = known.where("good and not tuning").join(F.broadcast(steps), "stratum").select("stratum", F.array_position(over, True).alias("step"))
    counts: dict = {}
    for r in first.groupBy("stratum", "step").count().collect():
        counts.setdefault(r["stratum"], {})[r["step"]] = r["count"]
    out = []
    for s, by in sorted(counts.items()):
        n, path = sum(by.values()), paths[s]
        rejected = np.cumsum([by.get(i + 1, 0) for i in range(len(path))]).tolist()
        m = passed(rejected, n, alpha, delta / len(counts))
        on = {r: min((c for q, c in path[:m] if q == r), default=None) for r in RULES}
        out.append((s, n, rejected[m - 1] if m else 0, *on.values()))
    discard(cuts)
    return spark.createDataFrame(out, "stratum string, n long, rejected long, " + ", ".join(f"{r} double" for r in RULES))


def judged(measured: DataFrame, cutoffs: DataFrame, stratum: str = "stratum") -> DataFrame:
    """``measured`` plus the boolean ``_ps_kept``: neither the base rule nor a rule in force rejects."""
    cuts = {r["stratum"]: {k: r[k] for k in RULES if r[k] is not None} for r in cutoffs.collect()}  # a row per tested stratum
    rejects = lambda on: reduce(or_, (_share(r) > c for r, c in on.items()), F.lit(False))
    verdict = rejects(cuts.pop(POOL, {}))
    for s, on in cuts.items():
        verdict = F.when(F.col(stratum) == s, rejects(on)).otherwise(verdict)
    return measured.withColumn("_ps_kept", ~base_failed() & ~verdict)


def stratum_of(lang: str = "lang"):
    return F.coalesce(F.concat(F.lit("="), F.col(lang).cast("string")), F.lit("null"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns; texts are measured once."""
    measured = materialize(docs.withColumn("_ps_stats", with_stats()).withColumn("_ps_stratum", stratum_of()), "stats")
    narrow = measured.select("doc_id", F.col("_ps_stratum").alias("stratum"), "_ps_stats")
    return judged(measured, thresholds(narrow, labels), "_ps_stratum").where("_ps_kept").select(*docs.columns)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    measured = materialize(docs.select("doc_id", stratum_of().alias("stratum"), with_stats().alias("_ps_stats")), "stats")
    found = judged(measured, thresholds(measured, table(spark, sf_dir, "labels")))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("doc_id", *(F.col(f"_ps_stats.{n}").alias(n) for n in names), base_failed().alias("base_failed"), F.col("_ps_kept").alias("kept"))
