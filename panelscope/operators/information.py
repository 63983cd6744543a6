"""Mutual information by nearest neighbours, transfer entropy of many hypotheses, and their table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelscope.functions.sqlfn import hash_rank
from panelscope.sources.storage import stored

#: Scaled values are held as whole multiples of 1/UNIT standard deviations, so that distances are
#: exact and a neighbour at a distance is never also within it.
UNIT = 10**9


def digamma(n: Column) -> Column:
    """Of positive whole numbers: by its series ten steps on, which leaves less than 1e-13."""
    z = n.cast("double") + 10
    series = F.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6)
    steps = sum((1 / (n.cast("double") + i) for i in range(10)), F.lit(0.0))
    return series - steps


def kth_distance(points: DataFrame, by: list[str], k: int) -> DataFrame:
    """(by, u, v, times, r): of each distinct point (whole u, v, ``times`` it occurs) the larger of
    the two coordinate distances to its k-th nearest other point.

    In rounds: points are cells of a grid, and a point whose own and eight surrounding cells hold k
    others within one cell's width is done; the rest go on with cells twice as wide. Copies of a
    point are one row, so crowds of equal points cost nothing. The first width has about k points
    to a cell.
    """
    size = points.groupBy(*by).agg(F.sum("times").alias("_n"), F.greatest(F.max("u") - F.min("u"), F.max("v") - F.min("v"), F.lit(1)).alias("_span"))
    first = F.greatest(F.ceil(F.col("_span") * F.sqrt(F.lit(float(k)) / F.col("_n"))), F.lit(1)).cast("long")
    rows = stored(points.join(size.where(F.col("_n") > k), by).select(*by, "u", "v", "times", "_span", first.alias("_w")), "points")
    todo, done, wide = rows, [], 1
    while True:
        cell = lambda c: F.floor(F.col(c) / F.col("_w")).cast("long")
        width = F.col("_w") * wide
        home = rows.select(*by, F.col("u").alias("_u"), F.col("v").alias("_v"), F.col("times").alias("_t"), width.alias("_w")).withColumns({"_a": cell("_u"), "_b": cell("_v")}).drop("_w")
        near = todo.withColumn("_w", width).withColumns({"_a": cell("u"), "_b": cell("v")})
        for c in ("_a", "_b"):
            near = near.withColumn("_o", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn(c, F.col(c) + F.col("_o")).drop("_o")
        d = F.greatest(F.abs(F.col("u") - F.col("_u")), F.abs(F.col("v") - F.col("_v")))
        met = near.join(home, [*by, "_a", "_b"]).withColumn("_d", d).where(F.col("_d") <= F.col("_w"))
        # the point itself is one of its copies
        met = met.withColumn("_t", F.col("_t") - (F.col("_d") == 0).cast("long"))
        upto = F.sum("_t").over(Window.partitionBy(*by, "u", "v").orderBy("_d"))
        found = met.withColumn("_c", upto).where(F.col("_c") >= k).groupBy(*by, "u", "v", "times").agg(F.min("_d").alias("r"))
        found = stored(found, "neighbours")
        done.append(found)
        todo = stored(todo.join(found, [*by, "u", "v"], "left_anti"), "points")
        if todo.isEmpty():
            break
        wide *= 2
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _within(points: DataFrame, by: list[str], c: str) -> DataFrame:
    """(by, u, v, n_c): how many other points lie strictly within r in one coordinate, by running
    counts over the points and both borders of every point's interval, in order."""
    edge = lambda at, rank, of: F.struct(at.alias("at"), F.lit(rank).alias("rank"), F.lit(of).alias("of"))
    x, r = F.col(c), F.col("r")
    # borders are open, so at equal places the upper one comes before the points and the lower after; a radius of zero takes the point's equals
    upper = F.struct((x + r).alias("at"), F.when(r == 0, 2).otherwise(0).alias("rank"), F.lit(1).alias("of"))
    lower = F.struct((x - r).alias("at"), F.when(r == 0, 0).otherwise(2).alias("rank"), F.lit(-1).alias("of"))
    rows = points.select(*by, "u", "v", "times", F.explode(F.array(edge(x, 1, 0), upper, lower)).alias("e"))
    order = Window.partitionBy(*by).orderBy("e.at", "e.rank").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("_run", F.sum(F.when(F.col("e.of") == 0, F.col("times")).otherwise(0)).over(order))
    return run.where("e.of <> 0").groupBy(*by, "u", "v").agg((F.sum(F.col("e.of") * F.col("_run")) - 1).alias(f"n_{c}"))


def mutual_information(df: DataFrame, by: list[str], x: str, y: str, k: int = 5) -> DataFrame:
    """(by, n, mi): information between two continuous columns, in nats, from the distances to the
    k-th neighbours: digamma(n) + digamma(k) less the mean digamma of both counts within them.
    Columns are scaled by their standard deviation; never below zero; null for k rows or fewer or
    a constant column."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    scale = ok.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(x).alias("_sx"), F.stddev_pop(y).alias("_sy"))
    whole = lambda c, s: F.round(F.col(c) / F.col(s) * UNIT).cast("long")
    p = ok.join(scale.where("_sx > 0 and _sy > 0"), by).select(*by, whole(x, "_sx").alias("u"), whole(y, "_sy").alias("v"))
    p = stored(p.groupBy(*by, "u", "v").agg(F.count(F.lit(1)).alias("times")), "pairs")
    far = stored(kth_distance(p, by, k), "radii")
    both = far.join(_within(far, by, "u"), [*by, "u", "v"]).join(_within(far, by, "v"), [*by, "u", "v"])
    own = both.groupBy(*by).agg(F.sum(F.col("times") * (digamma(F.col("n_u") + 1) + digamma(F.col("n_v") + 1))).alias("_s"))
    mi = digamma(F.col("n")) + digamma(F.lit(k)) - F.col("_s") / F.col("n")
    return scale.join(own, by, "left").select(*by, "n", F.when(F.col("_s").isNotNull(), F.greatest(mi, F.lit(0.0))).alias("mi"))


def _entropy(s: np.ndarray, p: np.ndarray, y: np.ndarray, k: int) -> float:
    """Transfer entropy by counting labels of 0 to k - 1."""
    n = len(y)
    joint = np.bincount((y * k + p) * k + s, minlength=k**3).reshape(k, k, k)
    ps, yp, past = joint.sum(0), joint.sum(2), joint.sum((0, 2))
    a, b, c = np.nonzero(joint)
    m = joint[a, b, c]
    return max(0.0, float((m / n * np.log(m * past[b] / (ps[b, c] * yp[a, b]))).sum()))


def _against_shifts(s: np.ndarray, y: np.ndarray, lag: int, shifts: list[int], k: int) -> tuple:
    """te, n, null_mean, null_std, z, p_value of labels (-1: none) against shifted sources."""

    def te(x):
        src, past, now = x[: len(y) - lag], y[lag - 1 : -1], y[lag:]
        ok = (src >= 0) & (past >= 0) & (now >= 0)
        return (_entropy(src[ok], past[ok], now[ok], k) if ok.any() else np.nan), int(ok.sum())

    if len(y) <= lag:
        return None, 0, None, None, None, None
    own, n = te(s)
    if not np.isfinite(own) or len(set(s[s >= 0])) < 2 or len(set(y[y >= 0])) < 2:
        return None, n, None, None, None, None
    null = np.array([te(np.roll(s, h))[0] for h in shifts])
    mean, std = float(null.mean()), float(null.std())
    return own, n, mean, std, (own - mean) / std if std > 0 else None, (1 + int((null >= own - 1e-12).sum())) / (len(null) + 1)


def entropies(hypotheses: DataFrame, source: str, target: str, lag: str, shifts: str, bins: int) -> DataFrame:
    """``hypotheses`` with te, n, null_mean, null_std, z and p_value. Each row holds the label arrays
    of two series on one calendar, a lag and the shifts of its null: a row is one small numpy
    task, and Spark spreads the rows."""
    schema = "te double, n long, null_mean double, null_std double, z double, p_value double"

    @F.pandas_udf(schema)
    def test(s: pd.Series, t: pd.Series, d: pd.Series, h: pd.Series) -> pd.DataFrame:
        rows = [_against_shifts(np.asarray(a, np.int64), np.asarray(b, np.int64), int(g), list(x), bins) for a, b, g, x in zip(s, t, d, h, strict=True)]
        return pd.DataFrame(rows, columns=["te", "n", "null_mean", "null_std", "z", "p_value"]).astype({"n": "int64"}).astype({c: float for c in ("te", "null_mean", "null_std", "z", "p_value")})

    return hypotheses.withColumn("_r", test(source, target, lag, shifts)).select(*hypotheses.columns, "_r.*")


def label_series(bins: DataFrame, by: list[str], date: str, label: str) -> DataFrame:
    """(by, labels): each series' labels in the order of the calendar, -1 where there is none."""
    rows = bins.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(date, F.coalesce(F.col(label), F.lit(-1)).cast("int").alias("b")))).alias("_l"))
    return rows.select(*by, F.transform("_l", lambda x: x["b"]).alias("labels"))


def random_shifts(n: Column, draws: int, seed: int, *keys: str) -> Column:
    """``draws`` shifts of 1 to n - 1 for each row, by hash of its keys."""
    key = hash_rank(F.lit(str(seed)), *keys)
    return F.transform(F.sequence(F.lit(1), F.lit(draws)), lambda d: 1 + F.pmod(F.xxhash64(key, d), F.greatest(n - 1, F.lit(1))))


def source_list(series: DataFrame, target: str) -> DataFrame:
    """(entity, source_entity, source_variable, information_group): for the target variable of each
    entity its own other variables (B) and all variables of the other entities (C)."""
    t = series.where(F.col("variable") == target).select("entity")
    # the list itself is the result: every target with every series; it has no other key than that
    every = series.agg(F.collect_set(F.struct(F.col("entity").alias("source_entity"), F.col("variable").alias("source_variable"))).alias("_s"))  # one row
    pairs = t.crossJoin(F.broadcast(every)).select("entity", F.explode("_s").alias("s")).select("entity", "s.*")
    own = F.col("entity") == F.col("source_entity")
    return pairs.where(~(own & (F.col("source_variable") == target))).withColumn("information_group", F.when(own, "B").otherwise("C"))


def information_table(anomalies: DataFrame, target: str, k: int = 5, lags: tuple[int, ...] = (1, 2, 3, 7), draws: int = 199, bins: int = 4, seed: int = 11) -> DataFrame:
    """Training-only information about a target variable from each series of ``source_list``:
    neighbour mutual information, and transfer entropy both ways at each lag with its shift null.

    ``anomalies``: entity, variable, ts, x on one calendar, training days only; x is null where
    there is nothing. A transfer hypothesis that two rows share (two targets, each other's source)
    is tested once, marked on the second, and counts once in the Benjamini-Hochberg correction.
    """
    from panelscope.operators.analysis import benjamini_hochberg
    from panelscope.operators.results import discretise

    a = stored(anomalies.select("entity", "variable", "ts", "x"), "anomalies")
    specs = stored(source_list(a.select("entity", "variable").distinct(), target), "sources")
    own = a.where(F.col("variable") == target).select("entity", "ts", F.col("x").alias("y"))
    given = a.select(F.col("entity").alias("source_entity"), F.col("variable").alias("source_variable"), "ts", "x").where("x is not null")
    key = ["entity", "source_entity", "source_variable"]
    mi = mutual_information(specs.join(own, "entity").join(given, ["source_entity", "source_variable", "ts"]), key, "x", "y", k)

    labels = a.join(discretise(a.where("x is not null"), ["entity", "variable"], "x", bins).select("entity", "variable", "ts", "bin"), ["entity", "variable", "ts"], "left")
    lines = stored(label_series(labels, ["entity", "variable"], "ts", "bin"), "labels")
    forth = F.struct(F.lit("source_to_target").alias("direction"), F.col("source_entity").alias("from_entity"), F.col("source_variable").alias("from_variable"), F.col("entity").alias("to_entity"), F.lit(target).alias("to_variable"))
    back = F.struct(F.lit("target_to_source").alias("direction"), F.col("entity").alias("from_entity"), F.lit(target).alias("from_variable"), F.col("source_entity").alias("to_entity"), F.col("source_variable").alias("to_variable"))
    asked = specs.select(*key, F.explode(F.array(forth, back)).alias("d")).select(*key, "d.*").withColumn("lag", F.explode(F.lit([*lags])))
    name = ["from_entity", "from_variable", "to_entity", "to_variable", "lag"]
    end = lambda e: lines.select(F.col("entity").alias(f"{e}_entity"), F.col("variable").alias(f"{e}_variable"), F.col("labels").alias(f"_{e}"))
    tests = asked.select(*name).distinct().join(end("from"), ["from_entity", "from_variable"]).join(end("to"), ["to_entity", "to_variable"])
    tests = tests.withColumn("_shifts", random_shifts(F.size("_to").cast("long"), draws, seed, *name)).repartition(*name)
    done = stored(entropies(tests, "_from", "_to", "lag", "_shifts", bins).drop("_from", "_to", "_shifts"), "entropies")
    done = done.withColumns({"hypothesis_id": F.concat_ws("|", *name), "family": F.lit("transfer_entropy")})
    adjusted = benjamini_hochberg(done, "p_value", ["family"], "hypothesis_id").select("hypothesis_id", "q_bh")
    first = F.row_number().over(Window.partitionBy("hypothesis_id").orderBy(*key, "direction"))
    te = asked.join(done, name).join(adjusted, "hypothesis_id", "left").withColumn("hypothesis_duplicate", first > 1)
    te = te.select(*key, F.lit("transfer_entropy").alias("metric"), "direction", "lag", F.col("te").alias("estimate"), "n", "null_mean", "null_std", "z", "p_value", F.col("q_bh").alias("p_adjusted"), "hypothesis_duplicate")
    both = te.unionByName(mi.select(*key, F.lit("mutual_information").alias("metric"), F.lit("symmetric").alias("direction"), F.lit(None).cast("int").alias("lag"), F.col("mi").alias("estimate"), "n", F.lit(False).alias("hypothesis_duplicate")), allowMissingColumns=True)
    return both.join(specs, key)
