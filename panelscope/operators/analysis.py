"""Comparison, multiplicity, frontiers, information value, networks, overlap, ranking, contracts."""

from __future__ import annotations

from math import factorial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelscope.functions.sqlfn import avg_rank
from panelscope.operators.resampling import monotone


def paired(df: DataFrame, unit: list[str], model: str, a: str, b: str, metric: str) -> DataFrame:
    """Two models on the units both have, replicates averaged: unit, a, b, diff."""
    side = lambda m, out: F.avg(F.when(F.col(model) == m, F.col(metric))).alias(out)
    g = df.where(F.col(model).isin(a, b)).groupBy(*unit).agg(side(a, "a"), side(b, "b")).where("a is not null and b is not null")
    return g.withColumn("diff", F.col("a") - F.col("b"))


def signed_rank(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Wilcoxon signed-rank sums of ``diff`` with average ranks, zeros dropped, and the z value
    with the tie-corrected variance."""
    nz = pairs.where("diff <> 0").withColumn("_a", F.abs("diff"))
    r = nz.withColumn("_r", avg_rank("_a", *by))
    ties = nz.groupBy(*by, "_a").agg(F.count(F.lit(1)).alias("t")).groupBy(*by).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("tie"))
    g = r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("diff") > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("diff") < 0, F.col("_r")).otherwise(0.0)).alias("w_minus"))
    n = F.col("n")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("tie") / 48
    return g.join(ties, by).withColumn("z", F.try_divide(F.col("w_plus") - n * (n + 1) / 4, F.sqrt(var))).drop("tie")


def holm(df: DataFrame, p: str, key: str) -> DataFrame:
    """Holm-adjusted p over one table of hypotheses (small by nature); nulls stay null."""
    w = Window.partitionBy(F.col(p).isNull()).orderBy(p, key)
    m = F.count(p).over(Window.partitionBy(F.col(p).isNull()))
    step = df.withColumn("_s", F.least((m - F.row_number().over(w) + 1) * F.col(p), F.lit(1.0)))
    return step.withColumn("p_holm", F.when(F.col(p).isNotNull(), F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")


def benjamini_hochberg(df: DataFrame, p: str, family: list[str], key: str) -> DataFrame:
    base = df.where(F.col(p).isNotNull())
    k, m = F.row_number().over(Window.partitionBy(*family).orderBy(p, key)), F.count(F.lit(1)).over(Window.partitionBy(*family))
    s = base.withColumn("_k", k).withColumn("_s", F.col(p) * m / F.col("_k"))
    w = Window.partitionBy(*family).orderBy(F.col("_k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return s.withColumn("q_bh", F.least(F.min("_s").over(w), F.lit(1.0))).drop("_k", "_s")


def standardised_difference(df: DataFrame, by: list[str], role: str, a: str, b: str, value: str) -> DataFrame:
    side = lambda f, m: f(F.when(F.col(role) == m, F.col(value)))
    g = df.groupBy(*by).agg(side(F.avg, a).alias("ma"), side(F.avg, b).alias("mb"), side(F.stddev_samp, a).alias("sa"), side(F.stddev_samp, b).alias("sb"))
    return g.select(*by, F.try_divide(F.col("ma") - F.col("mb"), F.sqrt((F.col("sa") * F.col("sa") + F.col("sb") * F.col("sb")) / 2)).alias("smd"))


def guarded_skill(df: DataFrame, mae: str, denominator: str, floor: float) -> DataFrame:
    """Skill, withheld where the denominator is at most half the measurement resolution."""
    ok = F.col(denominator) > floor / 2
    status = F.when(F.col(denominator).isNull(), "no_baseline").when(~ok, "withheld").otherwise("ok")
    return df.withColumn("skill", F.when(ok, 1 - F.try_divide(F.col(mae).cast("double"), F.col(denominator).cast("double")))).withColumn("skill_status", status)


def first_loss(curve: DataFrame, by: list[str], gap: str, skill: str, threshold: float) -> DataFrame:
    """The gap length at which the running minimum of skill first reaches the threshold, by
    straight line between tested gaps; 0 if lost at the first, the last gap if never lost."""
    w = Window.partitionBy(*by).orderBy(gap)
    c = curve.withColumn("_m", F.min(skill).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    c = c.withColumn("_pm", F.lag("_m").over(w)).withColumn("_pg", F.lag(gap).over(w))
    at = F.col("_pg") + (F.col(gap) - F.col("_pg")) * F.try_divide(F.col("_pm") - threshold, F.col("_pm") - F.col("_m"))
    lost = F.when(F.col("_m") <= threshold, F.struct(F.col(gap).cast("double").alias("g"), F.coalesce(at, F.lit(0.0)).alias("at"), F.col("_pg").isNull().alias("left")))
    g = c.groupBy(*by).agg(F.min(lost).alias("f"), F.max(gap).alias("last"))
    return g.select(
        *by,
        F.coalesce("f.at", F.col("last").cast("double")).alias("frontier"),
        F.when(F.col("f").isNull(), "right").when(F.col("f.left"), "left").otherwise("none").alias("censoring"),
    )


def pava(curve: DataFrame, by: list[str], x: str, y: str, weight: str) -> DataFrame:
    """``curve`` with ``fit``, its weighted non-increasing fit, and the number of the ``block`` of
    gaps that share one, to nine digits: blocks of one mean may differ in the last bit of their sums.
    A curve is an array: its gaps are few."""
    lines = curve.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(x, F.col(y).cast("double").alias("v"), F.col(weight).cast("double").alias("w")))).alias("_c"))
    lines = lines.withColumns({"_v": F.transform("_c", lambda c: c["v"]), "_w": F.transform("_c", lambda c: c["w"])})
    lines = lines.withColumn("_f", F.transform(monotone("_v", "_w"), lambda z: z["fit"])).withColumn("_d", F.array_distinct(F.transform("_f", lambda f: F.round(f, 9))))
    fit = lines.select(*by, "_d", F.explode(F.arrays_zip("_c", "_f")).alias("z"))
    block = F.array_position("_d", F.round("z._f", 9)) - 1
    return curve.join(fit.select(*by, F.col(f"z._c.{x}").alias(x), F.col("z._f").alias("fit"), block.cast("long").alias("block")), [*by, x])


def shapley(values: DataFrame, by: list[str], mask: str, value: str, players: int) -> DataFrame:
    """Exact Shapley value of each player from the values of all 2^players coalitions."""
    weight = [factorial(k) * factorial(players - k - 1) / factorial(players) for k in range(players)]
    v = values.withColumn("player", F.explode(F.sequence(F.lit(0), F.lit(players - 1)))).withColumn("_bit", F.pow(F.lit(2), F.col("player")).cast("long"))
    without = v.where(F.col(mask).bitwiseAND(F.col("_bit")) == 0).withColumn("_with", F.col(mask) + F.col("_bit"))
    o = values.select(*by, F.col(mask).alias("_with"), F.col(value).alias("_v1"))
    met = without.join(o, [*by, "_with"])
    w = F.element_at(F.lit(weight), F.bit_count(F.col(mask)) + 1)
    return met.groupBy(*by, "player").agg(F.sum(w * (F.col("_v1") - F.col(value))).alias("shapley"), F.avg(F.col("_v1") - F.col(value)).alias("mean_marginal"))


def resilience(df: DataFrame, by: list[str], fraction: str, value: str) -> DataFrame:
    """Mean by failed fraction relative to none failed (null if that is not positive), and the
    trapezoid area under the curve if it spans 0 to 1."""
    c = df.groupBy(*by, fraction).agg(F.avg(value).alias("mean"))
    ref = F.max(F.when(F.col(fraction) == 0, F.col("mean"))).over(Window.partitionBy(*by))
    c = c.withColumn("relative", F.when(ref > 0, F.col("mean") / ref))
    w = Window.partitionBy(*by).orderBy(fraction)
    c = c.withColumn("_a", (F.lead(fraction).over(w) - F.col(fraction)) * (F.lead("relative").over(w) + F.col("relative")) / 2)
    area = c.groupBy(*by).agg(F.sum("_a").alias("s"), F.min(fraction).alias("lo"), F.max(fraction).alias("hi"))
    return area.select(*by, F.when((F.col("lo") == 0) & (F.col("hi") == 1), F.col("s")).alias("area"))


def interval_overlaps(iv: DataFrame) -> DataFrame:
    """Overlapping pairs of an entity's intervals with shared days and Jaccard index. Intervals
    meet by day bins, so that the range condition rides on an equi-join."""
    bins = F.explode(F.sequence(F.floor(F.unix_date("start_date") / 32), F.floor(F.unix_date("end_date") / 32)))
    a = iv.withColumn("_bin", bins)
    b = a.select(F.col("entity"), F.col("_bin"), F.col("interval_id").alias("other_id"), F.col("start_date").alias("s2"), F.col("end_date").alias("e2"))
    met = a.join(b, ["entity", "_bin"]).where("interval_id < other_id and start_date <= e2 and s2 <= end_date")
    met = met.where(F.col("_bin") == F.floor(F.unix_date(F.greatest("start_date", "s2")) / 32))  # in one bin only
    shared = F.datediff(F.least("end_date", "e2"), F.greatest("start_date", "s2")) + 1
    total = F.datediff("end_date", "start_date") + 1 + F.datediff("e2", "s2") + 1 - shared
    return met.select("entity", "interval_id", "other_id", shared.cast("long").alias("overlap_days"), (shared / total).alias("jaccard"))


def interval_clusters(iv: DataFrame) -> DataFrame:
    """Connected components of an entity's intervals (islands), with their size and days."""
    w = Window.partitionBy("entity").orderBy("start_date", "interval_id")
    reach = F.max("end_date").over(w.rowsBetween(Window.unboundedPreceding, -1))
    c = iv.withColumn("_new", F.when(F.col("start_date") <= reach, 0).otherwise(1)).withColumn("cluster", F.sum("_new").over(w))
    return c.groupBy("entity", "cluster").agg(F.count(F.lit(1)).alias("n_intervals"), F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"))


def effective_cells(iv: DataFrame) -> DataFrame:
    """Per interval: its days, each shared by how many intervals of the entity: sum of 1/k, days alone."""
    cells = iv.select("entity", "interval_id", F.explode(F.sequence("start_date", "end_date")).alias("day"))
    k = F.count(F.lit(1)).over(Window.partitionBy("entity", "day"))
    g = cells.withColumn("_k", k).groupBy("entity", "interval_id")
    return g.agg(F.count(F.lit(1)).alias("n_days"), F.sum(1 / F.col("_k")).alias("effective_days"), F.count_if(F.col("_k") == 1).alias("exclusive_days"))


def rank_models(df: DataFrame, model: str, stratum: str, unit: list[str], seed: str, metric: str) -> DataFrame:
    """Seed means, then unit means, then equal-weight means of strata; lower is better, ties by name."""
    s = df.groupBy(model, stratum, *unit, seed).agg(F.avg(metric).alias("m"))
    u = s.groupBy(model, stratum, *unit).agg(F.avg("m").alias("m"))
    t = u.groupBy(model, stratum).agg(F.avg("m").alias("m")).groupBy(model).agg(F.round(F.avg("m"), 9).alias("score"), F.max("m").alias("worst"))
    return t.withColumn("rank", F.row_number().over(Window.orderBy("score", model)).cast("long"))


def missing_from_grid(df: DataFrame, keys: list[list[str]]) -> DataFrame:
    """Combinations of the values of each key group that the table lacks; the values are few."""
    grid = df.select(*keys[0]).distinct()
    for k in keys[1:]:
        grid = grid.crossJoin(df.select(*k).distinct())  # Spark broadcasts a side only if it is small
    return grid.join(df, [c for k in keys for c in k], "left_anti")


def contract(df: DataFrame, key: list[str], not_null: list[str], finite: list[str]) -> DataFrame:
    """One row per expectation with its number of violations."""
    dup = df.groupBy(*key).count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unique_key").alias("check"), "n")
    bad = df.agg(*(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in not_null), *(F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))).alias(f"infinite_{c}") for c in finite))
    cols = bad.columns
    return dup.unionByName(bad.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, cols)), F.array(*cols))).alias("check", "n")))
