"""Tests of differences: signed ranks with their probabilities, comparisons in regimes, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelscope.functions.distributions import normal_two_sided, signed_rank_null, student_two_sided
from panelscope.functions.sqlfn import avg_rank
from panelscope.operators.analysis import benjamini_hochberg, holm
from panelscope.operators.resampling import bootstrap_mean
from panelscope.operators.results import mann_kendall
from panelscope.operators.scores import width_growth
from panelscope.sources.storage import stored

#: Differences this small are none.
ZERO = 1e-8


def signed_rank_test(pairs: DataFrame, by: list[str], diff: str = "diff", exact: int = 50) -> DataFrame:
    """(by, n_pairs, n, statistic, z, p_value, method): two-sided Wilcoxon test of ``diff``.

    Zeros are dropped and ties get average ranks; the statistic is the smaller rank sum. Up to
    ``exact`` pairs without zeros or ties p is exact, else normal with the tie-corrected variance.
    Pairs that all agree have p 1.
    """
    d = pairs.where(F.col(diff).isNotNull()).select(*by, F.when(F.abs(diff) <= ZERO, 0.0).otherwise(F.col(diff)).alias("_d"), F.when(F.abs(diff) > ZERO, F.abs(diff)).alias("_a"))
    d = d.withColumn("_r", avg_rank("_a", *by)).withColumn("_t", F.when(F.col("_a").isNotNull(), F.count("_a").over(Window.partitionBy(*by, "_a"))))
    n, t = F.col("n"), F.col("_t")
    g = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count("_a").alias("n"), F.coalesce(F.sum(F.when(F.col("_d") > 0, F.col("_r"))), F.lit(0.0)).alias("_plus"), F.coalesce(F.sum(F.when(F.col("_d") < 0, F.col("_r"))), F.lit(0.0)).alias("_minus"),
        # each row of a tie of t stands for t^2 - 1 of its t^3 - t
        F.coalesce(F.sum(t * t - 1), F.lit(0)).alias("_ties"),
    )
    g = g.withColumn("statistic", F.least("_plus", "_minus"))
    g = g.withColumn("z", F.try_divide(F.col("statistic") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)))
    few = (F.col("n_pairs") <= exact) & (n == F.col("n_pairs")) & (F.col("_ties") == 0)
    chances = F.broadcast(signed_rank_null(pairs.sparkSession, exact))  # ``exact`` rows
    g = g.join(chances.withColumnRenamed("n", "_n"), F.when(few, n) == F.col("_n"), "left")
    p = F.when(n == 0, 1.0).when(few, F.least(2 * F.get("upto", F.col("statistic").cast("int")), F.lit(1.0))).otherwise(normal_two_sided(F.col("z")))
    method = F.when(n == 0, "all_equal").when(few, "exact").otherwise("normal")
    return g.select(*by, "n_pairs", "n", "statistic", "z", p.alias("p_value"), method.alias("method"))


def effects(pairs: DataFrame, by: list[str], family: list[str], diff: str = "diff", unit: str | None = None, draws: int = 0, seed: int = 0, strata: list[str] = ()) -> DataFrame:
    """One row for each contrast (``by``): number of pairs, mean, median, standard error with its 95 %
    interval, signed-rank p, and p corrected within each family after Benjamini and Hochberg; with
    ``draws`` also the percentile interval over ``unit`` drawn within ``strata``."""
    d = stored(pairs.where(F.col(diff).isNotNull()), "pairs")
    se = F.stddev_samp(diff) / F.sqrt(F.count(diff))
    g = d.groupBy(*by).agg(F.avg(diff).alias("mean"), F.percentile(diff, 0.5).alias("median"), se.alias("se"))
    g = g.withColumns({"lower": F.col("mean") - 1.96 * F.col("se"), "upper": F.col("mean") + 1.96 * F.col("se")})
    out = g.join(signed_rank_test(d, by, diff), by)
    if draws:
        out = out.join(bootstrap_mean(d, by, unit, diff, draws, seed, strata).select(*by, "ci_lower", "ci_upper"), by)
    return benjamini_hochberg(out.withColumn("_id", F.concat_ws("|", *by)), "p_value", family, "_id").drop("_id")


def compare_models(events: DataFrame, regime: list[str], model: str, baseline: str, unit: list[str], metric: str, draws: int, seed: int) -> DataFrame:
    """Every model against a baseline in each regime, on the units both have: mean difference with
    its bootstrap interval over units, median, signed-rank p, and p after Holm over all rows."""
    each = events.groupBy(*regime, *unit, model).agg(F.avg(metric).alias("_m"))
    base = each.where(F.col(model) == baseline).select(*regime, *unit, F.col("_m").alias("_b"))
    d = stored(each.where(F.col(model) != baseline).join(base, [*regime, *unit]).withColumn("diff", F.round(F.col("_m") - F.col("_b"), 9)).withColumn("_u", F.concat_ws("|", *unit)), "pairs")
    by = [*regime, model]
    out = bootstrap_mean(d, by, "_u", "diff", draws, seed).select(*by, F.col("estimate").alias("mean_difference"), "ci_lower", "ci_upper")
    out = out.join(d.groupBy(*by).agg(F.percentile("diff", 0.5).alias("median_difference")), by).join(signed_rank_test(d, by).drop("z"), by)
    return holm(out.withColumn("_id", F.concat_ws("|", *by)), "p_value", "_id").drop("_id")


def failure_hypotheses(df: DataFrame, by: list[str], unit: list[str], failed: str, none: str, value: str) -> DataFrame:
    """Each set of failed nodes against the full network on the same units: mean and median loss,
    signed-rank p, and p corrected within ``by``."""
    each = df.groupBy(*by, *unit, failed).agg(F.avg(value).alias("_m"))
    whole = each.where(F.col(failed) == none).select(*by, *unit, F.col("_m").alias("_w"))
    d = each.where(F.col(failed) != none).join(whole, [*by, *unit]).withColumn("diff", F.round(F.col("_m") - F.col("_w"), 9))
    return effects(d, [*by, failed], by)


def trend_test(df: DataFrame, by: list[str], x: str, y: str, alpha: float = 0.05) -> DataFrame:
    """Mann-Kendall with tau, the two-sided p of z, the direction, and whether that is significant."""
    g = mann_kendall(df, by, x, y)
    p = normal_two_sided(F.col("z"))
    way = F.when(F.col("s") > 0, "increasing").when(F.col("s") < 0, "decreasing").otherwise("no_change")
    g = g.withColumns({"tau": F.col("s") / (F.col("n") * (F.col("n") - 1) / 2), "p_value": p, "direction": way})
    return g.withColumn("significant_trend", F.when(F.col("p_value") < alpha, F.col("direction")).otherwise("no_significant_trend"))


def width_growth_test(units: DataFrame, by: list[str], gap: str) -> DataFrame:
    """``width_growth`` with the two-sided p of its rank correlation, from Student's t."""
    g = width_growth(units, by, gap)
    df, r = F.col("gaps") - 2, F.col("spearman")
    t = r * F.sqrt(df / ((1 - r) * (1 + r)))
    p = F.when((df < 1) | r.isNull(), None).when(F.abs(r) >= 1 - 1e-12, 0.0).otherwise(student_two_sided(t, df))
    return g.withColumn("p_value", p)
