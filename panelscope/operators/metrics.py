"""Scores of filled cells: only hidden cells with truth and prediction count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelscope.functions.sqlfn import SERIES, avg_rank, safe_corr


def basic(scored: DataFrame, keys: list[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """n, MAE, RMSE, bias, Pearson, Spearman, NRMSE of the cells where both are present."""
    s = scored.where(F.col(truth).isNotNull() & F.col(pred).isNotNull())
    s = s.withColumn("_rt", avg_rank(truth, *keys)).withColumn("_rp", avg_rank(pred, *keys)).withColumn("_e", F.col(pred) - F.col(truth))
    rmse = F.sqrt(F.avg(F.col("_e") * F.col("_e")))
    return s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs("_e")).alias("mae"),
        rmse.alias("rmse"),
        F.avg("_e").alias("bias"),
        safe_corr(truth, pred, 2).alias("pearson"),
        safe_corr("_rt", "_rp", 2).alias("spearman"),
        F.try_divide(rmse, F.stddev_pop(truth)).alias("nrmse"),
    )


def skill(scored: DataFrame, keys: list[str]) -> DataFrame:
    """1 - MAE / MAE of climatology, on the cells that have both predictions."""
    s = scored.where("truth is not null and pred is not null and climatology_pred is not null")
    g = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("pred") - F.col("truth"))).alias("mae"), F.avg(F.abs(F.col("climatology_pred") - F.col("truth"))).alias("mae_clim"))
    return g.withColumn("skill", 1 - F.try_divide("mae", "mae_clim"))


def boundary_jumps(filled: DataFrame) -> DataFrame:
    """Mean |jump| from the observed neighbour into each end of the hidden runs."""
    w = Window.partitionBy(*SERIES).orderBy("ts")
    hidden = F.col("hidden") & F.col("truth").isNotNull()
    left = F.when(hidden & ~F.lag("hidden").over(w), F.abs(F.col("pred") - F.lag("value").over(w)))
    right = F.when(hidden & ~F.lead("hidden").over(w), F.abs(F.col("pred") - F.lead("value").over(w)))
    return filled.withColumn("_l", left).withColumn("_r", right).groupBy(*SERIES).agg(F.avg("_l").alias("jump_left"), F.avg("_r").alias("jump_right"))


def flow(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Nash-Sutcliffe efficiency, percent bias and log error."""
    s = scored.where("truth is not null and pred is not null")
    m = s.groupBy(*keys).agg(
        F.sum(F.pow(F.col("pred") - F.col("truth"), F.lit(2))).alias("sse"),
        (F.var_pop("truth") * F.count(F.lit(1))).alias("sst"),
        F.sum(F.col("pred") - F.col("truth")).alias("d"),
        F.sum("truth").alias("t"),
        F.avg(F.abs(F.log1p(F.greatest("pred", F.lit(0.0))) - F.log1p(F.greatest("truth", F.lit(0.0))))).alias("log_mae"),
    )
    return m.select(*keys, (1 - F.try_divide("sse", "sst")).alias("nse"), (100 * F.try_divide("d", "t")).alias("pbias"), "log_mae")


def pinball(truth: str, pred: str, q: float) -> Column:
    e = F.col(truth) - F.col(pred)
    return F.avg(F.greatest(q * e, (q - 1) * e))


def intervals(scored: DataFrame, keys: list[str], truth: str, lo: str, hi: str) -> DataFrame:
    """Coverage and width of intervals whose bounds may be crossed."""
    a, b = F.least(lo, hi), F.greatest(lo, hi)
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(truth).between(a, b).cast("int")).alias("coverage"), F.avg(b - a).alias("width"), F.avg((F.col(lo) > F.col(hi)).cast("int")).alias("crossing_rate")
    )


def sen_slope(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Median slope over all pairs of points of a key; one point per x."""
    o = df.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"))
    p = df.join(o, keys).where(F.col(x) < F.col("_x"))
    return p.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), F.percentile((F.col("_y") - F.col(y)) / (F.col("_x") - F.col(x)), 0.5).alias("slope"))
