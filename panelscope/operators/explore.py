"""Window-style and exploratory analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelscope.functions.sqlfn import SERIES, avg_rank, doy366, safe_corr, season


def seasonal_anomaly(panel: DataFrame) -> DataFrame:
    """Value less the training median of its month and day, or of the series where that has none."""
    train = panel.where("split = 'train' and value is not null")
    by_day = train.groupBy(*SERIES, F.date_format("ts", "MM-dd").alias("md")).agg(F.percentile("value", 0.5).alias("m_day"))
    overall = train.groupBy(*SERIES).agg(F.percentile("value", 0.5).alias("m_all"))
    met = panel.withColumn("md", F.date_format("ts", "MM-dd")).join(by_day, [*SERIES, "md"], "left").join(overall, SERIES, "left")
    return met.withColumn("anomaly", F.col("value") - F.coalesce("m_day", "m_all")).drop("md", "m_day", "m_all")


def mean_anomaly(panel: DataFrame) -> DataFrame:
    """Value less the training mean of its day on the leap calendar."""
    day = doy366("ts")
    w = Window.partitionBy(*SERIES, day)
    return panel.withColumn("anomaly", F.col("value") - F.avg(F.when(F.col("split") == "train", F.col("value"))).over(w))


def steps(panel: DataFrame) -> DataFrame:
    """Days whose change exceeds the 99th percentile of training changes."""
    w = Window.partitionBy(*SERIES).orderBy("ts")
    d = panel.withColumn("delta", F.col("value") - F.lag("value").over(w)).withColumn("_both", (F.col("split") == "train") & (F.lag("split").over(w) == "train"))
    q = d.where("_both and delta is not null").groupBy(*SERIES).agg(F.percentile(F.abs("delta"), 0.99).alias("threshold"))
    return d.join(q, SERIES).where("abs(delta) > threshold").select(*SERIES, "ts", "delta", "threshold")


def anomaly_by_season(panel: DataFrame) -> DataFrame:
    a = seasonal_anomaly(panel).withColumn("season", season("ts"))
    return a.groupBy(*SERIES, "season").agg(F.count("anomaly").alias("n"), F.avg("anomaly").alias("mean_anomaly"), F.stddev_samp("anomaly").alias("std_anomaly"))


def lag_pairs(df: DataFrame, lags: list[int], value: str = "value") -> DataFrame:
    """Equi self-join of a series with itself ``lag`` days later; lags are a small literal list."""
    left = df.select(*SERIES, F.col("ts"), F.col(value).alias("x"), F.explode(F.lit(lags)).alias("lag")).withColumn("at", F.expr("date_add(ts, lag)"))
    right = df.select(*SERIES, F.col("ts").alias("at"), F.col(value).alias("y"))
    return left.join(right, [*SERIES, "at"]).select(*SERIES, "lag", "x", "y")


def autocorrelation(panel: DataFrame, lags: list[int]) -> DataFrame:
    g = lag_pairs(panel.where("value is not null"), lags).groupBy(*SERIES, "lag")
    return g.agg(F.count(F.lit(1)).alias("n"), safe_corr("x", "y").alias("acf"))


def pair_correlations(panel: DataFrame) -> DataFrame:
    """Pearson and Spearman correlation of each pair of variables of an entity, in training."""
    t = panel.where("split = 'train' and value is not null").select("entity", "ts", "variable", "value")
    o = t.select("entity", "ts", F.col("variable").alias("other"), F.col("value").alias("y"))
    p = t.join(o, ["entity", "ts"]).where("variable < other").withColumnRenamed("value", "x")
    keys = ["entity", "variable", "other"]
    r = p.withColumn("rx", avg_rank("x", *keys)).withColumn("ry", avg_rank("y", *keys))
    return r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), safe_corr("x", "y").alias("pearson"), safe_corr("rx", "ry").alias("spearman"))


def best_lags(panel: DataFrame, variable: str, span: int) -> DataFrame:
    """For each ordered pair of entities, the lag in -span..span with the largest |correlation|."""
    t = panel.where((F.col("variable") == variable) & (F.col("split") == "train") & F.col("value").isNotNull()).select("entity", "ts", "value")
    src = t.select(F.col("entity").alias("source"), "value", F.explode(F.sequence(F.lit(-span), F.lit(span))).alias("lag"), "ts").withColumn("ts", F.expr("date_add(ts, lag)"))
    met = src.withColumnRenamed("value", "x").join(t.withColumnRenamed("entity", "target").withColumnRenamed("value", "y"), "ts").where("source <> target")
    c = met.groupBy("source", "target", "lag").agg(F.count(F.lit(1)).alias("n"), F.round(safe_corr("x", "y"), 9).alias("r"))
    w = Window.partitionBy("source", "target").orderBy(F.abs("r").desc_nulls_last(), F.abs("lag"), F.col("lag").desc())
    return c.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def days_since_observed(panel: DataFrame) -> DataFrame:
    w = Window.partitionBy(*SERIES).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("observed"), F.col("ts")), ignorenulls=True).over(w)
    return panel.withColumn("days_since", F.coalesce(F.datediff("ts", last), F.lit(-1)).cast("long"))


def gap_distance(panel: DataFrame, cap: int) -> DataFrame:
    """Days to the previous and next observation, at most ``cap`` (also where there is none)."""
    order = Window.partitionBy(*SERIES).orderBy("ts")
    seen = F.when(F.col("observed"), F.col("ts"))
    before = F.last(seen, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(seen, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    to = lambda d: F.least(F.coalesce(d, F.lit(cap)), F.lit(cap)).cast("long")
    return panel.withColumn("to_previous", to(F.datediff("ts", before))).withColumn("to_next", to(F.datediff(after, "ts")))


def block_starts(panel: DataFrame, length: int) -> DataFrame:
    """Days from which ``length`` days in a row are all observed; the calendar is complete."""
    w = Window.partitionBy(*SERIES).orderBy("ts").rowsBetween(0, length - 1)
    return panel.withColumn("_n", F.sum(F.col("observed").cast("int")).over(w)).where(F.col("_n") == length).select(*SERIES, "ts")


def merge_runs(runs: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Join runs at most ``gap`` days apart; how many were joined, and their days."""
    w = Window.partitionBy(*keys).orderBy("start_date")
    far = F.coalesce(F.datediff("start_date", F.lag("end_date").over(w)) - 1 > gap, F.lit(True))
    g = runs.withColumn("_far", far.cast("int")).withColumn("_g", F.sum("_far").over(w))
    return g.groupBy(*keys, "_g").agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"), F.count(F.lit(1)).alias("n_runs"), F.sum("n_days").alias("n_days")).drop("_g")
