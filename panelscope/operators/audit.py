"""Audits and descriptive aggregations of a prepared panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelscope.functions.sqlfn import SERIES, islands


def series_summary(panel: DataFrame) -> DataFrame:
    q = F.percentile("value", F.array(*[F.lit(x) for x in (0.01, 0.25, 0.5, 0.75, 0.99)]))
    g = panel.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.count("value").alias("n_obs"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        q.alias("q"),
    )
    names = ["q01", "q25", "median", "q75", "q99"]
    return g.select(*SERIES, "n_days", "n_obs", (1 - F.col("n_obs") / F.col("n_days")).alias("missing_rate"), "mean", "std", "min", "max", *(F.col("q")[i].alias(n) for i, n in enumerate(names)))


def date_continuity(obs: DataFrame, keys: list[str] = ["entity"]) -> DataFrame:  # noqa: B006
    g = obs.groupBy(*keys).agg((F.datediff(F.max("ts"), F.min("ts")) + 1).cast("long").alias("expected"), F.countDistinct("ts").alias("unique_days"), F.count(F.lit(1)).alias("rows"))
    return g.select(*keys, "expected", "unique_days", (F.col("rows") - F.col("unique_days")).alias("duplicates"), (F.col("expected") - F.col("unique_days")).alias("missing_days"))


def constant_runs(obs: DataFrame, least: int) -> DataFrame:
    """Runs of at least ``least`` days with exactly one value; a gap in the dates breaks a run."""
    w = Window.partitionBy(*SERIES).orderBy("ts")
    same = (F.lag("value").over(w) == F.col("value")) & (F.lag("ts").over(w) == F.date_sub("ts", 1))
    runs = islands(obs.where("value is not null"), SERIES, "ts", same)
    g = runs.groupBy(*SERIES, "run_id").agg(F.min("ts").alias("start_date"), F.max("ts").alias("end_date"), F.count(F.lit(1)).alias("n_days"), F.first("value").alias("value"))
    return g.where(F.col("n_days") >= least).drop("run_id")


def availability(panel: DataFrame) -> DataFrame:
    g = panel.groupBy("split", *SERIES).agg(F.count(F.lit(1)).alias("n_days"), F.count_if("observed").alias("n_observed"))
    return g.withColumn("availability", F.col("n_observed") / F.col("n_days"))


def quality_crosstab(panel: DataFrame) -> DataFrame:
    """Counts by status, with the totals row (nulls) from the same pass."""
    return panel.groupingSets([["variable", "split", "qc_status"], []], "variable", "split", "qc_status").agg(F.count(F.lit(1)).alias("n"))


def series_description(panel: DataFrame) -> DataFrame:
    q = F.percentile("value", F.array(F.lit(0.1), F.lit(0.9)))
    g = panel.groupBy(*SERIES).agg(F.avg(F.col("observed").cast("int")).alias("coverage"), F.stddev_samp("value").alias("std"), q.alias("q"))
    return g.select(*SERIES, "coverage", "std", F.col("q")[0].alias("q10"), F.col("q")[1].alias("q90"))


def annual_coverage(panel: DataFrame) -> DataFrame:
    return panel.groupBy(*SERIES, F.year("ts").alias("year")).agg(F.avg(F.col("observed").cast("int")).alias("coverage"))


def scaler(panel: DataFrame) -> DataFrame:
    """Mean and population deviation of the training split; a zero deviation becomes one."""
    t = F.when(F.col("split") == "train", F.col("value"))
    g = panel.groupBy(*SERIES).agg(F.avg(t).alias("mean"), F.stddev_pop(t).alias("_s"))
    return g.select(*SERIES, "mean", F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0).alias("std"))


def standardise(panel: DataFrame) -> DataFrame:
    return panel.join(scaler(panel), SERIES).withColumn("z", (F.col("value") - F.col("mean")) / F.col("std"))


def train_reference(panel: DataFrame) -> DataFrame:
    t = panel.where("split = 'train' and observed")
    q = F.percentile("value", F.array(*[F.lit(x) for x in (0.1, 0.25, 0.75, 0.9)]))
    g = t.groupBy(*SERIES).agg(q.alias("q"), F.stddev_pop("value").alias("std"))
    return g.select(*SERIES, F.col("q")[0].alias("q10"), F.col("q")[3].alias("q90"), (F.col("q")[2] - F.col("q")[1]).alias("iqr"), "std")


def group_means(df: DataFrame, wanted: list[str], metrics: list[str]) -> DataFrame:
    """Means of metrics by those of the wanted keys that the table has, with group sizes."""
    keys = [c for c in wanted if c in df.columns]
    return df.groupBy(*keys).agg(*(F.avg(m).alias(m) for m in metrics), F.count(F.lit(1)).alias("size"))


def seed_collapse(df: DataFrame, unit: list[str], seed: str, metric: str) -> DataFrame:
    """Mean within each seed, then over seeds: seeds weigh the same, however many rows they have."""
    inner = df.groupBy(*unit, seed).agg(F.avg(metric).alias("_m"))
    return inner.groupBy(*unit).agg(F.avg("_m").alias(metric), F.count(F.lit(1)).alias("n_seeds"))
