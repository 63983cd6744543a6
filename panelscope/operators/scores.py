"""Scores by kind of variable, of quantiles, by horizon, and the calibration of intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelscope.functions.sqlfn import SERIES, avg_rank, safe_corr


def reconstructed(filled: DataFrame) -> DataFrame:
    """``selected``: hidden cells with truth and prediction; ``rec``: prediction there, truth elsewhere."""
    on = F.col("hidden") & F.col("truth").isNotNull() & F.col("pred").isNotNull()
    return filled.withColumn("selected", on).withColumn("rec", F.when(on, F.col("pred")).otherwise(F.col("truth")))


def _high(c: str, t: str = "threshold"):
    return F.coalesce(F.col(c) >= F.col(t), F.lit(False))


def level(filled: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Error on high levels, bias of days at or above the threshold, size and timing of the peak.
    ``thresholds``: (entity, variable, threshold)."""
    s = reconstructed(filled).where("selected").join(thresholds, SERIES)
    first = lambda c: F.struct(F.col(c), -F.datediff("ts", F.lit("1970-01-01")))  # noqa: E731  the earliest of the highest
    g = s.groupBy(*SERIES).agg(
        F.avg(F.when(_high("truth"), F.abs(F.col("pred") - F.col("truth")))).alias("high_mae"),
        (F.count_if(_high("pred")) - F.count_if(_high("truth"))).alias("duration_bias"),
        (F.max("pred") - F.max("truth")).alias("peak_error"),
        F.max_by("ts", first("pred")).alias("_p"),
        F.max_by("ts", first("truth")).alias("_t"),
    )
    return g.withColumn("peak_timing_days", F.abs(F.datediff("_p", "_t")).cast("long")).drop("_p", "_t")


def longest_run(df: DataFrame, flag: str, out: str) -> DataFrame:
    """The most days in a row on which the flag holds, by series."""
    w = Window.partitionBy(*SERIES).orderBy("ts")
    on = df.where(flag).withColumn("_isle", F.date_sub("ts", F.row_number().over(w)))
    return on.groupBy(*SERIES, "_isle").count().groupBy(*SERIES).agg(F.max("count").alias(out))


def temperature(filled: DataFrame, thresholds: DataFrame) -> DataFrame:
    """High values: error, bias, peak; days at or above the threshold; longest hot run and yearly
    maximum in the years with hidden cells; error of day-to-day changes next to hidden cells."""
    s = reconstructed(filled).join(thresholds, SERIES).withColumn("year", F.year("ts"))
    w = Window.partitionBy(*SERIES).orderBy("ts")
    scope = F.max(F.col("selected").cast("int")).over(Window.partitionBy(*SERIES, "year")) == 1
    change = F.abs((F.col("rec") - F.lag("rec").over(w)) - (F.col("truth") - F.lag("truth").over(w)))
    s = s.withColumn("scope", scope).withColumn("change", F.when(F.col("hidden") | F.lag("hidden").over(w), change))
    hot = F.col("selected") & _high("truth")
    e = F.col("pred") - F.col("truth")
    g = s.groupBy(*SERIES).agg(
        F.count_if(hot).alias("high_n"),
        F.avg(F.when(hot, F.abs(e))).alias("high_mae"),
        F.avg(F.when(hot, e)).alias("high_bias"),
        (F.max(F.when(hot, F.col("pred"))) - F.max(F.when(hot, F.col("truth")))).alias("extreme_peak_error"),
        (F.count_if(F.col("selected") & _high("pred")) - F.count_if(hot)).alias("threshold_days_bias"),
        F.avg("change").alias("daily_change_mae"),
    )
    runs = s.where("scope and truth is not null").withColumns({"hot_truth": _high("truth"), "hot_rec": _high("rec")})
    years = s.where("scope and truth is not null").groupBy(*SERIES, "year").agg((F.max("rec") - F.max("truth")).alias("d")).groupBy(*SERIES).agg(F.avg("d").alias("annual_max_error"))
    found = g.join(longest_run(runs, "hot_truth", "_t"), SERIES, "left").join(longest_run(runs, "hot_rec", "_r"), SERIES, "left").join(years, SERIES, "left")
    return found.withColumn("heat_run_error", F.coalesce("_r", F.lit(0)) - F.coalesce("_t", F.lit(0))).drop("_r", "_t")


def kling_gupta(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Kling-Gupta efficiency with its parts, and the volume bias."""
    s = scored.where("truth is not null and pred is not null")
    g = s.groupBy(*keys).agg(
        safe_corr("truth", "pred", 2).alias("r"), F.try_divide(F.stddev_pop("pred"), F.stddev_pop("truth")).alias("alpha"), F.try_divide(F.avg("pred"), F.avg("truth")).alias("beta"), (F.sum("pred") - F.sum("truth")).alias("volume_bias")
    )
    off = lambda c: F.pow(F.col(c) - 1, F.lit(2))
    return g.withColumn("kge", 1 - F.sqrt(off("r") + off("alpha") + off("beta")))


def quantiles(scored: DataFrame, keys: list[str], truth: str, at: dict[float, str]) -> DataFrame:
    """Pinball loss of each quantile column, coverage and width of the central intervals, and the
    approximate CRPS: twice the trapezoid of the losses over the quantiles. Rows that lack a value
    take no part."""
    qs = sorted(at)
    s = scored.where(F.expr(" and ".join(f"{c} is not null" for c in [truth, *at.values()])))
    loss = {q: F.greatest(q * (F.col(truth) - F.col(at[q])), (q - 1) * (F.col(truth) - F.col(at[q]))) for q in qs}
    area = sum((b - a) * (loss[a] + loss[b]) / 2 for a, b in zip(qs, qs[1:], strict=False))
    name = lambda q: f"q{round(100 * q):02d}"
    out = [F.count(F.lit(1)).alias("n"), *(F.avg(loss[q]).alias(f"pinball_{name(q)}") for q in qs), F.avg(2 * area).alias("approx_crps")]
    for q in qs:
        up = round(1 - q, 9)
        if q < 0.5 and up in at:
            lo, hi, level = F.least(at[q], at[up]), F.greatest(at[q], at[up]), f"{round(100 * (up - q)):02d}"
            out += [F.avg(F.col(truth).between(lo, hi).cast("int")).alias(f"coverage_{level}"), F.avg(hi - lo).alias(f"width_{level}")]
    return s.groupBy(*keys).agg(*out)


def by_horizon(scored: DataFrame, label: str) -> DataFrame:
    """Errors of causal fills for each horizon bin and over all (null); skill is zero where
    climatology is without error."""
    s = scored.where("hidden and truth is not null and pred is not null and clim is not null").withColumn("e", F.col("pred") - F.col("truth"))
    g = s.groupingSets([["variable", label], ["variable"]], "variable", label).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.abs(F.col("clim") - F.col("truth"))).alias("mae_clim"))
    return g.withColumn("skill", F.when(F.col("mae_clim") > 0, 1 - F.col("mae") / F.col("mae_clim")).otherwise(0.0))


def calibration(df: DataFrame, keys: list[str], truth: str, lo: str, hi: str, nominal: float) -> DataFrame:
    """Coverage of [lo, hi] against the nominal one, widths and crossings, of rows with all three."""
    s = df.where(F.col(truth).isNotNull() & F.col(lo).isNotNull() & F.col(hi).isNotNull())
    width = F.col(hi) - F.col(lo)
    g = s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col(truth).between(F.col(lo), F.col(hi))).cast("int")).alias("coverage"),
        F.avg(width).alias("mean_width"),
        F.percentile(width.cast("double"), 0.5).alias("median_width"),
        F.avg((F.col(lo) > F.col(hi)).cast("int")).alias("crossing_rate"),
    )
    return g.withColumn("calibration_error", F.col("coverage") - nominal)


def width_growth(units: DataFrame, by: list[str], gap: str) -> DataFrame:
    """Rank correlation of gap length and interval width, units weighted by their cells."""
    w = units.groupBy(*by, gap).agg(F.round(F.try_divide(F.sum(F.col("mean_width") * F.col("n")), F.sum("n")), 9).alias("width"))
    ranked = w.withColumn("_g", avg_rank(gap, *by)).withColumn("_w", avg_rank("width", *by))
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("gaps"), safe_corr("_g", "_w").alias("spearman"), F.min_by("width", gap).alias("first_width"), F.max_by("width", gap).alias("last_width"))


def calibration_by_axis(df: DataFrame, axes: list[str], truth: str, lo: str, hi: str, nominal: float) -> DataFrame:
    """The same along each axis by itself: (axis, value) rows from one pass."""
    long = df.select(truth, lo, hi, F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes))).alias("x"))
    return calibration(long.select(truth, lo, hi, "x.axis", "x.value"), ["axis", "value"], truth, lo, hi, nominal)
