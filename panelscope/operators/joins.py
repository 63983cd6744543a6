"""Pairings, containment, resampled clusters, hinges, null models and audits of anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelscope.functions.sqlfn import SERIES, avg_rank, doy366, hash_rank, safe_corr
from panelscope.operators.explore import block_starts
from panelscope.operators.resampling import bootstrap_mean
from panelscope.operators.results import transfer_entropy


def paired_results(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Two result sets on the keys both have; a key repeated in either is averaged first."""
    side = lambda df, out: df.groupBy(*keys).agg(F.avg(value).alias(out))
    return side(a, "a").join(side(b, "b"), keys).withColumn("diff", F.col("a") - F.col("b"))


def window_counts(panel: DataFrame, half: int) -> DataFrame:
    """Training observations within ``half`` circular days of each climatological day: counted by
    day first, so that only 366 rows a series are sent to the days around them."""
    t = panel.where("split = 'train' and value is not null").groupBy(*SERIES, doy366("ts").alias("d")).agg(F.count(F.lit(1)).alias("k"))
    near = t.select(*SERIES, "k", F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("o"), "d")
    doy = F.pmod(F.col("d") - 1 + F.col("o"), F.lit(366)) + 1
    return near.groupBy(*SERIES, doy.cast("long").alias("doy")).agg(F.sum("k").alias("n"))


def lagged_pairs(source: DataFrame, target: DataFrame, by: list[str], lags: list[int]) -> DataFrame:
    """Each source day with the target ``lag`` days later (by, lag, ts, source, target)."""
    s = source.select(*by, "ts", F.col("value").alias("source"), F.explode(F.lit(lags)).alias("lag")).withColumn("_at", F.expr("date_add(ts, lag)"))
    return s.join(target.select(*by, F.col("ts").alias("_at"), F.col("value").alias("target")), [*by, "_at"]).drop("_at")


def days_inside(intervals: DataFrame, days: DataFrame, keys: list[str]) -> DataFrame:
    """The days (keys, ts, ...) that lie in an interval of their key; an interval's days become
    rows, so the containment is an equi-join."""
    return days.join(intervals.withColumn("ts", F.explode(F.sequence("start_date", "end_date"))), [*keys, "ts"])


def rank_correlation(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Spearman's coefficient with average ranks, of the rows that have both."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = both.withColumn("_x", avg_rank(x, *by)).withColumn("_y", avg_rank(y, *by))
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), safe_corr("_x", "_y").alias("spearman"))


def one_hinge(curve: DataFrame, by: list[str], x: str, y: str, w: str) -> DataFrame:
    """Continuous weighted line with one bend: the candidate bend (two points or more on each side)
    of least squared error, the slope before it and the change of slope at it. Ties: the earlier bend."""
    p = curve.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(w).cast("double").alias("w"))
    o = Window.partitionBy(*by).orderBy("x")
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    at = p.withColumns({"_i": F.row_number().over(o), "_n": n}).where("_i >= 2 and _i < _n").select(*by, F.col("x").alias("bend"))
    # a curve has a handful of gaps, each once
    m = p.join(at, by).withColumn("h", F.greatest(F.col("x") - F.col("bend"), F.lit(0.0)))
    s = lambda *cs: F.sum(F.expr("*".join(("w", *cs))))
    g = m.groupBy(*by, "bend").agg(s().alias("s"), s("x").alias("sx"), s("h").alias("sh"), s("x", "x").alias("xx"), s("x", "h").alias("xh"), s("h", "h").alias("hh"), s("y").alias("sy"), s("x", "y").alias("xy"), s("h", "y").alias("hy"), s("y", "y").alias("yy"))
    g = g.select(*by, "bend", *(F.expr(e).alias(k) for k, e in HINGE_MOMENTS.items()))
    g = g.withColumn("det", F.col("a") * F.col("b") - F.col("c") * F.col("c"))
    g = g.withColumns({"slope": F.expr("try_divide(p * b - q * c, det)"), "change": F.expr("try_divide(q * a - p * c, det)")})
    g = g.withColumn("sse", F.round(F.expr("greatest(t - slope * p - change * q, 0)"), 9))
    best = F.min_by(F.struct("bend", "slope", "change", "sse"), F.struct("sse", "bend"))
    return g.where("sse is not null").groupBy(*by).agg(best.alias("f")).select(*by, "f.*")


#: Weighted moments of x, hinge and y about their means.
HINGE_MOMENTS = {"a": "xx - sx * sx / s", "b": "hh - sh * sh / s", "c": "xh - sx * sh / s", "p": "xy - sx * sy / s", "q": "hy - sh * sy / s", "t": "yy - sy * sy / s"}


def permuted_donors(df: DataFrame, entity: str, seed: int) -> DataFrame:
    """``donor``: another entity for each one, the next in a hash order, the last one's being the
    first. Rows keep their entity; only the few names go through one window."""
    o = Window.orderBy("_h")
    names = df.select(entity).distinct().withColumn("_h", hash_rank(F.lit(str(seed)), entity))
    first = names.agg(F.min_by(entity, "_h").alias("_first"))
    to = names.withColumn("donor", F.lead(entity).over(o)).crossJoin(F.broadcast(first))  # one row
    return df.join(to.select(entity, F.coalesce("donor", "_first").alias("donor")), entity)


def shift_null(df: DataFrame, by: list[str], x: str, y: str, order: str, lag: int, draws: int, seed: int) -> DataFrame:
    """Transfer entropy against its null of circular shifts: all draws are one pass keyed by draw;
    p is (1 + draws at least as large) / (1 + draws)."""
    w = Window.partitionBy(*by)
    i = df.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(w)}).withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    by_hash = F.conv(F.substring(hash_rank(F.lit(str(seed)), *by, "_draw"), 1, 8), 16, 10).cast("long")
    shift = F.when(F.col("_draw") == 0, 0).otherwise(1 + F.pmod(by_hash, F.greatest(F.col("_n") - 1, F.lit(1))))
    i = i.withColumn("_from", F.pmod(F.col("_i") + shift, F.col("_n")))
    moved = i.select(*by, "_draw", F.col("_from").alias("_i"), F.col(x).alias("_x"))
    t = transfer_entropy(i.drop("_from").join(moved, [*by, "_draw", "_i"]), [*by, "_draw"], "_x", y, order, lag).withColumn("te", F.round("te", 9))
    own = F.max(F.when(F.col("_draw") == 0, F.col("te"))).over(w)
    g = t.withColumn("_own", own).where("_draw > 0").groupBy(*by).agg(F.first("_own").alias("te"), F.avg("te").alias("null_mean"), F.stddev_pop("te").alias("null_std"), F.count_if(F.col("te") >= F.col("_own")).alias("at_least"))
    return g.withColumn("z", F.when(F.col("null_std") > 1e-12, (F.col("te") - F.col("null_mean")) / F.col("null_std"))).withColumn("p_value", (1 + F.col("at_least")) / (draws + 1))


def anchor_cells(anchors: DataFrame, length: int) -> DataFrame:
    """(series, center_date, ts): the days of each anchor's block."""
    start = F.date_sub("center_date", (length - 1) // 2)
    return anchors.select(*SERIES, "center_date", F.explode(F.sequence(start, F.date_add(start, length - 1))).alias("ts"))


def anchor_availability(anchors: DataFrame, version: DataFrame, length: int) -> DataFrame:
    """Whether each anchor's block is whole on another data version; nothing takes a lost one's place."""
    c = anchor_cells(anchors, length).join(version.select(*SERIES, "ts", "value"), [*SERIES, "ts"], "left")
    return c.groupBy(*SERIES, "center_date").agg(F.count("value").alias("present"), F.lit(length).cast("long").alias("required")).withColumn("available", F.col("present") == F.col("required"))


def anchor_bridge(anchors: DataFrame, a: DataFrame, b: DataFrame, length: int) -> DataFrame:
    """Cells of each anchor's block whose truth differs between two versions, nulls being equal."""
    both = a.select(*SERIES, "ts", F.col("value").alias("_a")).join(b.select(*SERIES, "ts", F.col("value").alias("_b")), [*SERIES, "ts"])
    c = anchor_cells(anchors, length).join(both, [*SERIES, "ts"], "left")
    g = c.groupBy(*SERIES, "center_date").agg(F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed"))
    return g.withColumn("equivalent", F.col("changed") == 0)


def anchor_independence(anchors: DataFrame, length: int) -> DataFrame:
    """By series: anchors, those whose block overlaps the one before or after, days covered, and the
    effective number: days covered over the block's length."""
    w = Window.partitionBy(*SERIES).orderBy("center_date")
    near = lambda c: F.coalesce(F.abs(F.datediff(c, "center_date")) < length, F.lit(False))
    o = anchors.select(*SERIES, (near(F.lag("center_date").over(w)) | near(F.lead("center_date").over(w))).alias("_o"))
    n = o.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n_anchors"), F.count_if("_o").alias("n_overlapping"))
    days = anchor_cells(anchors, length).groupBy(*SERIES).agg(F.countDistinct("ts").alias("days"))
    return n.join(days, SERIES).withColumn("effective_n", F.col("days") / length)


def feasibility(panel: DataFrame, lengths: list[int]) -> DataFrame:
    """By series and gap length: how many places are wholly observed, and whether there is one."""
    grid = panel.select(*SERIES).distinct().withColumn("length", F.explode(F.lit(lengths).cast("array<long>")))
    out = None
    for n in lengths:
        s = block_starts(panel, n).groupBy(*SERIES).agg(F.count(F.lit(1)).alias("starts")).withColumn("length", F.lit(n).cast("long"))
        out = s if out is None else out.unionByName(s)
    met = grid.join(out, [*SERIES, "length"], "left").fillna(0, ["starts"])
    return met.withColumn("feasible", F.col("starts") > 0)


def event_scores(episodes: DataFrame, scored: DataFrame) -> DataFrame:
    """One row per episode: cells with truth and prediction, MAE, the error at the largest value and
    the days by which the predicted peak is late (the first of equal peaks)."""
    d = days_inside(episodes.select(*SERIES, "start_date", "end_date"), scored.select(*SERIES, "ts", "truth", "pred").where("truth is not null and pred is not null"), SERIES)
    first = lambda c: F.max_by("ts", F.struct(c, -F.unix_date("ts")))
    return d.groupBy(*SERIES, "start_date", "end_date").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("pred") - F.col("truth"))).alias("mae"), (F.max("pred") - F.max("truth")).alias("peak_error"), F.datediff(first("pred"), first("truth")).cast("long").alias("peak_lag"))


def event_extrema(episodes: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    """One row per episode: the predicted extremes of its evaluated days against the truth on the days
    the catalogue declares (``peak_day``, ``low_day``; null for none): signed error and days apart.

    The first of equal extremes counts. An anchor that is no evaluated day of the episode gives
    nulls, and so matched controls, which carry their event's anchors, have them.
    ``peak_error`` and ``timing_error`` are of the peak, or of the low where no peak can be judged.
    """
    known = scored.select(*SERIES, "ts", "truth", "pred").where("truth is not null and pred is not null and not isnan(truth) and not isnan(pred)")
    d = days_inside(episodes.select(*SERIES, *keys, "start_date", "end_date", "peak_day", "low_day"), known, SERIES)
    cell, day = F.struct("pred", "ts"), F.unix_date("ts")
    of = lambda anchor: F.max(F.when(F.col("ts") == F.col(anchor), F.col("truth")))
    g = d.groupBy(*SERIES, *keys).agg(
        F.count(F.lit(1)).alias("n"), F.max_by(cell, F.struct("pred", -day)).alias("_hi"), F.min_by(cell, F.struct("pred", day)).alias("_lo"),
        of("peak_day").alias("_peak"), of("low_day").alias("_low"), F.max("peak_day").alias("_pd"), F.max("low_day").alias("_ld"),
    )
    apart = lambda x, anchor, truth: F.when(F.col(truth).isNotNull(), F.abs(F.datediff(f"{x}.ts", anchor)).cast("long"))
    g = g.select(
        *SERIES, *keys, "n", (F.col("_hi.pred") - F.col("_peak")).alias("peak_magnitude_error"), apart("_hi", "_pd", "_peak").alias("peak_timing_days"),
        (F.col("_lo.pred") - F.col("_low")).alias("low_magnitude_error"), apart("_lo", "_ld", "_low").alias("low_timing_days"),
    )
    out = episodes.select(*SERIES, *keys, "start_date", "end_date").join(g, [*SERIES, *keys], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumns({"peak_error": F.coalesce("peak_magnitude_error", "low_magnitude_error"), "timing_error": F.coalesce("peak_timing_days", "low_timing_days")})


def evaluated(scored: DataFrame, approved: Column) -> DataFrame:
    """The cells that count in a score: approved, hidden, with a finite truth and prediction."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return scored.where(approved & F.col("hidden") & finite("truth") & finite("pred"))


def result_summary(units: DataFrame, by: list[str], value: str, unit: str, draws: int, seed: int) -> DataFrame:
    """Number of units, mean, median, standard deviation and the mean's bootstrap interval by group."""
    plain = units.groupBy(*by).agg(F.percentile(value, 0.5).alias("median"), F.stddev_samp(value).alias("std"))
    drawn = bootstrap_mean(units, by, unit, value, draws, seed).withColumnsRenamed({"estimate": "mean", "n_clusters": "n_units"})
    return drawn.join(plain, by).select(*by, "n_units", "mean", "median", "std", "ci_lower", "ci_upper")
