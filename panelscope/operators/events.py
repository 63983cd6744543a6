"""Event days, their windows and surroundings, and gaps of several parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelscope.functions.sqlfn import SERIES, hash_rank
from panelscope.operators.explore import block_starts


def measures(panel: DataFrame) -> DataFrame:
    """``change``: the daily difference, only between two observed days of one split."""
    w = Window.partitionBy(*SERIES).orderBy("ts")
    ok = F.col("observed") & F.lag("observed").over(w) & (F.col("split") == F.lag("split").over(w)) & (F.datediff("ts", F.lag("ts").over(w)) == 1)
    return panel.withColumn("change", F.when(ok, F.col("value") - F.lag("value").over(w)))


def event_labels(wide: DataFrame, t: str, f: str) -> DataFrame:
    """Days by training quantiles of their entity: high ``t``, runs of three or more such days,
    high and low ``f``. ``wide``: entity, ts, split and the two columns."""
    q = wide.where("split = 'train'").groupBy("entity").agg(F.percentile(t, 0.9).alias("t90"), F.percentile(f, F.array(F.lit(0.1), F.lit(0.9))).alias("fq"))
    d = wide.join(q, "entity").withColumn("high_t", F.coalesce(F.col(t) >= F.col("t90"), F.lit(False)))
    w = Window.partitionBy("entity").orderBy("ts")
    d = d.withColumn("_run", F.sum((~F.col("high_t")).cast("int")).over(w))
    n = F.sum(F.col("high_t").cast("int")).over(Window.partitionBy("entity", "_run"))
    return d.select("entity", "ts", "split", "high_t", (F.col("high_t") & (n >= 3)).alias("heat_run"), F.coalesce(F.col(f) >= F.col("fq")[1], F.lit(False)).alias("high_f"), F.coalesce(F.col(f) <= F.col("fq")[0], F.lit(False)).alias("low_f"))


def day_condition(panel: DataFrame, thresholds: DataFrame, source: str, season) -> DataFrame:
    """``event``: observed days of the source split above the threshold of their season."""
    met = panel.withColumn("season", season).join(thresholds.select(*SERIES, "season", "threshold"), [*SERIES, "season"], "left")
    return met.withColumn("event", F.coalesce((F.col("split") == source) & F.col("observed") & (F.col("value") > F.col("threshold")), F.lit(False)))


def phases(episodes: DataFrame, half: int) -> DataFrame:
    """Around each episode's peak: a window of fixed width, and the rising and receding days."""
    e = episodes.withColumns({"window_start": F.date_sub("peak_date", half), "window_end": F.date_add("peak_date", half)})
    return e.withColumns({"rising_days": F.datediff("peak_date", "start_date").cast("long"), "receding_days": F.datediff("end_date", "peak_date").cast("long")})


def context(episodes: DataFrame, panel: DataFrame, days: int) -> DataFrame:
    """Whether the window and the ``days`` before and after it are wholly observed, from running
    sums at four borders of each episode; and the reasons why not, joined by semicolons."""
    w = Window.partitionBy(*SERIES).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    run = panel.select(*SERIES, F.col("ts").alias("_day"), F.sum(F.col("observed").cast("int")).over(w).alias("_c"))
    borders = {"a": F.date_sub("start_date", days + 1), "b": F.date_sub("start_date", 1), "c": F.col("end_date"), "d": F.date_add("end_date", days)}
    own = [*SERIES, "start_date", "end_date"]
    asked = episodes.select(*own, F.explode(F.array(*(F.struct(F.lit(k).alias("k"), at.alias("d")) for k, at in borders.items()))).alias("_b"))
    met = asked.select(*own, "_b.k", F.col("_b.d").alias("_day")).join(run, [*SERIES, "_day"], "left")
    at = met.groupBy(*own).agg(*(F.max(F.when(F.col("k") == k, F.col("_c"))).alias(f"_{k}") for k in borders))
    out = episodes.join(at, own, "left")
    span = F.datediff("end_date", "start_date") + 1
    out = out.fillna(0, ["_a", "_b"])  # nothing lies before the first day
    full = {"window": F.col("_c") - F.col("_b") == span, "left": F.col("_b") - F.col("_a") == days, "right": F.col("_d") - F.col("_c") == days}
    why = {"window": "event_window_not_fully_eligible", "left": "missing_left_context", "right": "missing_right_context"}
    out = out.withColumns({f"{k}_ok": F.coalesce(c, F.lit(False)) for k, c in full.items()})
    reasons = F.concat_ws(";", *(F.when(~F.col(f"{k}_ok"), why[k]) for k in full))
    return out.withColumn("reasons", reasons).drop("_a", "_b", "_c", "_d")


def stress_cells(panel: DataFrame, event: str = "event") -> DataFrame:
    """All observed cells of an entity on days on which any of its series has an event."""
    days = panel.where(event).select("entity", "ts").distinct()
    return panel.where("observed").join(days, ["entity", "ts"], "left_semi").select(*SERIES, "ts")


def multi_block(panel: DataFrame, lengths: list[int], spacing: int, seed: int) -> DataFrame:
    """Blocks of the given lengths in this order, at least ``spacing`` days apart: the first block
    is drawn by hash among the starts from which the others fit, each next one is the earliest fit."""
    starts = {n: block_starts(panel, n) for n in set(lengths)}
    day = lambda k: F.col(f"s{k}")
    out = starts[lengths[0]].select(*SERIES, F.col("ts").alias("s0"))
    for k in range(1, len(lengths)):
        # the earliest start of this length on or after a day: a running minimum from the right
        nxt = panel.select(*SERIES, "ts").join(starts[lengths[k]].withColumn("_at", F.col("ts")), [*SERIES, "ts"], "left")
        w = Window.partitionBy(*SERIES).orderBy(F.col("ts").desc()).rowsBetween(Window.unboundedPreceding, 0)
        nxt = nxt.select(*SERIES, F.col("ts").alias("_from"), F.min("_at").over(w).alias(f"s{k}")).where(F.col(f"s{k}").isNotNull())
        out = out.withColumn("_from", F.date_add(day(k - 1), lengths[k - 1] + spacing)).join(nxt, [*SERIES, "_from"]).drop("_from")
    pick = Window.partitionBy(*SERIES).orderBy(hash_rank(F.lit(str(seed)), "entity", "variable", "s0"))
    first = out.withColumn("_n", F.row_number().over(pick)).where("_n = 1")
    parts = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("part"), day(k).alias("start_date"), F.date_add(day(k), n - 1).alias("end_date")) for k, n in enumerate(lengths))))
    return first.select(*SERIES, parts.alias("p")).select(*SERIES, "p.*")


def staggered(panel: DataFrame, length: int, shift: int, seed: int) -> DataFrame:
    """One gap in each variable of an entity, each ``shift`` days after the one before (by name),
    from a base day drawn by hash among those at which all fit."""
    order = panel.select("entity", "variable").distinct()
    w = Window.partitionBy("entity")
    order = order.withColumns({"_i": F.row_number().over(w.orderBy("variable")) - 1, "_k": F.count(F.lit(1)).over(w)})
    s = block_starts(panel, length).join(order, SERIES).withColumn("base", F.expr(f"date_sub(ts, cast(_i * {shift} as int))"))
    fits = s.groupBy("entity", "base").agg(F.count(F.lit(1)).alias("n"), F.first("_k").alias("_k")).where("n = _k")
    pick = Window.partitionBy("entity").orderBy(hash_rank(F.lit(str(seed)), "entity", "base"))
    chosen = fits.withColumn("_n", F.row_number().over(pick)).where("_n = 1").select("entity", "base")
    at = chosen.join(order, "entity").withColumn("start_date", F.expr(f"date_add(base, cast(_i * {shift} as int))"))
    return at.select(*SERIES, "start_date", F.date_add("start_date", length - 1).alias("end_date"))


def joint_anchors(panel: DataFrame, length: int, season, k: int, seed: int) -> DataFrame:
    """At most ``k`` centres for each entity and season on which all its variables are complete,
    and how many each season falls short."""
    n = panel.select(*SERIES).distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("_k"))
    s = block_starts(panel, length).groupBy("entity", "ts").agg(F.count(F.lit(1)).alias("_n")).join(n, "entity").where("_n = _k")
    c = s.select("entity", F.date_add("ts", (length - 1) // 2).alias("ts")).withColumn("season", season)
    w = Window.partitionBy("entity", "season")
    no = F.row_number().over(w.orderBy(hash_rank(F.lit(str(seed)), "entity", "ts")))
    short = F.greatest(F.lit(k) - F.count(F.lit(1)).over(w), F.lit(0))
    return c.withColumns({"anchor_no": no.cast("long"), "shortfall": short.cast("long")}).where(F.col("anchor_no") <= k).withColumnRenamed("ts", "center_date")


def rating_diagnostics(days: DataFrame, x: str, y: str) -> DataFrame:
    """By entity and year: Pearson r and its square, R2 of a parabola, R2 of lines through the low
    and the high fifth of ``y``; all from centred moments. Null where there are too few days."""
    d = days.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("year", F.year("ts").cast("long"))
    by = ["entity", "year"]
    c = d.groupBy(*by).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.percentile(y, F.array(F.lit(0.2), F.lit(0.8))).alias("_q"))
    d = d.join(c, by).withColumns({"u": F.col(x) - F.col("_mx"), "v": F.col(y) - F.col("_my")})
    p = lambda c, k: reduce(lambda a, b: a * b, [F.col(c)] * k)
    low, high = F.col(y) <= F.col("_q")[0], F.col(y) >= F.col("_q")[1]

    def line(ok):  # R2 of a straight line over some rows
        a, b = F.when(ok, F.col("u")), F.when(ok, F.col("v"))
        cov = F.covar_pop(a, b)
        return F.when(F.count("*") >= 5, F.try_divide(cov * cov, F.var_pop(a) * F.var_pop(b)))

    g = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(p("u", 2)).alias("s2"), F.sum(p("u", 3)).alias("s3"), F.sum(p("u", 4)).alias("s4"), F.sum(F.col("u") * F.col("v")).alias("t1"), F.sum(p("u", 2) * F.col("v")).alias("t2"), F.sum(p("v", 2)).alias("vv"), line(low).alias("low_r2"), line(high).alias("high_r2")
    )
    n, s2, s3, s4, t1, t2, vv = (F.col(k) for k in ("n", "s2", "s3", "s4", "t1", "t2", "vv"))
    m = s4 - s2 * s2 / n  # normal equations of centred u and u squared
    b2 = F.try_divide(t2 * s2 - t1 * s3, m * s2 - s3 * s3)
    b1 = F.try_divide(t1 - b2 * s3, s2)
    out = g.withColumns({"pearson": F.try_divide(t1, F.sqrt(s2 * vv)), "linear_r2": F.try_divide(t1 * t1, s2 * vv), "quadratic_r2": F.try_divide(b1 * t1 + b2 * t2, vv)})
    return out.select(*by, "n", "pearson", "linear_r2", "quadratic_r2", "low_r2", "high_r2")
