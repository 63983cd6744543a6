"""Imputers: each adds ``pred`` to a panel whose hidden cells are null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelscope.functions.sqlfn import SERIES, doy366


def climatology(panel: DataFrame, half: int = 7) -> DataFrame:
    """Training median within ``half`` circular days, else of the whole training split. Each
    training day is sent to the days it counts for, so the window is an equi-join."""
    t = panel.where("split = 'train' and value is not null")
    near = t.select(*SERIES, "value", F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("o"), doy366("ts").alias("d"))
    near = near.withColumn("doy", F.pmod(F.col("d") - 1 + F.col("o"), F.lit(366)) + 1)
    by_day = near.groupBy(*SERIES, "doy").agg(F.percentile("value", 0.5).alias("_m"))
    overall = t.groupBy(*SERIES).agg(F.percentile("value", 0.5).alias("_all"))
    met = panel.withColumn("doy", doy366("ts")).join(by_day, [*SERIES, "doy"], "left").join(overall, SERIES, "left")
    return met.withColumn("pred", F.coalesce("_m", "_all")).drop("doy", "_m", "_all")


def linear(panel: DataFrame) -> DataFrame:
    """Straight line between the observations around an interior gap; null outside."""
    order = Window.partitionBy(*SERIES).orderBy("ts")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("value").isNotNull(), F.struct(F.unix_date("ts").alias("t"), F.col("value").alias("v")))
    p = panel.withColumn("_a", F.last(at, ignorenulls=True).over(back)).withColumn("_b", F.first(at, ignorenulls=True).over(ahead))
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * F.try_divide(F.unix_date("ts") - F.col("_a.t"), F.col("_b.t") - F.col("_a.t"))
    return p.withColumn("pred", F.coalesce("value", line)).drop("_a", "_b")


def persistence(panel: DataFrame) -> DataFrame:
    """The last observation before, or the training mean at the start."""
    order = Window.partitionBy(*SERIES).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    mean = F.avg(F.when(F.col("split") == "train", F.col("value"))).over(Window.partitionBy(*SERIES))
    return panel.withColumn("pred", F.coalesce(F.last("value", ignorenulls=True).over(order), mean))


def rating_curve(wide: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares parabola of ``y`` on ``x`` by entity, from centred moment sums and Cramer's
    rule: (entity, center, c0, c1, c2)."""
    t = wide.where((F.col("split") == "train") & F.col(x).isNotNull() & F.col(y).isNotNull())
    mean = t.groupBy("entity").agg(F.avg(x).alias("center"))
    u = t.join(mean, "entity").withColumn("u", F.col(x) - F.col("center"))
    p = lambda k: F.sum(F.pow("u", F.lit(k)))
    m = u.groupBy("entity", "center").agg(
        F.count(F.lit(1)).alias("n"), *(p(k).alias(f"s{k}") for k in (1, 2, 3, 4)), *(F.sum(F.pow("u", F.lit(k)) * F.col(y)).alias(f"y{k}") for k in (0, 1, 2))
    )
    det = lambda a, b, c: f"({a[0]}*({b[1]}*{c[2]}-{b[2]}*{c[1]})-{b[0]}*({a[1]}*{c[2]}-{a[2]}*{c[1]})+{c[0]}*({a[1]}*{b[2]}-{a[2]}*{b[1]}))"
    c0, c1, c2, yy = ("n", "s1", "s2"), ("s1", "s2", "s3"), ("s2", "s3", "s4"), ("y0", "y1", "y2")
    d = det(c0, c1, c2)
    solve = {"c0": det(yy, c1, c2), "c1": det(c0, yy, c2), "c2": det(c0, c1, yy)}
    return m.select("entity", "center", *(F.expr(f"try_divide({e}, {d})").alias(k) for k, e in solve.items()))


#: Fillers that need a panel only.
FILLERS = {"climatology": climatology, "linear": linear, "persistence": persistence}


def by_name(panel: DataFrame, models: list[str]) -> DataFrame:
    """The fills of several models, one after the other, named in ``model``; an unknown name is an error."""
    unknown = sorted(set(models) - set(FILLERS))
    if unknown:
        raise ValueError(f"no such fillers: {', '.join(unknown)}")
    fills = [FILLERS[m](panel).withColumn("model", F.lit(m)) for m in models]
    return reduce(DataFrame.unionByName, fills)
