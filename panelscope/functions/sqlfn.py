"""Expressions shared by the operators; all of them stay inside Spark's code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A series of a panel.
SERIES = ["entity", "variable"]


def doy366(d) -> Column:
    """Day of year on a leap calendar, so that a month and day always have one number."""
    return F.dayofyear(F.make_date(F.lit(2000), F.month(d), F.dayofmonth(d)))


def season(d) -> Column:
    m = F.month(d)
    return F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM").when(m.isin(6, 7, 8), "JJA").otherwise("SON")


def hash_rank(*cols) -> Column:
    """A reproducible shuffle key: md5 over the joined texts."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]))


def safe_corr(x: str, y: str, least: int = 3) -> Column:
    """Pearson correlation of the rows where both are present; null for fewer than ``least``
    pairs or a constant side. From centred moments, for ``corr`` fails on constants."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    n = F.count_if(ok)
    a, b = F.when(ok, F.col(x)), F.when(ok, F.col(y))
    return F.when((n >= least) & (F.stddev_pop(a) > 1e-12) & (F.stddev_pop(b) > 1e-12), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def avg_rank(x: str, *by: str) -> Column:
    """Average rank with ties among the non-null values of ``x``."""
    w = Window.partitionBy(*by).orderBy(F.col(x).asc_nulls_last())
    return F.when(F.col(x).isNotNull(), F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / F.lit(2.0))


def islands(df: DataFrame, keys: list[str], order: str, same: Column, out: str = "run_id") -> DataFrame:
    """Number the runs of each key: a row continues the run before it if ``same`` holds."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn(out, F.sum("_new").over(w)).drop("_new")


def true_runs(df: DataFrame, keys: list[str], date: str, flag: str) -> DataFrame:
    """(keys, start_date, end_date, n_days) of contiguous days on which ``flag`` holds."""
    w = Window.partitionBy(*keys).orderBy(date)
    on = df.where(flag).withColumn("_isle", F.date_sub(date, F.row_number().over(w)))
    return on.groupBy(*keys, "_isle").agg(F.min(date).alias("start_date"), F.max(date).alias("end_date"), F.count(F.lit(1)).alias("n_days")).drop("_isle")
