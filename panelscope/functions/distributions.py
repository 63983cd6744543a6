"""Tail probabilities as expressions inside Spark: normal, Student's t, and the signed-rank sum."""

from __future__ import annotations

from math import log, pi, sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fold(first: int, last: int, start: Column, step) -> Column:
    """``step(accumulated, k)`` over whole numbers, as doubles, from first to last."""
    return F.aggregate(F.sequence(F.lit(first), F.lit(last), F.lit(1 if first <= last else -1)), start.cast("double"), lambda acc, k: step(acc, k.cast("double")))


def erfc(x: Column) -> Column:
    """For x of 0 or more: below 2.5 one less the series of positive terms, beyond it the continued
    fraction from its 80th level; relative error under 1e-11."""
    small = F.least(x, F.lit(2.5))
    # sum of (2x^2)^k / (3 5 ... (2k + 1)) by Horner's rule, from the last term in
    series = _fold(70, 1, F.lit(1.0), lambda acc, k: 1 + acc * 2 * small * small / (2 * k + 1))
    large = F.greatest(x, F.lit(2.5))
    fraction = _fold(80, 1, F.lit(1.0), lambda acc, k: 1 + k / (2 * large * large) / acc)
    near = 1 - 2 / sqrt(pi) * small * F.exp(-small * small) * series
    return F.when(x < 2.5, near).otherwise(F.exp(-large * large) / (large * sqrt(pi)) / fraction)


def normal_two_sided(z: Column) -> Column:
    return erfc(F.abs(z) / sqrt(2))


def lgamma(x: Column) -> Column:
    """Of positive numbers: Stirling's series ten steps on."""
    y = x + 10
    stirling = (y - 0.5) * F.log(y) - y + 0.5 * log(2 * pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return stirling - sum((F.log(x + i) for i in range(10)), F.lit(0.0))


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """Regularised, by its continued fraction from the 200th pair of levels, on the side where that
    converges; exact at 0 and 1."""

    def side(x, a, b):
        def pair(acc, m):
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return 1 + even / (1 + odd / acc)

        inner = _fold(200, 1, F.lit(1.0), pair)
        whole = 1 - (a + b) * x / (a + 1) / inner
        front = F.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * F.log(x) + b * F.log(1 - x))
        return front / a / whole

    inside = F.when(x < (a + 1) / (a + b + 2), side(x, a, b)).otherwise(1 - side(1 - x, b, a))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


def student_two_sided(t: Column, df: Column) -> Column:
    return incomplete_beta(df / (df + t * t), df.cast("double") / 2, F.lit(0.5))


def signed_rank_null(spark: SparkSession, most: int = 50) -> DataFrame:
    """(n, upto): for each number of untied pairs up to ``most`` the chance that the rank sum is at
    most 0, 1, 2, ... : how many subsets of 1 to n have each sum, one rank after the other."""
    counts = F.aggregate(
        F.sequence(F.lit(1), F.col("n")),
        F.array(F.lit(1.0)),
        lambda c, k: F.transform(F.sequence(F.lit(0), F.size(c) + k - 1), lambda i: F.coalesce(F.get(c, i), F.lit(0.0)) + F.when(i >= k, F.coalesce(F.get(c, i - k), F.lit(0.0))).otherwise(0.0)),
    )
    rows = spark.range(1, most + 1).select(F.col("id").cast("int").alias("n")).withColumn("_c", counts)
    upto = F.transform("_c", lambda _, i: F.aggregate(F.slice("_c", F.lit(1), i + 1), F.lit(0.0), lambda a, v: a + v) / F.pow(F.lit(2.0), F.col("n")))
    return rows.select("n", upto.alias("upto"))
