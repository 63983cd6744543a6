"""Tail probabilities and tests against plain arithmetic."""

import math
from itertools import product

import pytest
from pyspark.sql import functions as F

from panelscope.functions import distributions as dist
from panelscope.operators import inference


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, " + ", ".join(f"v{k} double" for k in range(len(values[0]))))
    return [r[0] for r in rows.orderBy("i").select(expr).collect()]


def test_normal_tail(spark):
    zs = [0.0, 0.1, 1.0, 1.959963984540054, 3.4, 3.6, 5.0, 8.0, -2.0, 30.0]
    for z, p in zip(zs, column(spark, [(z,) for z in zs], dist.normal_two_sided(F.col("v0"))), strict=True):
        assert p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-9)


def student(t, n):
    """By Simpson's rule over the angle whose tangent is t / sqrt(n)."""
    f = lambda a, b, k=20_000: sum((1 if i in (0, k) else 4 if i % 2 else 2) * math.cos(a + (b - a) * i / k) ** (n - 1) for i in range(k + 1)) * (b - a) / k / 3
    return f(math.atan(abs(t) / math.sqrt(n)), math.pi / 2) / f(0, math.pi / 2)


def test_student_tail(spark):
    cases = [(0.0, 5), (0.5, 1), (12.7062047364, 1), (2.0, 3), (-2.5, 10), (1.1, 40), (6.0, 7), (0.01, 200)]
    for (t, n), p in zip(cases, column(spark, [(t, float(n)) for t, n in cases], dist.student_two_sided(F.col("v0"), F.col("v1"))), strict=True):
        assert p == pytest.approx(student(t, n), rel=1e-7)


def ranks(a):
    return [sum(x < v for x in a) + (sum(x == v for x in a) + 1) / 2 for v in a]


def test_signed_rank_exact_by_all_signs(spark):
    sets = {"a": [1.5, -0.3, 2.2, 0.7, -1.1, 3.0], "b": [0.1, 0.2, 0.3], "c": [-1.0, 2.0, -3.0, 4.0, 5.0, -6.0, 7.0, 8.5]}
    got = {r["g"]: r for r in inference.signed_rank_test(spark.createDataFrame([(g, d) for g, ds in sets.items() for d in ds], "g string, diff double"), ["g"]).collect()}
    for g, ds in sets.items():
        rk = ranks([abs(d) for d in ds])
        w = min(sum(r for r, d in zip(rk, ds, strict=True) if d > 0), sum(r for r, d in zip(rk, ds, strict=True) if d < 0))
        upto = sum(sum(r for r, s in zip(rk, signs, strict=True) if s) <= w for signs in product((0, 1), repeat=len(ds))) / 2 ** len(ds)
        assert got[g]["method"] == "exact" and got[g]["statistic"] == w and got[g]["p_value"] == pytest.approx(min(1, 2 * upto))


def test_signed_rank_of_ties_zeros_and_nothing(spark):
    rows = [("ties", d) for d in (1.0, 1.0, -1.0, 2.0, 3.0)] + [("zeros", d) for d in (0.0, 1.0, -2.0)] + [("equal", 0.0), ("equal", 1e-12)] + [("equal", None)] + [("many", float(i + 1)) for i in range(60)]
    got = {r["g"]: r for r in inference.signed_rank_test(spark.createDataFrame(rows, "g string, diff double"), ["g"]).collect()}
    # ranks 2, 2, 2, 4, 5: minus 2, plus 13; variance 5*6*11/24 - 24/48
    z = (2 - 7.5) / math.sqrt(5 * 6 * 11 / 24 - 24 / 48)
    assert got["ties"]["method"] == "normal" and got["ties"]["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
    assert got["zeros"]["method"] == "normal" and got["zeros"]["n"] == 2
    assert (got["equal"]["method"], got["equal"]["p_value"], got["equal"]["n_pairs"]) == ("all_equal", 1.0, 2)
    assert got["many"]["method"] == "normal" and got["many"]["p_value"] < 1e-10
