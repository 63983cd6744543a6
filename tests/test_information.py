"""Information between series against counting by hand."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelscope.operators import information


def psi(m):
    return -0.5772156649015329 + sum(1 / i for i in range(1, m))


def brute_mi(x, y, k):
    u, v = (np.rint(np.array(c) / np.std(c) * information.UNIT).astype(np.int64) for c in (x, y))
    n, out = len(u), 0.0
    for i in range(n):
        du, dv = np.abs(u - u[i]), np.abs(v - v[i])
        r = np.sort(np.delete(np.maximum(du, dv), i))[k - 1]
        out += sum(psi(int(((d < r) | ((r == 0) & (d == 0))).sum())) for d in (du, dv))
    return max(0.0, psi(n) + psi(k) - out / n)


def brute_te(s, y, lag):
    rows = [(y[i], y[i - 1], s[i - lag]) for i in range(lag, len(y)) if min(y[i], y[i - 1], s[i - lag]) >= 0]
    a, b, c, d = Counter(rows), Counter((p, q) for _, p, q in rows), Counter((f, p) for f, p, _ in rows), Counter(p for _, p, _ in rows)
    return max(0.0, sum(m / len(rows) * math.log(m / b[p, q] / (c[f, p] / d[p])) for (f, p, q), m in a.items())), len(rows)


def test_digamma(spark):
    got = [r[0] for r in spark.range(1, 300).select(information.digamma(F.col("id"))).collect()]
    assert np.allclose(got, [psi(m) for m in range(1, 300)], atol=1e-12)


def test_mutual_information_with_ties_crowds_and_outliers(spark):
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=80), np.zeros(60), [1e6]])
    sets = {"close": (x, x + r.normal(scale=0.1, size=141)), "free": (x, r.normal(size=141)), "ties": (x, np.round(r.normal(size=141))), "same": (np.repeat([0.0, 1.0], [70, 71]), np.repeat([0.0, 2.0], [70, 71]))}
    rows = [(k, float(a), float(b)) for k, (p, q) in sets.items() for a, b in zip(p, q, strict=True)] + [("few", 1.0, 2.0)] * 3 + [("flat", 1.0, float(i)) for i in range(9)] + [("close", None, 1.0)]
    got = {g["g"]: g for g in information.mutual_information(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()}
    for k, (p, q) in sets.items():
        assert got[k]["n"] == 141 and got[k]["mi"] == pytest.approx(brute_mi(p, q, 5), abs=1e-9), k
    assert got["close"]["mi"] > got["free"]["mi"] and got["few"]["mi"] is None and got["flat"]["mi"] is None


def test_entropies_against_counting(spark):
    r = np.random.default_rng(2)
    y = r.integers(-1, 4, 90)
    rows = [("a", r.integers(-1, 4, 90).tolist(), y.tolist(), 2, [3, 50, 89]), ("b", np.roll(y, -1).tolist(), y.tolist(), 1, [7] * 5), ("short", [1], [1], 1, [1]), ("flat", [1] * 9, [0, 1, 2, 0, 1, 2, 0, 1, 2], 1, [2])]
    got = information.entropies(spark.createDataFrame(rows, "k string, s array<int>, t array<int>, lag int, h array<int>"), "s", "t", "lag", "h", 4).collect()
    for g, (_, s, t, lag, shifts) in zip(got[:2], rows[:2], strict=True):
        te, n = brute_te(s, t, lag)
        null = [brute_te(np.roll(s, h).tolist(), t, lag)[0] for h in shifts]
        assert g["n"] == n and g["te"] == pytest.approx(te) and g["null_mean"] == pytest.approx(np.mean(null))
        assert g["p_value"] == pytest.approx((1 + sum(x >= te - 1e-12 for x in null)) / (len(null) + 1))
    assert [g["te"] is None or math.isnan(g["te"]) for g in got[2:]] == [True, True]


def test_information_table_tests_each_hypothesis_once(spark):
    r = np.random.default_rng(1)
    rows = [(e, v, f"2000-01-{d + 1:02d}" if d < 31 else f"2000-02-{d - 30:02d}", None if (d + len(v)) % 13 == 0 else float(r.normal())) for e in "AB" for v in ("T", "F") for d in range(55)]
    df = spark.createDataFrame(rows, "entity string, variable string, ts string, x double").withColumn("ts", F.to_date("ts"))
    got = information.information_table(df, "T", lags=(1, 2), draws=9).toPandas()
    # each of two targets: own F, and T and F of the other; a row for MI and two directions of two lags
    assert len(got) == 2 * 3 * (1 + 4)
    te = got[got.metric == "transfer_entropy"]
    assert int(te.hypothesis_duplicate.sum()) == 4  # T of A and T of B are each other's source
    assert te.p_value.between(0.1, 1).all() and (te.p_adjusted >= te.p_value - 1e-12).all()
