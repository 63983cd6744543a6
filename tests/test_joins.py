"""Small cases of the pairing, resampling and anchor operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelscope.operators import fillers, joins, resampling

DAY = dt.date(1998, 1, 1)


def day(k):
    return DAY + dt.timedelta(k)


def test_one_hinge_finds_an_exact_bend(spark):
    rows = [("a", x, 2.0 * x - 3.0 * max(x - 4, 0), 1.0) for x in range(1, 9)] + [("short", 1, 1.0, 1.0), ("short", 2, 1.0, 1.0)]
    got = joins.one_hinge(spark.createDataFrame(rows, "g string, x int, y double, w double"), ["g"], "x", "y", "w").collect()
    assert [r["g"] for r in got] == ["a"]
    assert (got[0]["bend"], round(got[0]["slope"], 6), round(got[0]["change"], 6), got[0]["sse"]) == (4.0, 2.0, -3.0, 0.0)


def test_permuted_donors_give_every_entity_another(spark):
    df = spark.createDataFrame([(e, i) for e in "abcd" for i in range(2)], "entity string, i int")
    got = joins.permuted_donors(df, "entity", 1).collect()
    assert len(got) == 8 and all(r["entity"] != r["donor"] for r in got)
    assert {r["donor"] for r in got} == set("abcd")


def test_cluster_bootstrap_of_equal_values_has_no_width(spark):
    df = spark.createDataFrame([("a", c, 5.0) for c in range(9) for _ in range(c + 1)] + [("a", 3, None)], "g string, c int, v double")
    r = resampling.bootstrap_mean(df, ["g"], "c", "v", 50, 7).first()
    assert (r["n_clusters"], r["estimate"], r["ci_lower"], r["ci_upper"]) == (9, 5.0, 5.0, 5.0)


def test_anchor_independence(spark):
    a = spark.createDataFrame([("a", "x", day(k)) for k in (10, 15, 40)], "entity string, variable string, center_date date")
    r = joins.anchor_independence(a, 10).first()
    assert (r["n_anchors"], r["n_overlapping"], r["days"], r["effective_n"]) == (3, 2, 25, 2.5)


def test_anchors_on_a_version_that_lacks_a_day(spark):
    s = "entity string, variable string, ts date, value double"
    one = spark.createDataFrame([("a", "x", day(k), 1.0) for k in range(20)], s)
    two = one.withColumn("value", F.when(F.col("ts") != day(7), F.col("value")))
    a = spark.createDataFrame([("a", "x", day(6)), ("a", "x", day(14))], "entity string, variable string, center_date date")
    got = {r["center_date"]: (r["present"], r["available"]) for r in joins.anchor_availability(a, two, 5).collect()}
    assert got == {day(6): (4, False), day(14): (5, True)}
    same = {r["center_date"]: (r["changed"], r["equivalent"]) for r in joins.anchor_bridge(a, one, two, 5).collect()}
    assert same == {day(6): (1, False), day(14): (0, True)}


def test_feasibility_names_the_series_without_a_place(spark):
    p = spark.createDataFrame([("a", "x", day(k), k % 3 != 2) for k in range(9)], "entity string, variable string, ts date, observed boolean")
    assert {r["length"]: (r["starts"], r["feasible"]) for r in joins.feasibility(p, [2, 3]).collect()} == {2: (3, True), 3: (0, False)}


def test_evaluated_leaves_out_what_is_not_finite(spark):
    rows = [(True, True, 1.0, 2.0), (True, True, 1.0, float("nan")), (True, True, float("inf"), 1.0), (True, True, None, 1.0), (False, True, 1.0, 1.0), (True, False, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "ok boolean, hidden boolean, truth double, pred double")
    assert joins.evaluated(df, F.col("ok")).count() == 1


def test_unknown_filler_is_an_error(spark):
    with pytest.raises(ValueError, match="oracle"):
        fillers.by_name(spark.createDataFrame([], "entity string"), ["linear", "oracle"])
