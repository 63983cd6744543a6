"""Closed-form cases of the panel operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelscope.functions.sqlfn import avg_rank, safe_corr
from panelscope.operators import analysis, audit, explore, fillers, gaps, metrics, panel

D0 = dt.date(1995, 1, 1)


def series(spark, values, entity="e", variable="v"):
    rows = [(entity, variable, D0 + dt.timedelta(i), None if v is None else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "entity string, variable string, ts date, value double")
    return panel.with_split(df).withColumn("observed", F.col("value").isNotNull())


def column(df, c, order="ts"):
    return [r[c] for r in df.orderBy(order).collect()]


def test_correlation_guards(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 1.0), (None, 4.0)], "x double, y double")
    assert df.agg(safe_corr("x", "y")).first()[0] is None
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (9.0, None)], "x double, y double")
    assert df.agg(safe_corr("x", "y")).first()[0] == pytest.approx(1)
    assert df.limit(2).agg(safe_corr("x", "y")).first()[0] is None


def test_average_ranks(spark):
    df = spark.createDataFrame([("k", x) for x in (5.0, 1.0, 5.0, None)], "k string, x double").withColumn("r", avg_rank("x", "k"))
    assert sorted((r["x"], r["r"]) for r in df.where("x is not null").collect()) == [(1.0, 1.0), (5.0, 2.5), (5.0, 2.5)]


def test_linear_fills_interior_gaps_only(spark):
    assert column(fillers.linear(series(spark, [None, 1, None, None, 4, None])), "pred") == [None, 1.0, 2.0, 3.0, 4.0, None]


def test_persistence_starts_from_the_training_mean(spark):
    assert column(fillers.persistence(series(spark, [None, 2, None, 4])), "pred") == [3.0, 2.0, 2.0, 4.0]


def test_hidden_cells_score_alone(spark):
    rows = [(0.0, 100.0, False), (1.0, 2.0, True), (2.0, 99.0, None), (3.0, 3.0, True)]
    df = spark.createDataFrame([("k", t, p) for t, p, h in rows if h], "k string, truth double, pred double")
    m = metrics.basic(df, ["k"]).first()
    assert (m["n"], m["mae"], m["bias"]) == (2, 0.5, 0.5) and m["rmse"] == pytest.approx(0.5**0.5)


def test_perfect_flow(spark):
    df = spark.createDataFrame([("k", float(x), float(x)) for x in (1, 2, 4, 8)], "k string, truth double, pred double")
    m = metrics.flow(df, ["k"]).first()
    assert m["nse"] == pytest.approx(1) and m["pbias"] == 0


def test_boundary_jumps(spark):
    p = gaps.hide(series(spark, [0, 1, 2, 3, 4]), series(spark, [0] * 5).where("dayofmonth(ts) in (2, 3)"))
    p = p.withColumn("pred", F.when(F.dayofmonth("ts") == 2, 1.5).when(F.dayofmonth("ts") == 3, 2.5))
    j = metrics.boundary_jumps(p).first()
    assert (j["jump_left"], j["jump_right"]) == (1.5, 0.5)


def test_constant_runs_break_at_gaps(spark):
    obs = series(spark, [1, 1, 1, None, 1, 1, 2]).where("value is not null")
    assert [r["n_days"] for r in audit.constant_runs(obs, 2).orderBy("start_date").collect()] == [3, 2]


def test_point_gaps_take_the_exact_count_and_nest(spark):
    p = series(spark, range(25))
    assert gaps.point_gaps(p, 0.3, 1).count() == 8
    by = {rate: {r["ts"] for r in gaps.nested_points(p, [0.1, 0.5], 1).where(F.col("rate") == rate).collect()} for rate in (0.1, 0.5)}
    assert len(by[0.1]) == 3 and len(by[0.5]) == 13 and by[0.1] < by[0.5]


def test_blocks_are_observed_and_anchors_are_their_centres(spark):
    p = series(spark, [1, 1, None, *[1] * 6])
    assert column(explore.block_starts(p, 5), "ts") == [D0 + dt.timedelta(3), D0 + dt.timedelta(4)]
    assert {r["center_date"] for r in gaps.anchors(p, 5, 9, 1).collect()} == {D0 + dt.timedelta(5), D0 + dt.timedelta(6)}


def test_holm_and_benjamini_hochberg(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, None)], "k int, p double")
    assert column(analysis.holm(df, "p", "k"), "p_holm", "k") == [0.02, 0.04, None]
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03)], "k int, p double").withColumn("f", F.lit(1))
    assert column(analysis.benjamini_hochberg(df, "p", ["f"], "k"), "q_bh", "k") == pytest.approx([0.03, 0.04, 0.04])


def test_shapley_of_additive_weights(spark):
    rows = [("u", m, float(sum(w for i, w in enumerate((1, 2, 3, 4)) if m >> i & 1))) for m in range(16)]
    got = analysis.shapley(spark.createDataFrame(rows, "u string, mask long, v double"), ["u"], "mask", "v", 4)
    assert column(got, "shapley", "player") == pytest.approx([1, 2, 3, 4])


def test_frontier_censoring(spark):
    rows = [("a", 1, 0.9), ("a", 3, 0.1), ("b", 1, -1.0), ("b", 3, 0.9), ("c", 1, 0.9), ("c", 3, 0.8)]
    got = {r["k"]: (r["frontier"], r["censoring"]) for r in analysis.first_loss(spark.createDataFrame(rows, "k string, gap long, s double"), ["k"], "gap", "s", 0.5).collect()}
    assert got["a"] == (pytest.approx(2), "none") and got["b"] == (0.0, "left") and got["c"] == (3.0, "right")


def test_pava_pools_violators(spark):
    df = spark.createDataFrame([("k", 1, 3.0, 1), ("k", 2, 1.0, 1), ("k", 3, 2.0, 1), ("k", 4, 0.0, 2)], "k string, x int, y double, w int")
    assert column(analysis.pava(df, ["k"], "x", "y", "w"), "fit", "x") == pytest.approx([3, 1.5, 1.5, 0])


def test_signed_rank_sums(spark):
    df = spark.createDataFrame([("k", float(d)) for d in (1, -2, 3, 0, 4)], "k string, diff double")
    r = analysis.signed_rank(df, ["k"]).first()
    assert (r["n"], r["w_plus"], r["w_minus"]) == (4, 8.0, 2.0)


def test_rating_curve_recovers_a_parabola(spark):
    df = spark.createDataFrame([("e", float(x), 2 + 3.0 * x + 0.5 * x * x, "train") for x in range(10)], "entity string, L double, F double, split string")
    r = fillers.rating_curve(df, "L", "F").first()
    c = r["center"]
    assert r["c2"] == pytest.approx(0.5) and r["c1"] == pytest.approx(3 + c) and r["c0"] == pytest.approx(2 + 3 * c + 0.5 * c * c)


def test_overlaps_and_clusters(spark):
    iv = spark.createDataFrame([(1, i, D0 + dt.timedelta(a), D0 + dt.timedelta(b)) for i, (a, b) in enumerate([(0, 40), (35, 80), (90, 95)])], "entity int, interval_id int, start_date date, end_date date")
    o = analysis.interval_overlaps(iv).collect()
    assert [(r["interval_id"], r["other_id"], r["overlap_days"]) for r in o] == [(0, 1, 6)]
    assert sorted(r["n_intervals"] for r in analysis.interval_clusters(iv).collect()) == [1, 2]


def test_finalists_never_gather_the_rows(spark):
    from panelscope.operators import design

    rows = [("a", 1.0), ("b", 1.05), ("c", 3.0), ("d", 2.0), ("e", None)]
    got = design.finalists(spark.createDataFrame(rows, "model string, score double"), "model", "score", 0.1, ["c"])
    assert got.columns == ["model", "score", "reason"]
    assert {r["model"]: r["reason"] for r in got.collect()} == {"a": "within_margin", "b": "within_margin", "c": "mandatory", "d": "dropped", "e": "dropped"}
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_pava_blocks_of_one_mean_are_one_block(spark):
    # (2 * 0.1 + 0.4) / 3 is above 0.2 by its last bit
    df = spark.createDataFrame([("a", 1, 0.1, 2), ("a", 2, 0.4, 1), ("a", 3, 0.2, 1), ("a", 4, 0.1, 1)], "k string, x int, y double, w int")
    assert column(analysis.pava(df, ["k"], "x", "y", "w"), "block", "x") == [0, 0, 0, 1]
