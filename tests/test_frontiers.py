"""Frontier summaries, dual frontiers and event extremes on small tables worked out by hand."""

import datetime as dt

import pytest

from panelscope.operators import frontiers, joins

GAPS = [1, 2, 3, 4]


def curves(spark, rows):
    """rows: (model, unit, skills at GAPS; None where it was not asked)."""
    long = [(m, u, g, s) for m, u, ss in rows for g, s in zip(GAPS, ss, strict=True)]
    return spark.createDataFrame(long, "model string, unit string, gap long, skill double")


def test_summary_by_hand(spark):
    rows = [("a", f"u{i}", [0.8, 0.5, 0.2, -0.2]) for i in range(3)]
    rows += [("a", "lacks", [9.0, None, 9.0, 9.0]), ("b", "u0", [0.5, None, 0.3, 0.2]), ("c", "u0", [0.5, None, 0.5, 0.5]), ("c", "u1", [None, 0.5, None, None]), ("d", "one", [0.4, 0.3, 0.2, 0.1]), ("e", "u0", [-0.1, 0.5, 0.5, 0.5]), ("e", "u1", [-0.1, 0.5, 0.5, 0.5]), ("f", "u0", [None] * 4)]
    got, curve = frontiers.frontier_summary(curves(spark, rows), ["model"], "unit", "gap", "skill", GAPS, 50, 1)
    s = {r["model"]: r for r in got.collect()}
    assert sorted(s) == ["a", "b", "c", "d", "e"]  # no value, no row

    a = s["a"]
    assert (a["n_units"], a["n_incomplete"], a["missing_gaps"], a["grid_complete"], a["reason"]) == (3, 1, "", True, None)
    for c in ("statistical_frontier", "mean_frontier", "ci_lower", "ci_upper"):
        assert a[c] == pytest.approx(3.5)  # all units alike: every draw is the curve itself
    assert (a["statistical_censoring"], a["mean_censoring"], a["left_censored"], a["right_censored"]) == ("none", "none", 0, 0)
    assert (a["breakpoint"], a["breakpoint_sse"]) == (3, pytest.approx(0, abs=1e-9))

    assert (s["b"]["missing_gaps"], s["b"]["reason"], s["b"]["mean_frontier"], s["b"]["breakpoint"]) == ("2", "no value at gaps 2", None, None)
    assert (s["c"]["n_units"], s["c"]["n_incomplete"], s["c"]["reason"], s["c"]["statistical_frontier"]) == (0, 2, "no whole curve", None)
    assert (s["d"]["mean_frontier"], s["d"]["mean_censoring"], s["d"]["ci_lower"], s["d"]["statistical_frontier"]) == (4.0, "right", None, None)
    assert (s["e"]["mean_frontier"], s["e"]["mean_censoring"], s["e"]["left_censored"]) == (0.0, "left", 50)

    c = {(r["model"], r["gap"]): r for r in curve.collect()}
    assert c["a", 2]["mean"] == pytest.approx(0.5) and c["a", 2]["n"] == 3 and c["d", 1]["ci_lower"] is None
    assert sorted(k for k in c if k[0] == "b") == [("b", 1), ("b", 3), ("b", 4)] and not [k for k in c if k[0] == "c"]


def test_repeats_off_grid_gaps_and_extra_columns(spark):
    rows = curves(spark, [("a", "u0", [0.8, 0.5, 0.2, -0.2]), ("a", "u1", [0.8, 0.5, 0.2, -0.2])])
    more = rows.unionByName(rows).unionByName(spark.createDataFrame([("a", "u0", 9, -5.0)], rows.schema))
    more = more.selectExpr("*", "'x' AS n", "1 AS frontier", "2 AS reason")
    got = frontiers.frontier_summary(more, ["model"], "unit", "gap", "skill", GAPS, 20, 1)[0].collect()
    assert len(got) == 1 and (got[0]["n_units"], got[0]["mean_frontier"]) == (2, pytest.approx(3.5))


def test_dual_frontiers_are_the_summaries_of_each_denominator(spark):
    r = [("a", f"u{i}", [0.6 + i / 50, 0.3, 0.1 - i / 20, -0.1]) for i in range(4)]
    two = curves(spark, r).selectExpr("model", "unit", "gap", "skill AS one", "IF(gap = 4, NULL, skill - 0.2) AS other")
    got = frontiers.dual_frontiers(two, ["model"], "unit", "gap", {"x": "one", "y": "other"}, GAPS, 40, 7)[0]
    s = {r["denominator"]: r for r in got.collect()}
    assert sorted(s) == ["x", "y"] and s["y"]["reason"] == "no value at gaps 4" and s["x"]["mean_frontier"] == pytest.approx(3 + 0.025 / 0.125)


def test_curves_alone_draw_no_whole_curves(spark, monkeypatch):
    rows = curves(spark, [("a", f"u{i}", [0.8, 0.5, 0.2, -0.2 - i]) for i in range(5)])
    want = frontiers.frontier_summary(rows, ["model"], "unit", "gap", "skill", GAPS, 20, 1)[1].collect()
    monkeypatch.setattr(frontiers, "frontier_interval", None)
    assert sorted(frontiers.paired_curves(rows, ["model"], "unit", "gap", "skill", GAPS, 20, 1).collect()) == sorted(want)


def test_no_rows_no_frontier(spark):
    got, curve = frontiers.frontier_summary(curves(spark, []), ["model"], "unit", "gap", "skill", GAPS, 5, 1)
    assert got.count() == 0 and curve.count() == 0


def test_event_extrema_by_hand(spark):
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(i)
    cells = [(1.0, 2.0), (5.0, 4.0), (3.0, 4.0), (0.5, 1.0), (None, 9.0), (2.0, None), (2.0, float("nan"))]
    scored = spark.createDataFrame([("s", "T", day(i), t, p) for i, (t, p) in enumerate(cells)], "entity string, variable string, ts date, truth double, pred double")
    rows = [("s", "T", "hot", day(0), day(6), day(1), None), ("s", "T", "low", day(0), day(6), None, day(3)), ("s", "T", "outside", day(2), day(3), day(1), day(0)), ("s", "T", "both", day(1), day(3), day(2), day(2)), ("s", "T", "bare", day(4), day(6), day(4), day(5)), ("z", "T", "hot", day(0), day(6), day(1), None)]
    ep = spark.createDataFrame(rows, "entity string, variable string, id string, start_date date, end_date date, peak_day date, low_day date")
    got = {(r["entity"], r["id"]): r for r in joins.event_extrema(ep, scored, ["id"]).collect()}
    value = lambda k: tuple(got[k][c] for c in ("n", "peak_magnitude_error", "peak_timing_days", "low_magnitude_error", "low_timing_days", "peak_error", "timing_error"))
    assert value(("s", "hot")) == (4, -1.0, 0, None, None, -1.0, 0)
    assert value(("s", "low")) == (4, None, None, 0.5, 0, 0.5, 0)
    assert value(("s", "outside")) == (2, None, None, None, None, None, None)
    assert value(("s", "both")) == (3, 1.0, 1, -2.0, 1, 1.0, 1)
    assert value(("s", "bare")) == value(("z", "hot")) == (0, None, None, None, None, None, None)
