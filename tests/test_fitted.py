"""Fitted fillers on small panels with a known answer."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from panelscope.operators import regression, trees
from panelscope.operators.regression import Design


@pytest.fixture(scope="module")
def wide(spark):
    """Two entities whose target is a line in x and a wave of the year; x absent now and then."""
    r, rows = random.Random(3), []
    for e, slope in (("a", 2.0), ("b", -1.0)):
        for i in range(900):
            d = dt.date(1996, 1, 1) + dt.timedelta(i)
            x = r.gauss(0, 1)
            wave = 3 * math.sin(2 * math.pi * (d.timetuple().tm_yday - 1) / (366 if d.year % 4 == 0 else 365))
            rows.append((e, d, "train" if i < 600 else "test", None if i % 50 == 7 else x, 5 + slope * x + wave, 1.0))
    return spark.createDataFrame(rows, "entity string, ts date, split string, x double, y double, flat double").cache()


def rmse(df, target="y"):
    return df.where("split = 'test' and x is not null").agg(F.sqrt(F.avg(F.pow(F.col("pred") - F.col(target), 2)))).first()[0]


def test_ridge_finds_line_and_wave(wide):
    assert rmse(regression.seasonal_ridge(wide, "y", Design(("x", "flat")))) < 0.05


def test_pooled_model_cannot_know_an_entity_of_another_slope(wide):
    got = regression.pooled_leave_one_out(wide, "y", Design(("x",)))
    assert rmse(got) > 1 and got.where("pred is null").count() == 0


def test_forbidden_and_own_column_are_errors(wide):
    for design in (Design(("x", "flat")), Design(("y",))):
        with pytest.raises(ValueError, match="forbidden"):
            regression.seasonal_ridge(wide, "y", design, forbidden="flat")
    with pytest.raises(ValueError, match="forbidden"):
        trees.fit(wide, "y", Design(("y",)), trees.forest(5))


def test_features_that_are_never_there_count_as_nothing(wide):
    got = regression.seasonal_ridge(wide.withColumn("none", F.lit(None).cast("double")), "y", Design(("x", "none")))
    assert rmse(got) < 0.05


@pytest.mark.parametrize("learner", [lambda: trees.forest(20, depth=8), lambda: trees.boosting(25, step=0.3)])
def test_trees_beat_the_mean_on_held_out_days(wide, learner):
    design = Design(("x",))
    got = trees.predict(wide, trees.fit(wide, "y", design, learner()), design)
    spread = wide.where("split = 'test'").agg(F.stddev_pop("y")).first()[0]
    assert rmse(got) < 0.6 * spread


def test_moved_donors_are_found_at_their_lag(spark):
    r = random.Random(5)
    x = [r.gauss(0, 1) for _ in range(400)]
    day = lambda i: dt.date(1997, 1, 1) + dt.timedelta(i)
    rows = [("a", day(i), x[i], "train") for i in range(400)] + [("b", day(i), x[i - 3], "train") for i in range(3, 400)] + [("c", day(i), 1.0, "train") for i in range(400)]
    lags = {(g["source"], g["target"]): (g["lag"], g["r"]) for g in regression.best_lags(spark.createDataFrame(rows, "entity string, ts date, value double, split string"), range(-5, 6)).collect()}
    assert lags["a", "b"][0] == 3 and lags["b", "a"][0] == -3 and lags["a", "b"][1] == pytest.approx(1)
    assert lags["a", "c"] == (0, None)
