"""Rules on texts, against hand-written results."""

import pytest

from panelscope.operators import rules

UNITS = {"": 1.0, None: 1.0, "identity": 1.0, "No-Conversion": 1.0, "1.0": 1.0, "knots -> m/s": 0.514444, "knot to metres": 0.514444, "inch_to_mm": 25.4, "inches": None, "* 2.5": 2.5, "multiply_by_ 3": 3.0, "Factor_0.1": 0.1, "×7": 7.0, "x 4": 4.0, "12": 12.0, "12.5": 12.5, "12 cups": None, "a 3 factor 9": 9.0}
STRATA = {"VAL-PNT-B1-T-P30": "point_30pct", "VAL-BLK1-A-B-T-D010": "t_block_10d", "VAL-BLK1-B1-T-D011": None, "VAL-BLK1-T-D010": None, "X-BLK1-B1-T-D010": None, "VAL-SITE-B1-HYDROONLY-D090": "station_outage", None: None}
LABELS = {None: "S0", "": "S0", "none": "S0", "s0+c+a": "S0+A+C", "CAB": "S0+A+B+C", "A,C;D": "S0+A+C+D", '["B"]': "S0+B", "E": None, "A,E": None, "AE": None, "A,CD": None}


@pytest.mark.parametrize("of, cases", [(rules.conversion_factor, UNITS), (rules.condition_stratum, STRATA), (lambda c: rules.coalition_label(c, ["A", "B", "C", "D"]), LABELS)])
def test_texts(spark, of, cases):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = {r["t"]: r["v"] for r in df.select("t", of("t").alias("v")).collect()}
    assert got == cases
