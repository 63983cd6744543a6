"""Queries on information between series, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F


from panelscope.operators import explore, information
from panelscope.plans.catalog import SEED, SHIP, _add, _ship, r
from panelscope.sources import adapters
from panelscope.sources.storage import stored

_PAIRS = """pq AS (SELECT entity, variable, x, y FROM (SELECT entity, ts, "T" AS y, "F", "L" FROM days) UNPIVOT (x FOR variable IN ("F", "L")))"""


@_add("v7_mutual_information", f"""{SHIP}, {_PAIRS}, sc AS (SELECT entity, variable, count(*) AS n, stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM pq GROUP BY ALL), p AS MATERIALIZED (SELECT entity, variable, row_number() OVER () AS i, CAST(round(x / sx * 1e9) AS BIGINT) AS u, CAST(round(y / sy * 1e9) AS BIGINT) AS v FROM pq JOIN sc USING (entity, variable)),
d AS (SELECT a.entity, a.variable, a.i, a.u, a.v, min(greatest(abs(a.u - b.u), abs(a.v - b.v)), 5)[5] AS r FROM p a JOIN p b ON a.entity = b.entity AND a.variable = b.variable AND a.i <> b.i GROUP BY ALL),
c AS (SELECT d.entity, d.variable, d.i, count(*) FILTER (abs(d.u - b.u) < r OR (r = 0 AND d.u = b.u)) AS nu, count(*) FILTER (abs(d.v - b.v) < r OR (r = 0 AND d.v = b.v)) AS nv FROM d JOIN p b ON d.entity = b.entity AND d.variable = b.variable GROUP BY ALL),
h AS (SELECT m, coalesce(sum(1.0 / (m - 1)) FILTER (m > 1) OVER (ORDER BY m), 0) AS h FROM range(1, 1 + (SELECT max(n) FROM sc)) t(m))
SELECT c.entity, c.variable, any_value(sc.n) AS n, {r('greatest(any_value(hn.h) + (1 + 1 / 2.0 + 1 / 3.0 + 1 / 4.0) - avg(a.h + b.h), 0)', 'mi')} FROM c JOIN h a ON a.m = nu JOIN h b ON b.m = nv JOIN sc ON sc.entity = c.entity AND sc.variable = c.variable JOIN h hn ON hn.m = sc.n GROUP BY c.entity, c.variable""")
def _(spark, sf_dir):
    wide = adapters.ship_days(spark, sf_dir)
    pairs = wide.unpivot(["entity", "ts", "T"], ["F", "L"], "variable", "x")
    return information.mutual_information(pairs, ["entity", "variable"], "x", "T")


# No twin: the shifts of the null come from a hash that DuckDB lacks; tests hold it against counting by hand.


@_add("v11_information_table", None)
def _(spark, sf_dir):
    p = explore.mean_anomaly(stored(_ship(spark, sf_dir).where("split = 'train'"), "train"))
    return information.information_table(p.withColumn("x", F.round("anomaly", 9)), "T", seed=SEED)
