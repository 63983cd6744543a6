"""Queries on scenario design, thresholds, gap shapes and selection, with their SQL twins."""

from __future__ import annotations

from panelscope.operators import design, explore
from panelscope.plans.catalog import _DOY, _SEASON, _STARTS, EV, ORDERS, SEED, SHIP, _add, _orders, _ship, r
from panelscope.sources import adapters

_T = f"t AS (SELECT entity, variable, value, {_DOY} AS d FROM panel WHERE split = 'train' AND value IS NOT NULL)"


@_add("r12_scenario_grid", f"{ORDERS} SELECT entity, CAST(rate AS DOUBLE) AS rate, CAST(len AS BIGINT) AS length, CAST(seed AS BIGINT) AS mask_seed, concat_ws('-', entity, CAST(rate AS VARCHAR), CAST(len AS VARCHAR), CAST(seed AS VARCHAR)) AS scenario_id FROM (SELECT DISTINCT entity FROM obs), (VALUES (0.1), (0.3), (0.5)) a(rate), (VALUES (10), (30), (90)) b(len), (VALUES (1), (2)) c(seed)")
def _(spark, sf_dir):
    return design.scenario_grid(adapters.order_panel(spark, sf_dir), [0.1, 0.3, 0.5], [10, 30, 90], [1, 2])


@_add("e3_local_threshold", f"""{ORDERS}, {_T}, m AS (SELECT entity, variable, ((d - 1 + o + 366) % 366) + 1 AS doy, avg(value) AS mean FROM t, (SELECT unnest(range(-7, 8)) AS o) GROUP BY ALL),
a AS (SELECT t.entity, t.variable, t.d, value - mean AS a FROM t JOIN m ON t.entity = m.entity AND t.variable = m.variable AND t.d = m.doy),
q AS (SELECT entity, variable, ((d - 1 + o + 366) % 366) + 1 AS doy, count(*) AS n, quantile_cont(a, 0.9) AS q FROM a, (SELECT unnest(range(-15, 16)) AS o) GROUP BY ALL HAVING count(*) >= 30)
SELECT entity, variable, doy, n, {r('mean')}, {r('m.mean + q', 'threshold')} FROM q JOIN m USING (entity, variable, doy)""")
def _(spark, sf_dir):
    return design.local_threshold(_orders(spark, sf_dir), 0.9).drop("q")


@_add("a2_code_counts", f"{ORDERS} SELECT entity, CAST(c AS DOUBLE) AS code, count(*) FILTER (abs(value - c) <= 1e-9) AS n FROM obs, (VALUES (1), (2), (99)) v(c) GROUP BY ALL")
def _(spark, sf_dir):
    return design.code_counts(adapters.order_panel(spark, sf_dir), ["entity"], "value", [1, 2, 99])


@_add("g11_state_labels", f"""{SHIP}, sp AS (SELECT *, {_SEASON} AS season FROM panel), a AS (SELECT entity, variable, season, quantile_cont(value, 1 / 3) AS lo, quantile_cont(value, 2 / 3) AS hi FROM sp WHERE split = 'train' AND value IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
b AS (SELECT entity, variable, quantile_cont(value, 1 / 3) AS lo, quantile_cont(value, 2 / 3) AS hi FROM sp WHERE split = 'train' GROUP BY ALL),
l AS (SELECT sp.entity, sp.variable, sp.season, CASE WHEN value IS NULL THEN NULL WHEN value <= coalesce(a.lo, b.lo) THEN 'low' WHEN value <= coalesce(a.hi, b.hi) THEN 'normal' ELSE 'high' END AS state FROM sp LEFT JOIN a USING (entity, variable, season) LEFT JOIN b ON b.entity = sp.entity AND b.variable = sp.variable)
SELECT entity, variable, season, state, count(*) AS n FROM l GROUP BY ALL""")
def _(spark, sf_dir):
    return design.state_labels(_ship(spark, sf_dir)).groupBy("entity", "variable", "season", "state").count().withColumnRenamed("count", "n")


@_add("g6_network_outage", f"{SHIP}, {_STARTS.format(n=9)} SELECT 'F' AS variable, ts AS start_date, ts + 9 AS end_date FROM starts WHERE variable = 'F' GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT entity) FROM obs) ORDER BY md5(concat_ws('|', '{SEED}', CAST(ts AS VARCHAR))) LIMIT 1", dates="start_date end_date")
def _(spark, sf_dir):
    return design.network_outage(_ship(spark, sf_dir), "F", 10, SEED)


@_add("r9_sliding_counts", f"{SHIP} SELECT entity, variable, split, n_days, CAST(s AS BIGINT) AS size, greatest(n_days - s + 1, 0) AS windows FROM (SELECT entity, variable, split, count(*) AS n_days FROM panel GROUP BY ALL), (VALUES (184), (368), (736)) v(s)")
def _(spark, sf_dir):
    return design.sliding_counts(_ship(spark, sf_dir), [184, 368, 736])


@_add("i6_donor_lags", f"""{SHIP}, t AS (SELECT entity, ts, value FROM panel WHERE variable = 'T' AND split = 'train' AND value IS NOT NULL),
p AS (SELECT a.entity AS source, b.entity AS target, CAST(l AS BIGINT) AS lag, a.value AS x, b.value AS y FROM t a, (SELECT unnest(range(-7, 8)) AS l), t b WHERE b.ts = a.ts + CAST(l AS INT) AND a.entity <> b.entity),
c AS (SELECT source, target, lag, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END, 9) AS r FROM p GROUP BY ALL) SELECT source, target, lag, n, {r('r')} FROM c QUALIFY row_number() OVER (PARTITION BY target ORDER BY abs(c.r) DESC NULLS LAST, abs(lag), lag DESC, source) = 1""")
def _(spark, sf_dir):
    return design.donor_lags(explore.best_lags(_ship(spark, sf_dir), "T", 7))


@_add("i4_ridge_line", f"{EV} SELECT model, gap, count(*) AS n, {r('count(*) * covar_pop(mae_clim, mae) / ((count(*) + 1.0) * var_pop(mae_clim))', 'slope')}, {r('avg(mae) - count(*) * covar_pop(mae_clim, mae) / ((count(*) + 1.0) * var_pop(mae_clim)) * avg(mae_clim)', 'intercept')} FROM ev GROUP BY ALL")
def _(spark, sf_dir):
    return design.simple_regression(adapters.eval_table(spark, sf_dir), ["model", "gap"], "mae_clim", "mae", 1.0)


@_add("k2_finalists", f"{EV}, s AS (SELECT CAST(anchor AS VARCHAR) AS model, round(avg(mae), 9) AS score FROM ev GROUP BY ALL) SELECT model, {r('score')}, CASE WHEN s.score <= (SELECT min(score) FROM s) + 0.2 THEN 'within_margin' WHEN model IN ('1', '2') THEN 'mandatory' ELSE 'dropped' END AS reason FROM s")
def _(spark, sf_dir):
    from pyspark.sql import functions as F

    s = adapters.eval_table(spark, sf_dir).groupBy(F.col("anchor").cast("string").alias("model")).agg(F.round(F.avg("mae"), 9).alias("score"))
    return design.finalists(s, "model", "score", 0.2, ["1", "2"])


@_add("i3_pchip", f"""{ORDERS}, a AS (SELECT entity, variable, datediff('day', DATE '1970-01-01', ts) AS t, value AS v, lead(datediff('day', DATE '1970-01-01', ts)) OVER w - datediff('day', DATE '1970-01-01', ts) AS h, lead(value) OVER w - value AS dv FROM obs WINDOW w AS (PARTITION BY entity, variable ORDER BY ts)),
b AS (SELECT *, dv / h AS s FROM a), c AS (SELECT *, lag(h) OVER w AS h0, lag(s) OVER w AS s0, lead(h) OVER w AS h1, lead(s) OVER w AS s1, lag(h, 2) OVER w AS hb, lag(s, 2) OVER w AS sb FROM b WINDOW w AS (PARTITION BY entity, variable ORDER BY t)),
e AS (SELECT *, CASE WHEN s0 IS NULL THEN h WHEN s IS NULL THEN h0 END AS eh, CASE WHEN s0 IS NULL THEN s WHEN s IS NULL THEN s0 END AS es, CASE WHEN s0 IS NULL THEN h1 WHEN s IS NULL THEN hb END AS eh2, CASE WHEN s0 IS NULL THEN s1 WHEN s IS NULL THEN sb END AS es2 FROM c),
f AS (SELECT *, ((2 * eh + eh2) * es - eh * es2) / (eh + eh2) AS ed FROM e),
g AS (SELECT *, CASE WHEN s0 IS NULL OR s IS NULL THEN CASE WHEN es2 IS NULL THEN es WHEN sign(ed) <> sign(es) THEN 0 WHEN sign(es) <> sign(es2) AND abs(ed) > 3 * abs(es) THEN 3 * es ELSE ed END
  WHEN s0 * s <= 0 THEN 0 ELSE (2 * h + h0 + h + 2 * h0) / ((2 * h + h0) / s0 + (h + 2 * h0) / s) END AS d FROM f),
k AS (SELECT entity, variable, t, v, h, d, lead(d) OVER w AS d1, lead(v) OVER w AS v1 FROM g WINDOW w AS (PARTITION BY entity, variable ORDER BY t)),
p AS (SELECT q.entity, q.variable, q.ts, q.value, k.*, (datediff('day', DATE '1970-01-01', q.ts) - k.t) / k.h AS u FROM panel q LEFT JOIN k ON k.entity = q.entity AND k.variable = q.variable AND datediff('day', DATE '1970-01-01', q.ts) >= k.t AND (k.h IS NULL OR datediff('day', DATE '1970-01-01', q.ts) < k.t + k.h))
SELECT entity, variable, ts, {r('coalesce(value, v * (1 + 2 * u) * (1 - u) * (1 - u) + h * d * u * (1 - u) * (1 - u) + v1 * u * u * (3 - 2 * u) + h * d1 * u * u * (u - 1))', 'pred')} FROM (SELECT entity, variable, ts, value, v, h, d, d1, v1, u FROM p)""", dates="ts")
def _(spark, sf_dir):
    return design.pchip(_orders(spark, sf_dir)).select("entity", "variable", "ts", "pred")


@_add("k1_model_scores_by_year", f"{EV}, s AS (SELECT year, model, gap, anchor, seed, avg(mae) AS m FROM ev GROUP BY ALL), u AS (SELECT year, model, gap, anchor, avg(m) AS m FROM s GROUP BY ALL) SELECT model, {r('avg(m)', 'mae')}, count(*) AS size FROM u GROUP BY model")
def _(spark, sf_dir):
    from panelscope.operators import audit

    ev = audit.seed_collapse(adapters.eval_table(spark, sf_dir), ["year", "model", "gap", "anchor"], "seed", "mae")
    return audit.group_means(ev, ["model"], ["mae"])
