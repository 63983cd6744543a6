"""Queries on event days, windows and gaps of several parts, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelscope.functions.sqlfn import season
from panelscope.operators import events, gaps, panel
from panelscope.plans.catalog import _SEASON, _STARTS, _THR, _W, ORDERS, SEED, SHIP, SQL, _add, _orders, _ship, r
from panelscope.sources import adapters


@_add("e4_measures", f"{ORDERS} SELECT entity, ts, {r('CASE WHEN observed AND lag(observed) OVER w AND split = lag(split) OVER w AND ts - lag(ts) OVER w = 1 THEN value - lag(value) OVER w END', 'change')} FROM panel WINDOW w AS ({_W})", dates="ts")
def _(spark, sf_dir):
    return events.measures(_orders(spark, sf_dir)).select("entity", "ts", "change")


@_add("w10_event_labels", f"""{SHIP}, w AS (SELECT entity, ts, CASE WHEN ts <= DATE '1998-12-31' THEN 'train' WHEN ts <= DATE '1999-12-31' THEN 'validation' ELSE 'test' END AS split, "T" AS t, "F" AS f FROM days), q AS (SELECT entity, quantile_cont(t, 0.9) AS t90, quantile_cont(f, 0.1) AS f10, quantile_cont(f, 0.9) AS f90 FROM w WHERE split = 'train' GROUP BY entity),
h AS (SELECT w.*, t >= t90 AS hot, f >= f90 AS hf, f <= f10 AS lf FROM w JOIN q USING (entity)), k AS (SELECT *, sum(CASE WHEN hot THEN 0 ELSE 1 END) OVER (PARTITION BY entity ORDER BY ts) AS g FROM h)
SELECT entity, ts, split, hot AS high_t, hot AND count(*) FILTER (hot) OVER (PARTITION BY entity, g) >= 3 AS heat_run, hf AS high_f, lf AS low_f FROM k""", dates="ts")
def _(spark, sf_dir):
    return events.event_labels(panel.with_split(adapters.ship_days(spark, sf_dir)), "T", "F")


_COND = f"{SHIP}, {_THR}, ev AS (SELECT sp.*, coalesce(split = 'test' AND observed AND value > threshold, false) AS event FROM sp LEFT JOIN th USING (entity, variable, season))"


def _condition(spark, sf_dir):
    p = _ship(spark, sf_dir)
    return events.day_condition(p, gaps.season_thresholds(p, 0.9), "test", season("ts"))


@_add("e5_day_condition", f"{_COND} SELECT entity, variable, season, count(*) FILTER (event) AS event_days, count(*) AS days FROM ev GROUP BY ALL")
def _(spark, sf_dir):
    return _condition(spark, sf_dir).groupBy("entity", "variable", "season").agg(F.count_if("event").alias("event_days"), F.count(F.lit(1)).alias("days"))


@_add("e10_stress_cells", f"{_COND} SELECT entity, variable, ts FROM ev WHERE observed AND (entity, ts) IN (SELECT (entity, ts) FROM ev WHERE event)", dates="ts")
def _(spark, sf_dir):
    return events.stress_cells(_condition(spark, sf_dir))


_EP = SQL["e6_episodes"]


@_add("e6_phases", f"SELECT entity, variable, start_date, end_date, peak_date, CAST(CAST(peak_date AS DATE) - 7 AS VARCHAR) AS window_start, CAST(CAST(peak_date AS DATE) + 7 AS VARCHAR) AS window_end, CAST(peak_date AS DATE) - CAST(start_date AS DATE) AS rising_days, CAST(end_date AS DATE) - CAST(peak_date AS DATE) AS receding_days FROM ({_EP})")
def _(spark, sf_dir):
    e = gaps.episodes(_ship(spark, sf_dir), 0.9, 2, 3)
    return events.phases(e, 7).select("entity", "variable", "start_date", "end_date", "peak_date", "window_start", "window_end", "rising_days", "receding_days")


_PANEL = f"(SELECT * FROM ({SHIP} SELECT * FROM panel))"


@_add("e7_context", f"""WITH ep AS ({_EP}), p AS {_PANEL}, c AS (SELECT e.entity, e.variable, e.start_date, e.end_date, count(*) FILTER (observed AND ts BETWEEN CAST(start_date AS DATE) AND CAST(end_date AS DATE)) = CAST(end_date AS DATE) - CAST(start_date AS DATE) + 1 AS w,
count(*) FILTER (observed AND ts BETWEEN CAST(start_date AS DATE) - 5 AND CAST(start_date AS DATE) - 1) = 5 AS l, count(*) FILTER (observed AND ts BETWEEN CAST(end_date AS DATE) + 1 AND CAST(end_date AS DATE) + 5) = 5 AS r FROM ep e JOIN p ON e.entity = p.entity AND e.variable = p.variable GROUP BY e.entity, e.variable, e.start_date, e.end_date)
SELECT entity, variable, start_date, end_date, w AS window_ok, l AS left_ok, r AS right_ok, concat_ws(';', CASE WHEN NOT w THEN 'event_window_not_fully_eligible' END, CASE WHEN NOT l THEN 'missing_left_context' END, CASE WHEN NOT r THEN 'missing_right_context' END) AS reasons FROM c""")
def _(spark, sf_dir):
    p = _ship(spark, sf_dir)
    return events.context(gaps.episodes(p, 0.9, 2, 3), p, 5).select("entity", "variable", "start_date", "end_date", "window_ok", "left_ok", "right_ok", "reasons")


def _hash(cols: str) -> str:
    return f"md5(concat_ws('|', '{SEED}', {cols}))"


@_add("g4_multi_block", f"""{SHIP}, {_STARTS.format(n=2)}, t3 AS (SELECT * FROM starts), u AS (SELECT entity, variable, ts FROM panel QUALIFY count(*) FILTER (observed) OVER ({_W} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) = 4),
a AS (SELECT entity, variable, ts AS s0 FROM t3), b AS (SELECT a.*, (SELECT min(ts) FROM t3 WHERE t3.entity = a.entity AND t3.variable = a.variable AND t3.ts >= a.s0 + 33) AS s1 FROM a), c AS (SELECT b.*, (SELECT min(ts) FROM u WHERE u.entity = b.entity AND u.variable = b.variable AND u.ts >= b.s1 + 33) AS s2 FROM b WHERE s1 IS NOT NULL),
f AS (SELECT * FROM c WHERE s2 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity, variable ORDER BY {_hash('entity, variable, CAST(s0 AS VARCHAR)')}) = 1) SELECT entity, variable, CAST(x.k AS BIGINT) AS part, x.s AS start_date, x.s + CAST(x.n - 1 AS INT) AS end_date FROM (SELECT entity, variable, unnest([{{'k': 0, 's': s0, 'n': 3}}, {{'k': 1, 's': s1, 'n': 3}}, {{'k': 2, 's': s2, 'n': 4}}]) AS x FROM f)""", dates="start_date end_date")
def _(spark, sf_dir):
    return events.multi_block(_ship(spark, sf_dir), [3, 3, 4], 30, SEED)


@_add("g7_staggered", f"""{SHIP}, {_STARTS.format(n=9)}, o AS (SELECT entity, variable, CAST(row_number() OVER (PARTITION BY entity ORDER BY variable) - 1 AS INT) AS i FROM (SELECT DISTINCT entity, variable FROM obs)), b AS (SELECT s.entity, s.ts - o.i * 5 AS base FROM starts s JOIN o USING (entity, variable) GROUP BY ALL HAVING count(*) = 3),
c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY entity ORDER BY {_hash('entity, CAST(base AS VARCHAR)')}) = 1) SELECT o.entity, variable, base + i * 5 AS start_date, base + i * 5 + 9 AS end_date FROM c JOIN o USING (entity)""", dates="start_date end_date")
def _(spark, sf_dir):
    return events.staggered(_ship(spark, sf_dir), 10, 5, SEED)


@_add("g10_joint_anchors", f"""{SHIP}, {_STARTS.format(n=9)}, j AS (SELECT entity, ts + 4 AS ts FROM starts GROUP BY entity, ts HAVING count(*) = 3), s AS (SELECT *, {_SEASON} AS season FROM j)
SELECT entity, ts AS center_date, season, row_number() OVER (PARTITION BY entity, season ORDER BY {_hash('entity, CAST(ts AS VARCHAR)')}) AS anchor_no, greatest(5 - count(*) OVER (PARTITION BY entity, season), 0) AS shortfall FROM s QUALIFY anchor_no <= 5""", dates="center_date")
def _(spark, sf_dir):
    return events.joint_anchors(_ship(spark, sf_dir), 10, season("ts"), 5, SEED)


@_add("a5_rating_diagnostics", f"""{SHIP}, w AS (SELECT entity, year(ts) AS year, "L" AS x, "F" AS y FROM days), m AS (SELECT *, x - avg(x) OVER g AS u, y - avg(y) OVER g AS v, quantile_cont(y, 0.2) OVER g AS lo, quantile_cont(y, 0.8) OVER g AS hi FROM w WINDOW g AS (PARTITION BY entity, year)),
s AS (SELECT entity, year, count(*) AS n, sum(u * u) AS s2, sum(u * u * u) AS s3, sum(u * u * u * u) AS s4, sum(u * v) AS t1, sum(u * u * v) AS t2, sum(v * v) AS vv, CASE WHEN count(*) >= 5 THEN covar_pop(u, v) FILTER (y <= lo) ** 2 / nullif(var_pop(u) FILTER (y <= lo) * var_pop(v) FILTER (y <= lo), 0) END AS low, CASE WHEN count(*) >= 5 THEN covar_pop(u, v) FILTER (y >= hi) ** 2 / nullif(var_pop(u) FILTER (y >= hi) * var_pop(v) FILTER (y >= hi), 0) END AS high FROM m GROUP BY ALL),
b AS (SELECT *, (t2 * s2 - t1 * s3) / nullif((s4 - s2 * s2 / n) * s2 - s3 * s3, 0) AS b2 FROM s) SELECT entity, year, n, {r('t1 / nullif(sqrt(s2 * vv), 0)', 'pearson')}, {r('t1 * t1 / nullif(s2 * vv, 0)', 'linear_r2')}, {r('((t1 - b2 * s3) / nullif(s2, 0) * t1 + b2 * t2) / nullif(vv, 0)', 'quadratic_r2')}, {r('low', 'low_r2')}, {r('high', 'high_r2')} FROM b""")
def _(spark, sf_dir):
    return events.rating_diagnostics(adapters.ship_days(spark, sf_dir), "L", "F")


@_add("w11_rating_or_zero", f"SELECT entity, year, n, coalesce(pearson, 0) AS pearson, coalesce(linear_r2, 0) AS linear_r2, coalesce(quadratic_r2, 0) AS quadratic_r2 FROM ({SQL['a5_rating_diagnostics']})")
def _(spark, sf_dir):
    return events.rating_diagnostics(adapters.ship_days(spark, sf_dir), "L", "F").drop("low_r2", "high_r2").fillna(0.0)
