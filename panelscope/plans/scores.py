"""Queries on scores and calibration, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelscope.operators import audit, fillers, results, scores
from panelscope.plans.catalog import _FILLED, _HIDDEN, _W, EV, ORDERS, _add, _corr, _hidden, _ship, r
from panelscope.sources import adapters

_THR = "thr AS (SELECT entity, variable, quantile_cont(value, 0.9) AS threshold FROM panel WHERE split = 'train' AND value IS NOT NULL GROUP BY ALL)"


def _thresholds(spark, sf_dir):
    return audit.train_reference(_ship(spark, sf_dir)).select("entity", "variable", F.col("q90").alias("threshold"))


@_add("m5_level_metrics", f"""{_FILLED}, {_THR}, s AS (SELECT lin.entity, lin.variable, ts, value AS truth, pred, threshold FROM lin JOIN thr ON lin.entity = thr.entity AND lin.variable = thr.variable WHERE hidden AND value IS NOT NULL AND pred IS NOT NULL AND lin.variable = 'L')
SELECT entity, variable, {r('avg(abs(pred - truth)) FILTER (truth >= threshold)', 'high_mae')}, count(*) FILTER (pred >= threshold) - count(*) FILTER (truth >= threshold) AS duration_bias, {r('max(pred) - max(truth)', 'peak_error')}, abs(first(ts ORDER BY pred DESC, ts) - first(ts ORDER BY truth DESC, ts)) AS peak_timing_days FROM s GROUP BY ALL""")
def _(spark, sf_dir):
    return scores.level(fillers.linear(_hidden(spark, sf_dir)).where("variable = 'L'"), _thresholds(spark, sf_dir))


_RUN = "SELECT entity, max(n) AS n FROM (SELECT entity, count(*) AS n FROM (SELECT entity, ts - CAST(row_number() OVER (PARTITION BY entity ORDER BY ts) AS INT) AS isle FROM c WHERE scope AND truth IS NOT NULL AND {c} >= threshold) GROUP BY entity, isle) GROUP BY entity"


@_add("m3_temperature_metrics", f"""{_FILLED}, {_THR}, a AS (SELECT lin.entity, ts, year(ts) AS year, value AS truth, pred, hidden, threshold, hidden AND value IS NOT NULL AND pred IS NOT NULL AS sel, CASE WHEN hidden AND value IS NOT NULL AND pred IS NOT NULL THEN pred ELSE value END AS rec FROM lin JOIN thr ON lin.entity = thr.entity AND lin.variable = thr.variable WHERE lin.variable = 'T'),
c AS (SELECT *, bool_or(sel) OVER (PARTITION BY entity, year) AS scope, CASE WHEN hidden OR lag(hidden) OVER w THEN abs((rec - lag(rec) OVER w) - (truth - lag(truth) OVER w)) END AS change FROM a WINDOW w AS (PARTITION BY entity ORDER BY ts)),
g AS (SELECT entity, count(*) FILTER (sel AND truth >= threshold) AS high_n, avg(abs(pred - truth)) FILTER (sel AND truth >= threshold) AS high_mae, avg(pred - truth) FILTER (sel AND truth >= threshold) AS high_bias, max(pred) FILTER (sel AND truth >= threshold) - max(truth) FILTER (sel AND truth >= threshold) AS peak, count(*) FILTER (sel AND pred >= threshold) - count(*) FILTER (sel AND truth >= threshold) AS days, avg(change) AS change FROM c GROUP BY entity),
t AS ({_RUN.format(c='truth')}), q AS ({_RUN.format(c='rec')}), y AS (SELECT entity, avg(d) AS d FROM (SELECT entity, year, max(rec) - max(truth) AS d FROM c WHERE scope AND truth IS NOT NULL GROUP BY ALL) GROUP BY entity)
SELECT entity, 'T' AS variable, high_n, {r('high_mae')}, {r('high_bias')}, {r('peak', 'extreme_peak_error')}, days AS threshold_days_bias, {r('change', 'daily_change_mae')}, {r('y.d', 'annual_max_error')}, CAST(coalesce(q.n, 0) - coalesce(t.n, 0) AS BIGINT) AS heat_run_error FROM g LEFT JOIN t USING (entity) LEFT JOIN q USING (entity) LEFT JOIN y USING (entity)""")
def _(spark, sf_dir):
    return scores.temperature(fillers.linear(_hidden(spark, sf_dir)).where("variable = 'T'"), _thresholds(spark, sf_dir))


@_add("m4_kling_gupta", f"""{_FILLED}, g AS (SELECT entity, variable, {_corr('truth', 'pred', 2)} AS r, stddev_pop(pred) / nullif(stddev_pop(truth), 0) AS alpha, avg(pred) / nullif(avg(truth), 0) AS beta, sum(pred) - sum(truth) AS v FROM sc WHERE variable = 'F' GROUP BY ALL)
SELECT entity, variable, {r('r')}, {r('alpha')}, {r('beta')}, {r('v', 'volume_bias')}, {r('1 - sqrt((r - 1) ** 2 + (alpha - 1) ** 2 + (beta - 1) ** 2)', 'kge')} FROM g""")
def _(spark, sf_dir):
    return scores.kling_gupta(fillers.linear(_hidden(spark, sf_dir)).where("hidden and variable = 'F'"), ["entity", "variable"])


_LOSS = {q: f"greatest({q} * (mae - {c}), ({q} - 1) * (mae - {c}))" for q, c in ((0.05, "mae_clim * 0.5"), (0.5, "mae_clim"), (0.95, "mae_clim * 1.5"))}


@_add("m8_quantile_scores", f"{EV} SELECT model, gap, count(*) AS n, {', '.join(r(f'avg({x})', f'pinball_q{round(100 * q):02d}') for q, x in _LOSS.items())}, {r(f'avg(2 * (0.45 * ({_LOSS[0.05]} + {_LOSS[0.5]}) / 2 + 0.45 * ({_LOSS[0.5]} + {_LOSS[0.95]}) / 2))', 'approx_crps')}, {r('avg(CAST(mae BETWEEN mae_clim * 0.5 AND mae_clim * 1.5 AS INT))', 'coverage_90')}, {r('avg(mae_clim * 1.0)', 'width_90')} FROM ev GROUP BY ALL")
def _(spark, sf_dir):
    ev = adapters.eval_table(spark, sf_dir).selectExpr("model", "gap", "mae", "mae_clim * 0.5d AS lo", "mae_clim * 1.0d AS mid", "mae_clim * 1.5d AS hi")
    return scores.quantiles(ev, ["model", "gap"], "mae", {0.05: "lo", 0.5: "mid", 0.95: "hi"})


@_add("m11_scores_by_horizon", f"""{_HIDDEN}, d AS (SELECT *, last_value(seen IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS pred, datediff('day', max(ts) FILTER (seen IS NOT NULL) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ts) AS k FROM hid),
c AS (SELECT entity, variable, avg(value) AS clim FROM panel WHERE split = 'train' GROUP BY ALL), l AS (SELECT d.variable, CASE WHEN k IS NULL OR k < 1 THEN 'no_history' WHEN k = 1 THEN '1' WHEN k <= 3 THEN '2-3' WHEN k <= 7 THEN '4-7' WHEN k <= 30 THEN '8-30' WHEN k <= 90 THEN '31-90' ELSE '91+' END AS horizon, pred - value AS e, clim - value AS ce FROM d JOIN c USING (entity, variable) WHERE hidden AND value IS NOT NULL AND pred IS NOT NULL),
g AS (SELECT variable, horizon, count(*) AS n, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(abs(ce)) AS mae_clim FROM l GROUP BY GROUPING SETS ((variable, horizon), (variable)))
SELECT variable, horizon, n, {r('mae')}, {r('rmse')}, {r('mae_clim')}, {r('CASE WHEN mae_clim > 0 THEN 1 - mae / mae_clim ELSE 0 END', 'skill')} FROM g""")
def _(spark, sf_dir):
    h = _hidden(spark, sf_dir)
    w = Window.partitionBy("entity", "variable").orderBy("ts")
    seen = F.when(F.col("value").isNotNull(), F.col("ts"))
    days = F.datediff("ts", F.last(seen, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    clim = _ship(spark, sf_dir).where("split = 'train'").groupBy("entity", "variable").agg(F.avg("value").alias("clim"))
    scored = h.withColumn("pred", F.last("value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("horizon", results.horizon_label(days)).join(clim, ["entity", "variable"])
    return scores.by_horizon(scored, "horizon")


_CAL = f"count(*) AS n, {r('avg(CAST(gap BETWEEN mae_clim AND mae AS INT))', 'coverage')}, {r('avg(mae - mae_clim)', 'mean_width')}, {r('quantile_cont(CAST(mae - mae_clim AS DOUBLE), 0.5)', 'median_width')}, {r('avg(CAST(mae_clim > mae AS INT))', 'crossing_rate')}, {r('avg(CAST(gap BETWEEN mae_clim AND mae AS INT)) - 0.9', 'calibration_error')}"


@_add("u1_calibration", f"{EV} SELECT model, seed, gap, {_CAL} FROM ev GROUP BY ALL")
def _(spark, sf_dir):
    return scores.calibration(adapters.eval_table(spark, sf_dir), ["model", "seed", "gap"], "gap", "mae_clim", "mae", 0.9)


@_add("u2_width_growth", f"""{EV}, u AS (SELECT model, anchor, gap, count(*) AS n, avg(mae - mae_clim) AS w FROM ev GROUP BY ALL), g AS (SELECT model, gap, round(sum(w * n) / sum(n), 9) AS width FROM u GROUP BY ALL),
k AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY gap) + (count(*) OVER (PARTITION BY model, gap) - 1) / 2.0 AS a, rank() OVER (PARTITION BY model ORDER BY width) + (count(*) OVER (PARTITION BY model, width) - 1) / 2.0 AS b FROM g)
SELECT model, count(*) AS gaps, {r(_corr('CAST(a AS DOUBLE)', 'CAST(b AS DOUBLE)'), 'spearman')}, {r('first(width ORDER BY gap)', 'first_width')}, {r('first(width ORDER BY gap DESC)', 'last_width')} FROM k GROUP BY ALL""")
def _(spark, sf_dir):
    units = scores.calibration(adapters.eval_table(spark, sf_dir), ["model", "anchor", "gap"], "gap", "mae_clim", "mae", 0.9)
    return scores.width_growth(units, ["model"], "gap")


@_add("u4_calibration_by_axis", f"{EV}, x AS (SELECT gap, mae, mae_clim, unnest([{{'a': 'model', 'v': model}}, {{'a': 'seed', 'v': seed}}, {{'a': 'year', 'v': CAST(year AS VARCHAR)}}]) AS x FROM ev) SELECT x.a AS axis, x.v AS value, {_CAL} FROM x GROUP BY ALL")
def _(spark, sf_dir):
    return scores.calibration_by_axis(adapters.eval_table(spark, sf_dir), ["model", "seed", "year"], "gap", "mae_clim", "mae", 0.9)


@_add("u5_seed_first_calibration", f"{EV}, s AS (SELECT model, gap, seed, avg(CAST(gap BETWEEN mae_clim AND mae AS INT)) AS c, avg(mae - mae_clim) AS w FROM ev GROUP BY ALL) SELECT model, gap, count(*) AS seeds, {r('avg(c)', 'coverage')}, {r('avg(w)', 'mean_width')}, {r('avg(c) - 0.9', 'calibration_error')} FROM s GROUP BY ALL")
def _(spark, sf_dir):
    s = scores.calibration(adapters.eval_table(spark, sf_dir), ["model", "gap", "seed"], "gap", "mae_clim", "mae", 0.9)
    return s.groupBy("model", "gap").agg(F.count(F.lit(1)).alias("seeds"), F.avg("coverage").alias("coverage"), F.avg("mean_width").alias("mean_width"), (F.avg("coverage") - 0.9).alias("calibration_error"))


@_add("m14_trend_kept", f"""{ORDERS}, y AS (SELECT entity, year(ts) AS x, sum(value) AS a, sum(value) FILTER (day(ts) <= 20) AS b FROM obs WHERE year(ts) < 2001 GROUP BY ALL),
p AS (SELECT u.entity, sign(v.a - u.a) AS sa, sign(v.b - u.b) AS sb, (v.a - u.a) / (v.x - u.x) AS ma, (v.b - u.b) / (v.x - u.x) AS mb FROM y u JOIN y v ON u.entity = v.entity AND u.x < v.x)
SELECT entity, CAST(sum(sa) AS BIGINT) AS s_truth, CAST(sum(sb) AS BIGINT) AS s_pred, {r('quantile_cont(ma, 0.5)', 'slope_truth')}, {r('quantile_cont(mb, 0.5)', 'slope_pred')}, sign(quantile_cont(ma, 0.5)) = sign(quantile_cont(mb, 0.5)) AS same_direction FROM p GROUP BY ALL""")
def _(spark, sf_dir):
    from panelscope.operators import metrics

    o = adapters.order_panel(spark, sf_dir).where(F.year("ts") < 2001)
    y = o.groupBy("entity", F.year("ts").alias("x")).agg(F.sum("value").alias("a"), F.sum(F.when(F.dayofmonth("ts") <= 20, F.col("value"))).alias("b"))
    side = lambda c, out: results.mann_kendall(y, ["entity"], "x", c).select("entity", F.col("s").cast("long").alias(f"s_{out}")).join(metrics.sen_slope(y, ["entity"], "x", c).select("entity", F.col("slope").alias(f"slope_{out}")), "entity")
    return side("a", "truth").join(side("b", "pred"), "entity").withColumn("same_direction", F.signum("slope_truth") == F.signum("slope_pred"))
