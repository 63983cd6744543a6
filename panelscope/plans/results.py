"""Queries on evaluation tables, intervals and order totals, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelscope.operators import analysis, results
from panelscope.plans.catalog import _COAL, _CURVE, EV, IV, ORDERS, SEED, _add, _curves, _orders, r
from panelscope.sources import adapters


def _ev(spark, sf_dir):
    return adapters.eval_table(spark, sf_dir)


def _coalitions(spark, sf_dir):
    li = adapters.table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("unit"), (F.col("l_orderkey") % 16).alias("mask")).agg(F.round(F.avg("l_quantity"), 6).alias("v"))


@_add("p26_horizon_label", f"{ORDERS}, d AS (SELECT entity, ts, datediff('day', max(ts) FILTER (observed) OVER (PARTITION BY entity ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ts) AS k FROM panel) SELECT entity, CASE WHEN k IS NULL OR k < 1 THEN 'no_history' WHEN k = 1 THEN '1' WHEN k <= 3 THEN '2-3' WHEN k <= 7 THEN '4-7' WHEN k <= 30 THEN '8-30' WHEN k <= 90 THEN '31-90' ELSE '91+' END AS horizon, count(*) AS n FROM d GROUP BY ALL")
def _(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("entity").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    days = F.datediff("ts", F.last(F.when(F.col("observed"), F.col("ts")), ignorenulls=True).over(w))
    return _orders(spark, sf_dir).select("entity", results.horizon_label(days).alias("horizon")).groupBy("entity", "horizon").agg(F.count(F.lit(1)).alias("n"))


@_add("p23_failed_sites", "WITH t AS (SELECT DISTINCT CASE WHEN o_orderkey % 5 = 0 THEN 'none' ELSE '[\"' || o_orderstatus || '\",\"S' || (o_orderkey % 3) || '\"]' END AS s FROM orders) SELECT s AS failed, CASE WHEN s = 'none' THEN '' ELSE array_to_string(list_sort(list_distinct(string_split(replace(replace(replace(s, '[', ''), ']', ''), '\"', ''), ','))), ',') END AS sites, CASE WHEN s = 'none' THEN 'none' ELSE 'double' END AS class FROM t")
def _(spark, sf_dir):
    o = adapters.table(spark, sf_dir, "orders")
    s = F.when(F.col("o_orderkey") % 5 == 0, "none").otherwise(F.concat(F.lit('["'), "o_orderstatus", F.lit('","S'), (F.col("o_orderkey") % 3).cast("string"), F.lit('"]')))
    t = o.select(s.alias("failed")).distinct().withColumn("_a", results.parse_failed_sites("failed"))
    return t.select("failed", F.array_join("_a", ",").alias("sites"), results.failure_class("_a", 6).alias("class"))


@_add("p28_stable_ids", f"{EV} SELECT DISTINCT model, gap, year, 'c-' || substr(sha256(concat_ws('|', model, CAST(gap AS VARCHAR), CAST(year AS VARCHAR))), 1, 16) AS id, concat_ws('|', model, CAST(gap AS VARCHAR)) AS family FROM ev")
def _(spark, sf_dir):
    e = _ev(spark, sf_dir).select("model", "gap", "year").distinct()
    return e.withColumn("id", results.stable_id("c", "model", "gap", "year")).withColumn("family", results.family_key("model", "gap"))


@_add("j1_with_baseline", f"{EV}, b AS (SELECT anchor, gap, avg(mae) AS baseline FROM ev WHERE model = 'N' GROUP BY ALL) SELECT model, anchor, gap, year, mae, {r('baseline')} FROM ev LEFT JOIN b USING (anchor, gap) WHERE model <> 'N'")
def _(spark, sf_dir):
    return results.with_baseline(_ev(spark, sf_dir), ["anchor", "gap"], "model", "N", "mae").select("model", "anchor", "gap", "year", "mae", "baseline")


@_add("j3_reconcile", f"{EV}, a AS (SELECT anchor, gap, count(*) AS n FROM ev WHERE model = 'A' GROUP BY ALL), b AS (SELECT anchor, gap, count(*) AS n FROM ev WHERE model = 'R' GROUP BY ALL) SELECT anchor, gap, a.n AS expected, b.n AS actual FROM a FULL JOIN b USING (anchor, gap) WHERE a.n IS DISTINCT FROM b.n")
def _(spark, sf_dir):
    n = lambda m: _ev(spark, sf_dir).where(F.col("model") == m).groupBy("anchor", "gap").agg(F.count(F.lit(1)).alias("n"))
    return results.reconcile(n("A"), n("R"), ["anchor", "gap"], "n")


@_add("r2_pivot_models", f"{EV} SELECT anchor, gap, {r('avg(mae) FILTER (model = $$A$$)', 'A')}, {r('avg(mae) FILTER (model = $$N$$)', 'N')}, {r('avg(mae) FILTER (model = $$R$$)', 'R')} FROM ev GROUP BY ALL")
def _(spark, sf_dir):
    return results.pivot_models(_ev(spark, sf_dir), ["anchor", "gap"], "model", ["A", "N", "R"], "mae")


_BIN = """m AS (SELECT entity, ts, value, CASE WHEN d <= 4 THEN o - 1 ELSE len(list_filter(list_distinct(list_filter(e, lambda x: x > lo AND x < hi)), lambda x: x <= value)) END AS bin FROM (SELECT *, dense_rank() OVER (PARTITION BY entity ORDER BY value) AS o FROM obs)
JOIN (SELECT entity, quantile_cont(value, [0.25, 0.5, 0.75]) AS e, min(value) AS lo, max(value) AS hi, count(DISTINCT value) AS d FROM obs GROUP BY entity) USING (entity))"""


def _bins(spark, sf_dir):
    return results.discretise(adapters.order_panel(spark, sf_dir), ["entity"], "value", 4)


@_add("v8_discretise", f"{ORDERS}, {_BIN} SELECT entity, CAST(bin AS BIGINT) AS bin, count(*) AS n FROM m GROUP BY ALL")
def _(spark, sf_dir):
    return _bins(spark, sf_dir).groupBy("entity", "bin").agg(F.count(F.lit(1)).alias("n"))


@_add("v9_transfer_entropy", f"""{ORDERS}, {_BIN}, t AS (SELECT entity, bin AS y, lag(bin) OVER w AS p, lag(CAST(dayofweek(ts) AS BIGINT), 2) OVER w AS s FROM m WINDOW w AS (PARTITION BY entity ORDER BY ts)), c AS (SELECT entity, y, p, s, count(*) AS n FROM t WHERE p IS NOT NULL AND s IS NOT NULL GROUP BY ALL),
q AS (SELECT *, sum(n) OVER (PARTITION BY entity, p, s) AS ps, sum(n) OVER (PARTITION BY entity, y, p) AS yp, sum(n) OVER (PARTITION BY entity, p) AS pp, sum(n) OVER (PARTITION BY entity) AS total FROM c)
SELECT entity, CAST(sum(n) AS BIGINT) AS n, {r('greatest(sum(n / total * ln(n * pp / (ps * yp))), 0)', 'te')} FROM q GROUP BY entity""")
def _(spark, sf_dir):
    b = _bins(spark, sf_dir).withColumn("dow", F.dayofweek("ts"))
    return results.transfer_entropy(b, ["entity"], "dow", "bin", "ts", 2)


_MONTHS = "y AS (SELECT entity, year(ts) * 12 + month(ts) AS x, sum(value) AS y FROM obs GROUP BY ALL)"


def _months(spark, sf_dir):
    return adapters.order_panel(spark, sf_dir).groupBy("entity", (F.year("ts") * 12 + F.month("ts")).alias("x")).agg(F.sum("value").alias("y"))


@_add("m12_mann_kendall", f"""{ORDERS}, {_MONTHS}, s AS (SELECT a.entity, CAST(sum(sign(b.y - a.y)) AS BIGINT) AS s FROM y a JOIN y b ON a.entity = b.entity AND a.x < b.x GROUP BY ALL), t AS (SELECT entity, CAST(sum(t) AS BIGINT) AS n, sum(t * (t - 1) * (2 * t + 5)) AS tie FROM (SELECT entity, y, count(*) AS t FROM y GROUP BY ALL) GROUP BY entity),
v AS (SELECT entity, n, s, CAST(n * (n - 1) * (2 * n + 5) - tie AS DOUBLE) / 18.0 AS var_s FROM s JOIN t USING (entity)) SELECT entity, n, s, {r('var_s')}, {r('CASE WHEN var_s > 0 THEN (s - sign(s)) / sqrt(var_s) END', 'z')} FROM v""")
def _(spark, sf_dir):
    return results.mann_kendall(_months(spark, sf_dir), ["entity"], "x", "y")


@_add("f8_two_line_break", f"""{EV}, {_CURVE}, j AS (SELECT a.anchor, b.gap AS brk, a.gap AS x, a.skill AS y FROM cv a JOIN cv b ON a.anchor = b.anchor), g AS (SELECT anchor, brk, 'left' AS side, count(*) AS n, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS c FROM j WHERE x <= brk GROUP BY ALL UNION ALL SELECT anchor, brk, 'right', count(*), var_pop(x), var_pop(y), covar_pop(x, y) FROM j WHERE x >= brk GROUP BY ALL),
s AS (SELECT anchor, brk, round(sum(n * (vy - c * c / vx)), 9) AS sse, max(c / vx) FILTER (side = 'left') AS l, max(c / vx) FILTER (side = 'right') AS r FROM g WHERE n >= 2 GROUP BY ALL HAVING count(*) = 2) SELECT anchor, brk, {r('sse')}, {r('l', 'left_slope')}, {r('r', 'right_slope')} FROM s QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY s.sse, brk) = 1""")
def _(spark, sf_dir):
    return results.two_line_break(_curves(spark, sf_dir), ["anchor"], "gap", "skill")


@_add("f3_raw_first_loss", f"{EV}, {_CURVE}, f AS (SELECT *, min(gap) FILTER (skill <= 0.45) OVER (PARTITION BY anchor) AS f FROM cv) SELECT anchor, min(f) AS first_loss, coalesce(bool_or(gap > f AND skill > 0.45), false) AS reversal FROM f GROUP BY anchor")
def _(spark, sf_dir):
    return results.raw_first_loss(_curves(spark, sf_dir), ["anchor"], "gap", "skill", 0.45)


@_add("f7_pass_prefix", f"{EV}, g AS (SELECT anchor, gap, bool_and(mae <= 9) AS ok FROM ev GROUP BY ALL), p AS (SELECT *, min(CAST(ok AS INT)) OVER (PARTITION BY anchor ORDER BY gap) AS a FROM g) SELECT anchor, max(gap) FILTER (a = 1) AS boundary, min(gap) FILTER (a = 0) AS first_fail FROM p GROUP BY anchor")
def _(spark, sf_dir):
    return results.pass_prefix(_ev(spark, sf_dir).withColumn("ok", F.col("mae") <= 9), ["anchor"], "gap", "ok")


@_add("v3_coalition_gains", f"WITH {_COAL} SELECT unit, CAST(p AS BIGINT) AS player, {r('max(v) FILTER (mask = 1 << CAST(p AS INT)) - max(v) FILTER (mask = 0)', 'first_gain')}, {r('max(v) FILTER (mask = 15) - max(v) FILTER (mask = 15 - (1 << CAST(p AS INT)))', 'last_gain')} FROM co, (SELECT unnest(range(0, 4)) AS p) GROUP BY unit, p")
def _(spark, sf_dir):
    return results.coalition_gains(_coalitions(spark, sf_dir), ["unit"], "mask", "v", 4)


@_add("v4_pair_interactions", f"WITH {_COAL} SELECT unit, i || '' || j AS pair, {r('max(v) FILTER (mask = (1 << CAST(i AS INT)) + (1 << CAST(j AS INT))) - max(v) FILTER (mask = 1 << CAST(i AS INT)) - max(v) FILTER (mask = 1 << CAST(j AS INT)) + max(v) FILTER (mask = 0)', 'interaction')} FROM co, (SELECT unnest(range(0, 4)) AS i), (SELECT unnest(range(0, 4)) AS j) WHERE i < j GROUP BY unit, i, j")
def _(spark, sf_dir):
    return results.pair_interactions(_coalitions(spark, sf_dir), ["unit"], "mask", "v", 4)


@_add("n4_node_importance", f"{EV}, m AS (SELECT seed, model, avg(mae) AS m FROM ev GROUP BY ALL) SELECT a.seed, a.model, {r('a.m - b.m', 'importance')} FROM m a JOIN m b ON a.seed = b.seed AND b.model = 'N' WHERE a.model <> 'N'")
def _(spark, sf_dir):
    return results.node_importance(_ev(spark, sf_dir), ["seed"], "model", "mae", "N")


@_add("o4_date_coverage", f"{IV}, d AS (SELECT entity, interval_id, start_date + CAST(unnest(range(0, 31)) AS INT) AS day FROM iv) SELECT entity, day, count(*) AS n, array_to_string(list_sort(list(DISTINCT interval_id)), ',') AS ids FROM d GROUP BY ALL", dates="day")
def _(spark, sf_dir):
    return results.date_coverage(adapters.interval_table(spark, sf_dir))


@_add("k8_seed_coverage", f"{EV}, a AS (SELECT list_sort(list(DISTINCT seed)) AS s FROM ev), g AS (SELECT model, anchor, year, gap, list(DISTINCT seed) AS t FROM ev GROUP BY ALL) SELECT model, anchor, year, gap, array_to_string(list_filter(s, lambda x: NOT list_contains(t, x)), ',') AS missing FROM g, a WHERE len(s) > len(t)")
def _(spark, sf_dir):
    return results.seed_coverage(_ev(spark, sf_dir), ["model", "anchor", "year", "gap"], "seed")


@_add("x7_effects", f"{EV}, p AS (SELECT year, anchor, avg(mae) FILTER (model = 'A') - avg(mae) FILTER (model = 'N') AS d FROM ev GROUP BY ALL) SELECT year, count(*) AS n, {r('avg(d)', 'mean')}, {r('avg(d) - 1.96 * stddev_samp(d) / sqrt(count(*))', 'lower')}, {r('avg(d) + 1.96 * stddev_samp(d) / sqrt(count(*))', 'upper')} FROM p WHERE d IS NOT NULL GROUP BY year")
def _(spark, sf_dir):
    return results.effects(analysis.paired(_ev(spark, sf_dir), ["year", "anchor"], "model", "A", "N", "mae"), ["year"], "diff")


@_add("x3_shift_donors", f"{ORDERS} SELECT entity, ts, value, lag(value, 7) OVER (PARTITION BY entity ORDER BY ts) AS shifted FROM obs", dates="ts")
def _(spark, sf_dir):
    return results.shift_donors(adapters.order_panel(spark, sf_dir), ["entity"], "ts", "value", 7).select("entity", "ts", "value", "shifted")


@_add("x5_permute_blocks", f"""{ORDERS}, i AS (SELECT entity, ts, value, row_number() OVER (PARTITION BY entity ORDER BY ts) - 1 AS i, avg(value) OVER (PARTITION BY entity, dayofyear(ts)) AS s FROM obs), b AS (SELECT *, i // 30 AS b FROM i),
k AS (SELECT entity, b, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT entity, b, sum(n) OVER (PARTITION BY entity ORDER BY md5(concat_ws('|', '{SEED}', entity, CAST(b AS VARCHAR))) ROWS UNBOUNDED PRECEDING) - n AS dest FROM k), m AS (SELECT entity, dest + i % 30 AS i, value - s AS r FROM b JOIN t USING (entity, b))
SELECT b.entity, b.ts, {r('b.s + m.r', 'permuted')} FROM b LEFT JOIN m ON b.entity = m.entity AND b.i = m.i""", dates="ts")
def _(spark, sf_dir):
    return results.permute_blocks(adapters.order_panel(spark, sf_dir), ["entity"], "ts", "value", 30, SEED).select("entity", "ts", "permuted")
