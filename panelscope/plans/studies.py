"""Queries on frontiers, baselines, coalitions, failure sets, decisions and overlap, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelscope.operators import analysis, gaps, studies
from panelscope.plans.catalog import _COAL, _STARTS, EV, IV, ORDERS, SEED, SHIP, _KEY, _SEASON, _add, _orders, _ship, r
from panelscope.sources import adapters

_U = "un AS (SELECT model, anchor, gap, s - gap * 0.06 AS skill FROM (SELECT model, anchor, gap, 1 - avg(mae) / 9.0 AS s FROM ev GROUP BY ALL)), ci AS (SELECT model, gap, count(skill) AS n, avg(skill) AS mean, avg(skill) - 1.96 * (stddev_samp(skill) / sqrt(count(skill))) AS lo, avg(skill) + 1.96 * (stddev_samp(skill) / sqrt(count(skill))) AS hi FROM un GROUP BY ALL)"


def _ev(spark, sf_dir):
    return adapters.eval_table(spark, sf_dir)


def _curve(spark, sf_dir):
    u = _ev(spark, sf_dir).groupBy("model", "anchor", "gap").agg((1 - F.avg("mae") / 9.0).alias("s")).withColumn("skill", F.col("s") - F.col("gap") * 0.06)
    return studies.curve_with_interval(u, ["model"], "gap", "skill")


@_add("f1_curve_with_interval", f"{EV}, {_U} SELECT model, gap, n, {r('mean')}, {r('lo', 'ci_lower')}, {r('hi', 'ci_upper')} FROM ci")
def _(spark, sf_dir):
    return _curve(spark, sf_dir)


def _first(curve: str, by: str, x: str, limit: str) -> str:
    """Twin of the first-loss frontier: CTEs ``fr`` (by, frontier, censoring)."""
    return f"""fa AS (SELECT *, min({x}) OVER (PARTITION BY {by} ORDER BY gap) AS m FROM {curve} WHERE {x} IS NOT NULL), fb AS (SELECT *, lag(m) OVER (PARTITION BY {by} ORDER BY gap) AS pm, lag(gap) OVER (PARTITION BY {by} ORDER BY gap) AS pg FROM fa),
ff AS (SELECT {by}, first(coalesce(pg + (gap - pg) * ((pm - ({limit})) / nullif(pm - m, 0)), 0) ORDER BY gap) AS g_at, first(pg IS NULL ORDER BY gap) AS lft FROM fb WHERE m <= {limit} GROUP BY {by}), fl AS (SELECT {by}, max(gap) AS last FROM {curve} GROUP BY {by}),
fr AS (SELECT {', '.join('fl.' + b.strip() for b in by.split(','))}, coalesce(g_at, last) AS frontier, CASE WHEN lft IS NULL THEN 'right' WHEN lft THEN 'left' ELSE 'none' END AS censoring FROM fl LEFT JOIN ff USING ({by}))"""


@_add("f5_statistical_frontier", f"{EV}, {_U}, {_first('ci', 'model', 'lo', '0')} SELECT model, {r('frontier')}, censoring FROM fr")
def _(spark, sf_dir):
    return studies.statistical_frontier(_curve(spark, sf_dir), ["model"], "gap")


_M = "ac AS (SELECT anchor, gap, m + gap * 0.3 AS mae, c - gap * 0.4 AS clim FROM (SELECT anchor, gap, avg(mae) AS m, avg(mae_clim) AS c FROM ev GROUP BY ALL)), mg AS (SELECT anchor, gap, unnest([{'k': 'clim', 'v': clim - 1.0}, {'k': 'mae', 'v': 6.0 - mae}]) AS x FROM ac), ml AS (SELECT anchor, gap, x.k AS metric, x.v AS margin FROM mg)"


@_add("f6_application_frontier", f"{EV}, {_M}, {_first('ml', 'anchor, metric', 'margin', '-1e-12')} SELECT anchor, {r('min(frontier)', 'frontier')}, first(metric ORDER BY frontier, metric) AS limiting_metric FROM fr GROUP BY anchor")
def _(spark, sf_dir):
    c = _ev(spark, sf_dir).groupBy("anchor", "gap").agg((F.avg("mae") + F.first("gap") * 0.3).alias("mae"), (F.avg("mae_clim") - F.first("gap") * 0.4).alias("clim"))
    return studies.application_frontier(c, ["anchor"], "gap", {"mae": ("<=", 6.0), "clim": (">=", 1.0)})


_BEST = "bm AS (SELECT year, model, round(avg(m), 9) AS mean FROM (SELECT year, model, gap, avg(mae) AS m FROM ev WHERE model IN ('R', 'A') GROUP BY ALL) GROUP BY ALL), bb AS (SELECT year, first(model ORDER BY mean, CASE model WHEN 'R' THEN 1 ELSE 2 END) AS best_model, min(mean) AS best_mean FROM bm GROUP BY year)"


def _best(spark, sf_dir):
    return studies.best_baselines(_ev(spark, sf_dir), ["year"], "model", "gap", "mae", ["R", "A"])


@_add("f13_best_baselines", f"{EV}, {_BEST} SELECT year, best_model, {r('best_mean')} FROM bb")
def _(spark, sf_dir):
    return _best(spark, sf_dir)


@_add("b10_two_skills", f"{EV}, {_BEST}, u AS (SELECT year, gap, model, avg(mae) AS m, avg(mae_clim) AS c FROM ev GROUP BY ALL), f AS (SELECT u.*, best_model FROM u JOIN bb USING (year)), b AS (SELECT year, gap, m AS b FROM f WHERE model = best_model) SELECT year, gap, model, best_model, {r('1 - m / nullif(c, 0)', 'skill_climatology')}, {r('1 - m / nullif(b, 0)', 'skill_best')} FROM f LEFT JOIN b USING (year, gap)")
def _(spark, sf_dir):
    return studies.skill_over(_ev(spark, sf_dir), _best(spark, sf_dir), ["year", "gap"], ["year"], "model", "mae", "mae_clim")


@_add("j12_frozen_baseline", f"{EV}, {_BEST} SELECT model, ev.year, best_model, count(*) AS n FROM ev LEFT JOIN bb ON ev.year = bb.year + 1 WHERE best_model IS NOT NULL GROUP BY ALL")
def _(spark, sf_dir):
    best = _best(spark, sf_dir).select((F.col("year") + 1).alias("year"), "best_model")
    return _ev(spark, sf_dir).join(F.broadcast(best), "year").groupBy("model", "year", "best_model").agg(F.count(F.lit(1)).alias("n"))  # a row per year


def _coalitions(spark, sf_dir):
    li = adapters.table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("unit"), (F.col("l_orderkey") % 16).alias("mask")).agg(F.round(F.avg("l_quantity"), 6).alias("v"))


@_add("v1_coalition_values", "WITH v AS (SELECT l_suppkey AS unit, l_orderkey % 4 AS mask, CASE WHEN l_partkey % 50 <> 0 THEN l_quantity END AS v FROM lineitem) SELECT unit, count(DISTINCT mask) FILTER (v IS NOT NULL) AS coalitions, count(*) - count(DISTINCT mask) AS duplicates, count(*) FILTER (v IS NULL) AS not_finite, count(DISTINCT mask) FILTER (v IS NOT NULL) = 4 AND count(*) = count(DISTINCT mask) AND count(*) FILTER (v IS NULL) = 0 AS complete FROM v GROUP BY ALL")
def _(spark, sf_dir):
    v = adapters.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("unit"), (F.col("l_orderkey") % 4).alias("mask"), F.when(F.col("l_partkey") % 50 != 0, F.col("l_quantity").cast("double")).alias("v"))
    return studies.coalition_values(v, ["unit"], "mask", "v", 2)


@_add("v5_contrasts_to_none", f"WITH {_COAL}, k AS (SELECT *, count(*) OVER (PARTITION BY unit) AS k, max(v) FILTER (mask = 0) OVER (PARTITION BY unit) AS z FROM co) SELECT unit, mask, {r('v - z', 'gain')} FROM k WHERE k = 16 AND mask > 0")
def _(spark, sf_dir):
    return studies.contrasts_to_none(_coalitions(spark, sf_dir), ["unit"], "mask", "v", 16)


_NET = "nt AS (SELECT l_suppkey AS unit, l_returnflag AS model, l_orderkey % 8 AS mask, 1 - l_discount * 5 AS skill FROM lineitem)"


def _net(spark, sf_dir):
    return adapters.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("unit"), F.col("l_returnflag").alias("model"), (F.col("l_orderkey") % 8).alias("mask"), (1 - F.col("l_discount") * 5).cast("double").alias("skill"))


@_add("n1_complete_units", f"WITH {_NET}, e AS (SELECT * FROM (SELECT DISTINCT unit, model FROM nt), (SELECT unnest(range(0, 8)) AS mask)), m AS (SELECT e.unit, e.model, e.mask, bool_or(nt.mask IS NOT NULL) AS has FROM e LEFT JOIN nt ON e.unit = nt.unit AND e.model = nt.model AND e.mask = nt.mask GROUP BY ALL) SELECT unit, model, count(*) FILTER (has) AS n_sets, coalesce(string_agg(CAST(mask AS VARCHAR), ',' ORDER BY mask) FILTER (NOT has), '') AS missing FROM m GROUP BY ALL")
def _(spark, sf_dir):
    return studies.complete_units(_net(spark, sf_dir), ["unit", "model"], "mask", 3)


@_add("n2_resilience_curve", f"WITH {_NET}, c AS (SELECT model, CAST(bit_count(mask) AS BIGINT) AS failed, avg(skill) AS mean, count(skill) AS n FROM nt GROUP BY ALL), z AS (SELECT *, max(mean) FILTER (failed = 0) OVER (PARTITION BY model) AS z FROM c) SELECT model, failed, {r('failed / 3', 'fraction')}, n, {r('mean')}, {r('CASE WHEN z > 0 THEN mean / z END', 'relative')} FROM z")
def _(spark, sf_dir):
    return studies.resilience_curve(_net(spark, sf_dir), ["model"], "mask", "skill", 3)


_PD = "pd AS (SELECT gap, anchor, round(avg(mae) FILTER (seed = 'F') - avg(mae) FILTER (seed = 'O'), 9) AS d FROM ev GROUP BY ALL HAVING count(*) FILTER (seed = 'F') > 0 AND count(*) FILTER (seed = 'O') > 0), rd AS (SELECT gap, count(d) AS n, avg(d) AS mean, quantile_cont(d, 0.5) AS median, stddev_samp(d) / sqrt(count(d)) AS se FROM pd GROUP BY gap)"


def _roles(spark, sf_dir):
    return studies.role_differences(_ev(spark, sf_dir), ["anchor"], ["gap"], "seed", "F", "O", "mae")


@_add("x1_role_differences", f"{EV}, {_PD} SELECT gap, n, {r('mean')}, {r('median')}, {r('se')}, {r('mean - 1.96 * se', 'ci_lower')}, {r('mean + 1.96 * se', 'ci_upper')} FROM rd")
def _(spark, sf_dir):
    return _roles(spark, sf_dir)


@_add("x2_version_differences", f"{EV}, p AS (SELECT year, anchor, round(avg(mae) - avg(CASE WHEN gap <= 5 THEN mae ELSE mae + 1 END), 9) AS d FROM ev GROUP BY ALL), g AS (SELECT year, count(d) AS n, avg(d) AS mean, quantile_cont(d, 0.5) AS median, stddev_samp(d) / sqrt(count(d)) AS se FROM p GROUP BY year) SELECT year, n, {r('mean')}, {r('median')}, {r('se')}, {r('mean - 1.96 * se', 'ci_lower')}, {r('mean + 1.96 * se', 'ci_upper')} FROM g")
def _(spark, sf_dir):
    ev = _ev(spark, sf_dir)
    other = ev.withColumn("mae", F.when(F.col("gap") <= 5, F.col("mae")).otherwise(F.col("mae") + 1)).withColumn("version", F.lit("other"))
    return studies.role_differences(ev.withColumn("version", F.lit("published")).unionByName(other), ["anchor"], ["year"], "version", "published", "other", "mae")


@_add("x8_decision", f"{EV}, {_PD}, s AS (SELECT count(*) AS c, count(*) FILTER (abs(mean) > 1.96 * se) AS s, count(*) FILTER (abs(mean) > 1.96 * se AND mean > 0) AS p FROM rd) SELECT c AS contrasts, s AS significant, p AS positive, CASE WHEN s = 0 THEN 'no_evidence' WHEN p = s THEN 'supported' WHEN p = 0 THEN 'contradicted' ELSE 'mixed' END AS verdict FROM s")
def _(spark, sf_dir):
    p = F.when(F.abs("mean") > 1.96 * F.col("se"), 0.01).otherwise(0.5)
    return studies.decision(_roles(spark, sf_dir).withColumn("p", p), "mean", "p", 0.05)


@_add("k3_criteria", f"{EV}, m AS (SELECT model, avg(mae) AS m, count(DISTINCT gap) AS g FROM ev GROUP BY model), c AS (SELECT count(*) AS n, count(*) FILTER (m < 5.0) AS a, count(*) FILTER (g = 7) AS b FROM m) SELECT 'all_gaps' AS criterion, n AS asked, b AS met, b = n AS passed FROM c UNION ALL SELECT 'low_error', n, a, a = n FROM c")
def _(spark, sf_dir):
    m = _ev(spark, sf_dir).groupBy("model").agg(F.avg("mae").alias("m"), F.countDistinct("gap").alias("g"))
    return studies.criteria(m, {"low_error": F.col("m") < 5.0, "all_gaps": F.col("g") == 7})


@_add("k4_grid_completeness", f"{EV}, p AS (SELECT model, anchor, gap, count(*) AS k, count(*) FILTER (mae IS NULL) AS z FROM ev GROUP BY ALL), n AS (SELECT count(*) AS n FROM (SELECT DISTINCT anchor, gap FROM ev)) SELECT model, any_value(n) AS expected, count(*) AS present, any_value(n) - count(*) AS missing, count(*) FILTER (k > 1) AS repeated, CAST(sum(z) AS BIGINT) AS nulls FROM p, n GROUP BY model")
def _(spark, sf_dir):
    return studies.grid_completeness(_ev(spark, sf_dir), "model", ["anchor", "gap"], "mae")


_TWO = "a AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS p FROM orders WHERE o_orderkey % 3 = 0), b AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS p FROM orders WHERE o_orderkey % 3 <> 1)"


@_add("k6_conflict_free_union", f"WITH {_TWO}, u AS (SELECT * FROM a UNION SELECT * FROM b) SELECT k, p, count(*) OVER (PARTITION BY k) > 1 AS conflict FROM u")
def _(spark, sf_dir):
    o = adapters.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("p"), "o_orderkey")
    return studies.conflict_free_union([o.where("o_orderkey % 3 = 0").drop("o_orderkey"), o.where("o_orderkey % 3 <> 1").drop("o_orderkey")], ["k"])


@_add("k7_covered_runs", f"{EV} SELECT model, seed, anchor, count(*) AS n FROM ev WHERE gap <= 3 AND (model, seed, anchor) IN (SELECT (model, seed, anchor) FROM ev WHERE gap = 7) GROUP BY ALL")
def _(spark, sf_dir):
    ev, run = _ev(spark, sf_dir), ["model", "seed", "anchor"]
    return studies.covered_runs(ev.where("gap = 7"), ev.where("gap <= 3"), run).groupBy(*run).agg(F.count(F.lit(1)).alias("n"))


@_add("k9_run_diagnostics", f"{EV}, l AS (SELECT model, gap, round(avg(mae), 9) AS loss FROM ev GROUP BY ALL) SELECT model, max(gap) AS epochs, first(gap ORDER BY loss, gap) AS best_epoch, {r('min(loss)', 'best_loss')}, bool_and(loss IS NOT NULL) AS finite FROM l GROUP BY model")
def _(spark, sf_dir):
    log = _ev(spark, sf_dir).groupBy("model", "gap").agg(F.round(F.avg("mae"), 9).alias("loss"))
    return studies.run_diagnostics(log, "model", "gap", "loss")


@_add("o1_cell_overlaps", f"""{IV}, c AS (SELECT entity, interval_id, start_date + CAST(unnest(range(0, 31)) AS INT) AS d FROM iv),
b AS (SELECT x.interval_id, y.interval_id AS other, count(*) AS shared FROM c x JOIN c y ON x.entity = y.entity AND x.d = y.d AND x.interval_id < y.interval_id GROUP BY ALL) SELECT interval_id, other, shared, {r('shared / (62 - shared)', 'jaccard')}, {r('shared / 31', 'overlap')}, shared = 31 AS duplicate FROM b""")
def _(spark, sf_dir):
    return studies.span_overlaps(adapters.interval_table(spark, sf_dir), "interval_id", ["entity"])


@_add("o5_replication", f"""{IV}, c AS (SELECT *, CASE WHEN start_date <= max(end_date) OVER (PARTITION BY entity ORDER BY start_date, interval_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM iv), g AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY start_date, interval_id) AS cl FROM c),
n AS (SELECT entity, cl, count(*) AS n FROM g GROUP BY ALL) SELECT entity, CAST(sum(n) AS BIGINT) AS intervals, count(*) AS clusters, max(n) AS largest, {r('sum(n) * sum(n) / sum(n * n)', 'effective_n')} FROM n GROUP BY entity""")
def _(spark, sf_dir):
    return studies.replication(analysis.interval_clusters(adapters.interval_table(spark, sf_dir)), ["entity"])


@_add("r14_bound_anchors", f"""{ORDERS}, {_STARTS.format(n=9)}, c AS (SELECT entity, variable, ts + 4 AS ts FROM starts), s AS (SELECT *, {_SEASON} AS season FROM c), an AS (SELECT entity, season, ts AS center_date, row_number() OVER (PARTITION BY entity, variable, season ORDER BY {_KEY}) AS seed FROM s QUALIFY seed <= 5)
SELECT entity, CAST(len AS BIGINT) AS length, seed, season, center_date FROM an, (VALUES (3), (9)) l(len) WHERE seed <= 2""", dates="center_date")
def _(spark, sf_dir):
    p = _orders(spark, sf_dir)
    anchors = gaps.anchors(p, 10, 5, SEED).select("entity", F.col("anchor_no").cast("long").alias("seed"), "season", "center_date")
    conditions = p.select("entity").distinct().withColumn("length", F.explode(F.lit([3, 9]).cast("array<long>"))).withColumn("seed", F.explode(F.lit([1, 2]).cast("array<long>")))
    return studies.anchors_for(conditions, anchors, ["entity", "seed"])


@_add("a17_station_summary", f"{SHIP}, s AS (SELECT entity, variable, min(ts) FILTER (observed) AS lo, max(ts) FILTER (observed) AS hi, avg(CAST(observed AS INT)) AS c FROM panel GROUP BY ALL) SELECT entity, min(lo) AS first_day, max(hi) AS last_day, string_agg(variable, ',' ORDER BY variable) AS variables, {r('avg(c)', 'mean_coverage')}, {r('min(c)', 'least_coverage')} FROM s GROUP BY entity", dates="first_day last_day")
def _(spark, sf_dir):
    return studies.station_summary(_ship(spark, sf_dir))


@_add("a18_frontiers_and_shares", f"{EV}, {_U}, {_first('ci', 'model', 'lo', '0')}, {_COAL} SELECT model, {r('frontier')}, censoring, CAST(NULL AS VARCHAR) AS mask, CAST(NULL AS DOUBLE) AS v FROM fr UNION ALL SELECT unit, NULL, NULL, CAST(mask AS VARCHAR), {r('v')} FROM co")
def _(spark, sf_dir):
    f = studies.statistical_frontier(_curve(spark, sf_dir), ["model"], "gap")
    return f.unionByName(_coalitions(spark, sf_dir).select(F.col("unit").alias("model"), F.col("mask").cast("string").alias("mask"), "v"), allowMissingColumns=True)
