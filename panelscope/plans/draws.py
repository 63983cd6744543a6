"""Queries on bootstraps, curves and frontiers of evaluation tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelscope.operators import joins, resampling
from panelscope.plans.catalog import _PAIR, EV, SEED, _add, _pairs, r
from panelscope.sources import adapters

DRAWS, GAPS = 2000, [1, 2, 3, 4, 5, 6, 7]
#: Anchors of five sites; a skill that falls with the gap.
_EVENTS = f"{EV}, es AS (SELECT *, anchor % 5 AS site, 1 - mae / 9.0 - gap * 0.06 AS skill FROM ev)"


def _events(spark, sf_dir):
    e = adapters.eval_table(spark, sf_dir)
    return e.withColumns({"site": F.col("anchor") % 5, "skill": 1 - F.col("mae") / 9.0 - F.col("gap") * 0.06})


def _means(n: str, sums: str) -> str:
    return ", ".join(f"round(sum({s}) / sum({n}), 9)" for s in sums.split())


def _drawn(src: str, by: str, strata: str, cluster: str, sums: str, n: str) -> str:
    """CTE ``dr`` (by, draw, m): the means of every draw as a list."""
    group = ", ".join(x for x in (by, strata) if x)
    text = ", ".join(f"CAST({c.strip()} AS VARCHAR)" for c in group.split(","))
    return f"""nu AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {cluster}) - 1 AS i, count(*) OVER (PARTITION BY {group}) AS m FROM {src}),
pk AS (SELECT {group}, draw, CAST(('0x' || substr(md5(concat_ws('|', '{SEED}', {text}, CAST(draw AS VARCHAR), CAST(i AS VARCHAR))), 1, 8)) AS BIGINT) % m AS i FROM nu, range(1, {DRAWS + 1}) t(draw)),
dr AS MATERIALIZED (SELECT {by}, draw, [{_means(n, sums)}] AS m FROM pk JOIN nu USING ({group}, i) GROUP BY {by}, draw)"""


def _interval(e: str, lo: str = "ci_lower", hi: str = "ci_upper") -> str:
    return f"quantile_cont({e}, 0.025) AS {lo}, quantile_cont({e}, 0.975) AS {hi}"


def _mean_query(by: str, strata: str, cluster: str, value: str) -> str:
    keys = ", ".join(x for x in (by, strata, cluster) if x)
    return f"""{_EVENTS}, cs AS (SELECT {keys}, sum({value}) AS s, count(*) AS k FROM es GROUP BY ALL), {_drawn('cs', by, strata, cluster, 's', 'k')}, ci AS (SELECT {by}, {_interval('m[1]')} FROM dr GROUP BY {by}), en AS (SELECT {by}, CAST(sum(k) AS BIGINT) AS n_rows, count(*) AS n_clusters, sum(s) / sum(k) AS estimate FROM cs GROUP BY {by})
SELECT {by}, n_rows, n_clusters, {r('estimate')}, {r('CASE WHEN n_clusters > 1 THEN ci_lower END', 'ci_lower')}, {r('CASE WHEN n_clusters > 1 THEN ci_upper END', 'ci_upper')} FROM en LEFT JOIN ci USING ({by})"""


@_add("b8_stratified_bootstrap", _mean_query("model", "site, year", "anchor", "skill"))
def _(spark, sf_dir):
    return resampling.bootstrap_mean(_events(spark, sf_dir), ["model"], "anchor", "skill", DRAWS, SEED, ["site", "year"])


@_add("b7_cluster_bootstrap", _mean_query("model", "", "anchor", "mae"))
def _(spark, sf_dir):
    return resampling.bootstrap_mean(_events(spark, sf_dir), ["model"], "anchor", "mae", DRAWS, SEED)


@_add("b1_bootstrap_mean", f"""{EV}, {_PAIR}, es AS (SELECT year, anchor, round(diff, 9) AS v FROM pr), cs AS (SELECT year, anchor, v AS s, 1 AS k FROM es), {_drawn('cs', 'year', '', 'anchor', 's', 'k')}, ci AS (SELECT year, {_interval('m[1]')} FROM dr GROUP BY year), en AS (SELECT year, count(*) AS n_units, avg(s) AS estimate FROM cs GROUP BY year)
SELECT year, n_units, {r('estimate')}, {r('CASE WHEN n_units > 1 THEN ci_lower END', 'ci_lower')}, {r('CASE WHEN n_units > 1 THEN ci_upper END', 'ci_upper')} FROM en LEFT JOIN ci USING (year)""")
def _(spark, sf_dir):
    got = resampling.bootstrap_mean(_pairs(spark, sf_dir).withColumn("diff", F.round("diff", 9)), ["year"], "anchor", "diff", DRAWS, SEED)
    return got.withColumnRenamed("n_clusters", "n_units").drop("n_rows")


@_add("a16_result_summary", f"""{EV}, w AS (SELECT model, 'mae' AS metric, anchor, avg(mae) AS v FROM ev GROUP BY ALL UNION ALL SELECT model, 'mae_clim', anchor, avg(mae_clim) FROM ev GROUP BY ALL), cs AS (SELECT model, metric, anchor, round(v, 9) AS s, 1 AS k FROM w), {_drawn('cs', 'model, metric', '', 'anchor', 's', 'k')}, ci AS (SELECT model, metric, {_interval('m[1]')} FROM dr GROUP BY model, metric),
e AS (SELECT model, metric, count(*) AS n_units, avg(s) AS mean, quantile_cont(s, 0.5) AS median, stddev_samp(s) AS std FROM cs GROUP BY ALL) SELECT model, metric, n_units, {r('mean')}, {r('median')}, {r('std')}, {r('CASE WHEN n_units > 1 THEN ci_lower END', 'ci_lower')}, {r('CASE WHEN n_units > 1 THEN ci_upper END', 'ci_upper')} FROM e JOIN ci USING (model, metric)""")
def _(spark, sf_dir):
    u = _events(spark, sf_dir).groupBy("model", "anchor").agg(F.avg("mae").alias("mae"), F.avg("mae_clim").alias("mae_clim"))
    u = u.unpivot(["model", "anchor"], ["mae", "mae_clim"], "metric", "v").withColumn("v", F.round("v", 9))
    return joins.result_summary(u, ["model", "metric"], "v", "anchor", DRAWS, SEED)


@_add("f1_skill_curve", _mean_query("model, gap", "", "anchor", "skill"))
def _(spark, sf_dir):
    return resampling.bootstrap_mean(_events(spark, sf_dir), ["model", "gap"], "anchor", "skill", DRAWS, SEED)


def _curves(unit: str) -> str:
    """CTE ``cu`` (unit, g0 to g6): whole curves; ``ca``: all."""
    at = ", ".join(f"avg(skill) FILTER (gap = {g}) AS g{i}" for i, g in enumerate(GAPS))
    return f"ca AS (SELECT {unit}, {at} FROM es GROUP BY {unit}), cu AS MATERIALIZED (SELECT * FROM ca WHERE {' AND '.join(f'g{i} IS NOT NULL' for i in range(len(GAPS)))})"


def _lost(m: str) -> str:
    """Frontier and censoring of a list over the gaps 1 to 7, for a zero threshold."""
    at = f"list_position(list_transform({m}, lambda x: x <= 0), true)"
    return f"CASE WHEN {at} IS NULL OR {at} = 0 THEN 7.0 WHEN {at} > 1 THEN CASE WHEN abs({m}[{at} - 1] - {m}[{at}]) <= 1e-8 + 1e-5 * abs({m}[{at}]) THEN {at} - 1 ELSE {at} - 1 + (0 - {m}[{at} - 1]) / ({m}[{at}] - {m}[{at} - 1]) END END"


def _end(m: str) -> str:
    at = f"list_position(list_transform({m}, lambda x: x <= 0), true)"
    return f"CASE WHEN {at} IS NULL OR {at} = 0 THEN 'right' WHEN {at} = 1 THEN 'left' ELSE 'none' END"


_G = " ".join(f"g{i}" for i in range(len(GAPS)))
_AVG = ", ".join(f"avg(g{i})" for i in range(len(GAPS)))
_RUN = "list_transform(range(1, 8), lambda i: list_min({m}[1:i]))"


@_add("f10_frontier_interval", f"""{_EVENTS}, {_curves('model, anchor')}, c1 AS (SELECT *, 1 AS k FROM cu), {_drawn('c1', 'model', '', 'anchor', _G, 'k')}, df AS (SELECT model, {_RUN.format(m='m')} AS m FROM dr), dd AS (SELECT model, {_end('m')} AS e, CASE WHEN {_end('m')} = 'left' THEN 0.0 ELSE {_lost('m')} END AS f FROM df),
pt AS (SELECT model, n_units, {_RUN.format(m='p')} AS m FROM (SELECT model, count(*) AS n_units, [{_AVG}] AS p FROM cu GROUP BY model)), di AS (SELECT model, {_interval('f')}, count(*) FILTER (e = 'left') AS left_censored, count(*) FILTER (e = 'right') AS right_censored FROM dd GROUP BY model),
lo AS (SELECT model, count(*) - (SELECT count(*) FROM cu WHERE cu.model = ca.model) AS n_incomplete FROM ca GROUP BY model)
SELECT model, n_incomplete, n_units, {r("CASE WHEN " + _end('m') + " = 'left' THEN 0.0 ELSE " + _lost('m') + " END", 'frontier_days')}, CASE WHEN m IS NOT NULL THEN {_end('m')} END AS censoring, {r('CASE WHEN n_units > 1 THEN ci_lower END', 'ci_lower')}, {r('CASE WHEN n_units > 1 THEN ci_upper END', 'ci_upper')}, CASE WHEN n_units > 1 THEN left_censored END AS left_censored, CASE WHEN n_units > 1 THEN right_censored END AS right_censored FROM lo LEFT JOIN pt USING (model) LEFT JOIN di USING (model)""")
def _(spark, sf_dir):
    return resampling.frontier_interval(_events(spark, sf_dir), ["model"], "anchor", "gap", "skill", GAPS, DRAWS, SEED)


_FIT = "list_transform(range(1, 8), lambda i: round(list_min(list_transform(range(1, i + 1), lambda s: list_max(list_transform(range(i, 8), lambda t: list_avg({m}[s:t]))))), 9))"
_JOINT = f"""{_EVENTS}, {_curves('model, site, year, anchor')}, cc AS (SELECT model, site, year, anchor, count(*) AS k, {', '.join(f'sum(g{i}) AS g{i}' for i in range(len(GAPS)))} FROM cu GROUP BY ALL), {_drawn('cc', 'model', 'site, year', 'anchor', _G, 'k')},
jd AS (SELECT model, m, {_FIT.format(m='m')} AS f FROM dr), jp AS (SELECT model, nc, p, {_FIT.format(m='p')} AS f FROM (SELECT model, count(*) AS nc, [{', '.join(f'round(avg(g{i}), 9)' for i in range(len(GAPS)))}] AS p FROM cu GROUP BY model)),
sz AS (SELECT model, CAST(sum(c) AS BIGINT) AS n_clusters, count(*) FILTER (c >= 2) AS n_resampleable_strata FROM (SELECT model, site, year, count(DISTINCT anchor) AS c FROM cu GROUP BY ALL) GROUP BY model), lo AS (SELECT model, count(*) - (SELECT count(*) FROM cu WHERE cu.model = ca.model) AS n_incomplete FROM ca GROUP BY model)"""


def _summary(k: str, m: str) -> str:
    at = f"list_position(list_transform({m}, lambda x: x <= 0), true)"
    return f"{r(_lost(m), k + '_frontier')}, {_end(m)} AS {k}_censoring, coalesce({at} > 0 AND len(list_filter({m}[{at} + 1:], lambda x: x > 0)) > 0, false) AS {k}_reversal"


@_add("f11_joint_frontiers", f"""{_JOINT}, jl AS (SELECT model, {_lost('m')} AS rf, {_end('m')} AS re, {_lost('f')} AS sf, {_end('f')} AS se FROM jd),
ji AS (SELECT model, {_interval('rf', 'raw_lower', 'raw_upper')}, {_interval('sf', 'smooth_lower', 'smooth_upper')}, count(*) FILTER (re = 'left') AS raw_left, count(*) FILTER (re = 'right') AS raw_right, count(*) FILTER (se = 'left') AS smooth_left, count(*) FILTER (se = 'right') AS smooth_right FROM jl GROUP BY model)
SELECT model, nc AS n_complete, n_incomplete, n_clusters, n_resampleable_strata, {_summary('raw', 'p')}, {_summary('smooth', 'f')}, {r('raw_lower')}, {r('raw_upper')}, {r('smooth_lower')}, {r('smooth_upper')}, raw_left, raw_right, smooth_left, smooth_right FROM lo JOIN jp USING (model) JOIN sz USING (model) JOIN ji USING (model) WHERE n_resampleable_strata > 0""")
def _(spark, sf_dir):
    got, _ = resampling.joint_frontiers(_events(spark, sf_dir), ["model"], ["site", "year"], "anchor", "anchor", "gap", "skill", GAPS, DRAWS, SEED)
    return got.where("n_resampleable_strata > 0")


@_add("f11_joint_curves", f"""{_JOINT}, jc AS (SELECT model, g, m[g] AS v FROM jd, range(1, 8) t(g)), ci AS (SELECT model, g, {_interval('v')} FROM jc GROUP BY model, g)
SELECT model, CAST(g AS DOUBLE) AS gap, {r('p[g]', 'raw_value')}, {r('f[g]', 'monotone_value')}, abs(f[g] - p[g]) > 1e-8 AS adjusted, CASE WHEN n_resampleable_strata > 0 AND nc > 1 THEN {r('ci_lower').replace(' AS ci_lower', '')} END AS ci_lower, CASE WHEN n_resampleable_strata > 0 AND nc > 1 THEN {r('ci_upper').replace(' AS ci_upper', '')} END AS ci_upper FROM jp JOIN sz USING (model) JOIN ci USING (model)""")
def _(spark, sf_dir):
    _, curve = resampling.joint_frontiers(_events(spark, sf_dir), ["model"], ["site", "year"], "anchor", "anchor", "gap", "skill", GAPS, DRAWS, SEED)
    return curve
