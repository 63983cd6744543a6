"""Queries on tests and comparisons, with their SQL twins.

The twins integrate the densities by Simpson's rule and count rank sums by a recursive query.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelscope.operators import inference, scores
from panelscope.plans.catalog import _PAIR, EV, ORDERS, SEED, SQL, _add, _pairs, r
from panelscope.plans.draws import DRAWS, _drawn, _interval
from panelscope.plans.results import _months
from panelscope.plans import scores as _scores  # noqa: F401 (registers the twins that are continued here)
from panelscope.sources import adapters

_EVS = EV.replace("WITH", "WITH RECURSIVE", 1)


def _normal(z: str) -> str:
    """Two-sided p of a normal z."""
    return f"2 / sqrt(2 * pi()) * 0.002 * list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-(abs({z}) + i * 0.006) * (abs({z}) + i * 0.006) / 2)))"


def _student(t: str, n: str) -> str:
    """Two-sided p of Student's t with n degrees of freedom, over the angle of its tangent."""
    area = lambda a: f"(pi() / 2 - {a}) / 6000 * list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(greatest(cos({a} + (pi() / 2 - {a}) * i / 2000), 0), {n} - 1)))"
    return f"({area(f'atan(abs({t}) / sqrt({n}))')}) / ({area('0')})"


def _tested(src: str, by: str) -> str:
    """CTE ``st`` (by, n_pairs, n, statistic, z, p, method) of diff in ``src``."""
    return f"""s0 AS (SELECT {by}, CASE WHEN abs(diff) <= 1e-8 THEN 0 ELSE diff END AS d FROM {src} WHERE diff IS NOT NULL), s1 AS (SELECT *, abs(d) AS a FROM s0 WHERE d <> 0), s2 AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY a) + (count(*) OVER (PARTITION BY {by}, a) - 1) / 2.0 AS rk FROM s1),
s3 AS (SELECT {by}, CAST(sum(t * t * t - t) AS DOUBLE) AS ties FROM (SELECT {by}, a, count(*) AS t FROM s1 GROUP BY {by}, a) GROUP BY {by}), s4 AS (SELECT {by}, count(*) AS n, CAST(least(coalesce(sum(rk) FILTER (d > 0), 0), coalesce(sum(rk) FILTER (d < 0), 0)) AS DOUBLE) AS statistic FROM s2 GROUP BY {by}),
s5 AS (SELECT s0b.*, coalesce(n, 0) AS n, coalesce(statistic, 0.0) AS statistic, coalesce(ties, 0.0) AS ties FROM (SELECT {by}, count(*) AS n_pairs FROM s0 GROUP BY {by}) s0b LEFT JOIN s4 USING ({by}) LEFT JOIN s3 USING ({by})), s6 AS (SELECT *, (statistic - n * (n + 1) / 4) / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 0) AS z FROM s5),
nl AS (SELECT 0 AS k, CAST([1.0] AS DOUBLE[]) AS c UNION ALL SELECT k + 1, list_transform(range(0, len(c) + k + 1), lambda i: coalesce(c[i + 1], 0) + CASE WHEN i >= k + 1 THEN coalesce(c[i - k], 0) ELSE 0 END) FROM nl WHERE k < 50),
st AS (SELECT {by}, n_pairs, n, statistic, z, CASE WHEN n = 0 THEN 1.0 WHEN n_pairs <= 50 AND n = n_pairs AND ties = 0 THEN least(1.0, 2 * list_sum(c[1:CAST(statistic AS INT) + 1]) / pow(2, n)) ELSE {_normal('z')} END AS p, CASE WHEN n = 0 THEN 'all_equal' WHEN n_pairs <= 50 AND n = n_pairs AND ties = 0 THEN 'exact' ELSE 'normal' END AS method FROM s6 LEFT JOIN nl ON k = n)"""


def _corrected(by: str, family: str) -> str:
    """CTE ``bh`` (by, q) of st."""
    part = f"PARTITION BY {family} " if family else ""
    ident = ", ".join(f"CAST({b.strip()} AS VARCHAR)" for b in by.split(","))
    return f"b0 AS (SELECT {by}, p, row_number() OVER ({part}ORDER BY p, concat_ws('|', {ident})) AS k, count(*) OVER ({part.strip()}) AS m FROM st WHERE p IS NOT NULL), bh AS (SELECT {by}, least(1.0, min(p * m / k) OVER ({part}ORDER BY k DESC)) AS q FROM b0)"


def _effects(src: str, by: str, family: str = "", boot: str = "") -> str:
    more = f", {r('ci_lower')}, {r('ci_upper')}" if boot else ""
    return f"""{_tested(src, by)}, {_corrected(by, family)}, ef AS (SELECT {by}, avg(diff) AS mean, quantile_cont(diff, 0.5) AS median, stddev_samp(diff) / sqrt(count(diff)) AS se FROM {src} WHERE diff IS NOT NULL GROUP BY {by})
SELECT {by}, {r('mean')}, {r('median')}, {r('se')}, {r('mean - 1.96 * se', '"lower"')}, {r('mean + 1.96 * se', '"upper"')}, n_pairs, n, {r('statistic')}, {r('z')}, {r('p', 'p_value')}, method{more}, {r('q', 'q_bh')} FROM ef JOIN st USING ({by}) JOIN bh USING ({by}) {boot}"""


def _ev(spark, sf_dir):
    return adapters.eval_table(spark, sf_dir).withColumn("site", F.col("anchor") % 5)


_SITES = f"{_PAIR}, px AS (SELECT year, anchor % 5 AS site, anchor, round(diff, 9) AS diff FROM pr)"


@_add("b3_signed_rank_p", f"{_EVS}, {_SITES}, {_tested('px', 'year, site')} SELECT year, site, n_pairs, n, {r('statistic')}, {r('z')}, {r('p', 'p_value')}, method FROM st")
def _(spark, sf_dir):
    d = _pairs(spark, sf_dir).withColumns({"site": F.col("anchor") % 5, "diff": F.round("diff", 9)})
    return inference.signed_rank_test(d, ["year", "site"])


@_add("x7_tested_effects", f"{_EVS}, {_SITES}, {_effects('px', 'year')}")
def _(spark, sf_dir):
    d = _pairs(spark, sf_dir).withColumns({"diff": F.round("diff", 9), "family": F.lit("all")})
    return inference.effects(d, ["year"], [])


#: Even years stand for events, odd ones for their controls.
_ROLES = "px AS (SELECT gap, anchor % 5 AS site, anchor, round(avg(mae) FILTER (year % 2 = 0) - avg(mae) FILTER (year % 2 = 1), 9) AS diff FROM ev GROUP BY ALL HAVING diff IS NOT NULL)"


@_add("x1_tested_roles", f"""{_EVS}, {_ROLES}, cs AS (SELECT gap, site, anchor, sum(diff) AS s, count(*) AS k FROM px GROUP BY ALL), {_drawn('cs', 'gap', 'site', 'anchor', 's', 'k')}, ci AS (SELECT gap, {_interval('m[1]')} FROM dr GROUP BY gap), {_effects('px', 'gap', '', 'JOIN ci USING (gap)')}""")
def _(spark, sf_dir):
    side = lambda k: F.avg(F.when(F.col("year") % 2 == k, F.col("mae")))
    d = _ev(spark, sf_dir).groupBy("gap", "site", "anchor").agg(F.round(side(0) - side(1), 9).alias("diff"))
    return inference.effects(d, ["gap"], [], unit="anchor", draws=DRAWS, seed=SEED, strata=["site"])


_VERSIONS = "px AS (SELECT year, seed, anchor, round(avg(mae) - avg(CASE WHEN gap <= 5 THEN mae ELSE mae + 1 END), 9) AS diff FROM ev GROUP BY ALL)"


@_add("x2_tested_versions", f"{_EVS}, {_VERSIONS}, {_effects('px', 'year, seed', 'seed')}")
def _(spark, sf_dir):
    other = F.when(F.col("gap") <= 5, F.col("mae")).otherwise(F.col("mae") + 1)
    d = _ev(spark, sf_dir).groupBy("year", "seed", "anchor").agg(F.round(F.avg("mae") - F.avg(other), 9).alias("diff"))
    return inference.effects(d, ["year", "seed"], ["seed"])


@_add("n5_failure_hypotheses", f"{_EVS}, px AS (SELECT a.seed, a.model, a.anchor, round(a.m - b.m, 9) AS diff FROM (SELECT seed, model, anchor, avg(mae) AS m FROM ev GROUP BY ALL) a JOIN (SELECT seed, anchor, avg(mae) AS m FROM ev WHERE model = 'N' GROUP BY ALL) b USING (seed, anchor) WHERE a.model <> 'N'), {_effects('px', 'seed, model', 'seed')}")
def _(spark, sf_dir):
    return inference.failure_hypotheses(_ev(spark, sf_dir), ["seed"], ["anchor"], "model", "N", "mae")


_VS = "px AS (SELECT gap, model, anchor, round(a.m - b.m, 9) AS diff FROM (SELECT gap, model, anchor, avg(mae) AS m FROM ev WHERE model <> 'N' GROUP BY ALL) a JOIN (SELECT gap, anchor, avg(mae) AS m FROM ev WHERE model = 'N' GROUP BY ALL) b USING (gap, anchor))"


@_add("b6_compare_models", f"""{_EVS}, {_VS}, cs AS (SELECT gap, model, CAST(anchor AS VARCHAR) AS u, diff AS s, 1 AS k FROM px), {_drawn('cs', 'gap, model', '', 'u', 's', 'k')}, ci AS (SELECT gap, model, {_interval('m[1]')} FROM dr GROUP BY gap, model), {_tested('px', 'gap, model')}, ef AS (SELECT gap, model, avg(diff) AS mean_difference, quantile_cont(diff, 0.5) AS median_difference FROM px GROUP BY gap, model),
h0 AS (SELECT gap, model, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, concat_ws('|', CAST(gap AS VARCHAR), model)) + 1) * p) AS s, p FROM st), h1 AS (SELECT gap, model, max(s) OVER (ORDER BY p, concat_ws('|', CAST(gap AS VARCHAR), model) ROWS UNBOUNDED PRECEDING) AS h FROM h0)
SELECT gap, model, {r('mean_difference')}, {r('CASE WHEN n_pairs > 1 THEN ci_lower END', 'ci_lower')}, {r('CASE WHEN n_pairs > 1 THEN ci_upper END', 'ci_upper')}, {r('median_difference')}, n_pairs, n, {r('statistic')}, {r('p', 'p_value')}, method, {r('h', 'p_holm')} FROM ef JOIN st USING (gap, model) JOIN ci USING (gap, model) JOIN h1 USING (gap, model)""")
def _(spark, sf_dir):
    return inference.compare_models(_ev(spark, sf_dir), ["gap"], "model", "N", ["anchor"], "mae", DRAWS, SEED)


_Z = "((s - sign(s)) / sqrt(var_s))"


@_add("m12_trend_test", f"SELECT *, {r('s / (n * (n - 1) / 2)', 'tau')}, {r(_normal(_Z), 'p_value')}, CASE WHEN s > 0 THEN 'increasing' WHEN s < 0 THEN 'decreasing' ELSE 'no_change' END AS direction, CASE WHEN {_normal(_Z)} < 0.05 THEN CASE WHEN s > 0 THEN 'increasing' WHEN s < 0 THEN 'decreasing' ELSE 'no_change' END ELSE 'no_significant_trend' END AS significant_trend FROM ({SQL['m12_mann_kendall']})")
def _(spark, sf_dir):
    return inference.trend_test(_months(spark, sf_dir), ["entity"], "x", "y")


_T = "spearman * sqrt((gaps - 2) / ((1 - spearman) * (1 + spearman)))"


#: Inputs are the rounded results of the row before, so four digits are compared.
_U2 = ", ".join(f"round({c} + 1e-10, 4) + 0.0 AS {c}" for c in ("spearman", "first_width", "last_width"))
_P = f"CASE WHEN gaps < 3 OR spearman IS NULL THEN NULL WHEN abs(spearman) >= 1 - 1e-12 THEN 0.0 ELSE {_student(_T, '(gaps - 2)')} END"


@_add("u2_width_growth_p", f"SELECT model, gaps, {_U2}, round({_P} + 1e-10, 4) + 0.0 AS p_value FROM ({SQL['u2_width_growth']})", 4)
def _(spark, sf_dir):
    units = scores.calibration(adapters.eval_table(spark, sf_dir), ["model", "anchor", "gap"], "gap", "mae_clim", "mae", 0.9)
    return inference.width_growth_test(units, ["model"], "gap")
