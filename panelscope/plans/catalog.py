"""Every registered panel query: an operator on whole driver tables, with its SQL twin.

The twins share three views: ``obs`` (long observations), ``panel`` (on the full
calendar, with split and flag) and ``ev`` (the evaluation table).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelscope.functions import sqlfn
from panelscope.operators import analysis, audit, explore, fillers, gaps, metrics, panel
from panelscope.sources import adapters
from panelscope.sources.storage import stored

SEED = 20260815

_DAYS = """days AS (SELECT l_returnflag || l_linestatus AS entity, CAST(l_shipdate AS DATE) AS ts,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS "T", CAST(sum(l_quantity) AS DOUBLE) AS "F",
  CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS "L" FROM lineitem GROUP BY ALL)"""
_OBS = _DAYS + """, obs AS (SELECT entity, 'T' AS variable, ts, "T" AS value FROM days UNION ALL SELECT entity, 'F', ts, "F" FROM days UNION ALL SELECT entity, 'L', ts, "L" FROM days)"""
_ORD = """obs AS (SELECT o_orderpriority AS entity, 'N' AS variable, CAST(o_orderdate AS DATE) AS ts, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY ALL)"""
_SPLIT = "CASE WHEN ts <= DATE '1998-12-31' THEN 'train' WHEN ts <= DATE '1999-12-31' THEN 'validation' ELSE 'test' END"
_GRID = f"""cal AS (SELECT CAST(unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS DATE) AS ts FROM obs),
panel AS (SELECT k.entity, k.variable, c.ts, o.value, o.value IS NOT NULL AS observed, {_SPLIT.replace('ts', 'c.ts')} AS split
  FROM (SELECT DISTINCT entity, variable FROM obs) k CROSS JOIN cal c LEFT JOIN obs o ON o.entity = k.entity AND o.variable = k.variable AND o.ts = c.ts)"""
_EV = """ev AS (SELECT l_returnflag AS model, l_linestatus AS seed, l_suppkey AS anchor, CAST(l_linenumber AS BIGINT) AS gap, CAST(year(l_shipdate) AS BIGINT) AS year,
  CAST(round(l_discount * 100) AS BIGINT) AS mae, CAST(round(l_tax * 100) AS BIGINT) AS mae_clim FROM lineitem)"""
_IV = """iv AS (SELECT o_custkey AS entity, o_orderkey AS interval_id, CAST(o_orderdate AS DATE) AS start_date, CAST(o_orderdate AS DATE) + 30 AS end_date FROM orders)"""
SHIP, ORDERS, EV, IV = f"WITH {_OBS}, {_GRID}", f"WITH {_ORD}, {_GRID}", f"WITH {_EV}", f"WITH {_IV}"
_SEASON = "CASE WHEN month(ts) IN (12, 1, 2) THEN 'DJF' WHEN month(ts) IN (3, 4, 5) THEN 'MAM' WHEN month(ts) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END"
_DOY = "dayofyear(make_date(2000, month(ts), day(ts)))"
_W = "PARTITION BY entity, variable ORDER BY ts"


def _corr(x: str, y: str, least: int = 3) -> str:
    return f"CASE WHEN count(*) >= {least} AND stddev_pop({x}) > 1e-12 AND stddev_pop({y}) > 1e-12 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"


QUERIES, SQL = {}, {}


def _add(name: str, sql: str | None, digits: int = 6, dates: str = ""):
    """Register a query; doubles of both sides are rounded alike, just off
    the ties, for sums come in any order; days (``dates`` names them for the SQL) are texts."""

    def wrap(f):
        def run(spark, sf_dir):
            df = f(spark, sf_dir)
            return df.select(*[(F.round(F.col(c) + 1e-10, digits) + 0.0).alias(c) if t == "double" else F.col(c).cast({"int": "long", "date": "string"}[t]).alias(c) if t in ("int", "date") else F.col(c) for c, t in df.dtypes])

        QUERIES[name] = run
        if sql:
            plain = sql.replace("$$", "'")
            texts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates.split())
            SQL[name] = f"SELECT * REPLACE ({texts}) FROM ({plain})" if texts else plain
        return f

    return wrap


def _ship(spark, sf_dir):
    return panel.prepared(adapters.ship_panel(spark, sf_dir))


def _orders(spark, sf_dir):
    return panel.prepared(adapters.order_panel(spark, sf_dir))


def r(e: str, alias: str | None = None) -> str:
    return f"round(({e}) + 1e-10, 6) + 0.0 AS {alias or e}"


# preparation


@_add("j4_complete_calendar", f"{ORDERS} SELECT entity, variable, ts, value, observed, split FROM panel", dates="ts")
def _(spark, sf_dir):
    return _orders(spark, sf_dir).select("entity", "variable", "ts", "value", "observed", "split")


@_add("p12_calendar_features", f"""{ORDERS}, f AS (SELECT ts, CASE WHEN dayofyear(make_date(year(ts), 12, 31)) = 366 THEN 366 ELSE 365 END AS n FROM cal)
SELECT ts, {r('sin(2 * pi() * (dayofyear(ts) - 1) / n)', 'doy_sin')}, {r('cos(2 * pi() * (dayofyear(ts) - 1) / n)', 'doy_cos')}, {r('sin(2 * pi() * (month(ts) - 1) / 12)', 'month_sin')}, {r('cos(2 * pi() * (month(ts) - 1) / 12)', 'month_cos')},
year(ts) - 1995 AS year_index, n = 366 AS leap_year, {_SEASON} AS season, {_DOY} AS doy366 FROM f""", dates="ts")
def _(spark, sf_dir):
    days = _orders(spark, sf_dir).select("ts").distinct()
    return panel.calendar_features(days)


@_add("p1_decode_missing", f"{ORDERS} SELECT entity, variable, ts, value AS raw_value, CASE WHEN abs(value - 1) > 1e-9 AND abs(value - 3) > 1e-9 THEN value END AS value FROM panel", dates="ts")
def _(spark, sf_dir):
    return panel.decode_missing(_orders(spark, sf_dir), [1, 3]).select("entity", "variable", "ts", "raw_value", "value")


_RULES = [("NF", "T", "1996-01-01", "1996-03-31", "drift", 1), ("NF", "T", "1996-03-01", "1996-06-30", "late", 2), ("RF", "F", "1995-06-01", "1995-06-30", "stuck", 1), ("AF", "L", "1997-01-01", "2001-12-31", "scale", 1)]
_RULES_SQL = "rules(entity, variable, first_day, last_day, code, priority) AS (VALUES " + ", ".join(f"('{e}', '{v}', DATE '{a}', DATE '{b}', '{c}', {p})" for e, v, a, b, c, p in _RULES) + ")"
_FLAGGED = f"{SHIP}, {_RULES_SQL}, flagged AS (SELECT p.entity, p.variable, p.ts, p.value, p.split, arg_min(code, priority) AS code FROM panel p LEFT JOIN rules q ON p.entity = q.entity AND p.variable = q.variable AND p.ts BETWEEN first_day AND last_day GROUP BY ALL)"


def _flagged(spark, sf_dir):
    rules = spark.createDataFrame(_RULES, "entity string, variable string, first_day string, last_day string, code string, priority int")
    rules = rules.withColumn("first_day", F.to_date("first_day")).withColumn("last_day", F.to_date("last_day"))
    return panel.apply_rules(_ship(spark, sf_dir), F.broadcast(rules))


@_add("p4_known_issues", f"{_FLAGGED} SELECT entity, variable, ts, code AS known_issue_code, code IS NOT NULL AS known_issue_flag FROM flagged", dates="ts")
def _(spark, sf_dir):
    return _flagged(spark, sf_dir).select("entity", "variable", "ts", "known_issue_code", "known_issue_flag")


for _action, _expr in (("exclude", "CASE WHEN code IS NULL THEN value END"), ("shift", "CASE WHEN code IS NULL THEN value ELSE value - 8.48 END")):

    @_add(f"p7_version_{_action}", f"{_FLAGGED} SELECT entity, variable, split, count(*) FILTER (({_expr}) IS DISTINCT FROM value) AS changed, count(*) AS cells FROM flagged GROUP BY ALL")
    def _(spark, sf_dir, action=_action):
        return panel.changed_cells(panel.version_values(_flagged(spark, sf_dir), action), "raw_value", "value", ["entity", "variable", "split"])


@_add("r1_pivot_wide", f"""{SHIP} SELECT ts, {', '.join(r(f"max(value) FILTER (entity = '{e}' AND variable = '{v}')", f"{e}_{v}") for e in ('AF', 'NO', 'RF') for v in ('T', 'F'))} FROM panel GROUP BY ts""", dates="ts")
def _(spark, sf_dir):
    return panel.pivot_wide(_ship(spark, sf_dir), [f"{e}_{v}" for e in ("AF", "NO", "RF") for v in ("T", "F")])


@_add("r5_latest_per_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def _(spark, sf_dir):
    o = adapters.table(spark, sf_dir, "orders")
    return panel.latest_per_key(o, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@_add("r8_duplicates", "SELECT l_partkey, l_shipdate, count(*) AS n_rows, count(DISTINCT (l_quantity, l_discount)) AS n_distinct, CASE WHEN count(DISTINCT (l_quantity, l_discount)) = 1 THEN 'same' ELSE 'conflicting' END AS kind FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf_dir):
    return panel.duplicates(adapters.table(spark, sf_dir, "lineitem"), ["l_partkey", "l_shipdate"], ["l_quantity", "l_discount"])


@_add("r10_window_starts", f"{ORDERS}, n AS (SELECT entity, count(DISTINCT ts) AS n FROM obs GROUP BY entity) SELECT entity, n, unnest(list_distinct(range(0, n - 184 + 1, 92) || [n - 184])) AS start_row FROM n WHERE n >= 184")
def _(spark, sf_dir):
    return panel.window_starts(adapters.order_panel(spark, sf_dir), 184, 92)


@_add("r7_powerset", """WITH s AS (SELECT list_sort(list(DISTINCT l_returnflag || l_linestatus)) AS s FROM lineitem), m AS (SELECT s, unnest(range(0, 1 << len(s))) AS mask FROM s),
x AS (SELECT mask, list_filter(list_transform(range(1, len(s) + 1), lambda i: CASE WHEN (mask >> CAST(i - 1 AS INT)) & 1 = 1 THEN s[i] END), lambda y: y IS NOT NULL) AS l FROM m)
SELECT mask, coalesce(array_to_string(l, '+'), '') AS members, CAST(len(l) AS BIGINT) AS n_members FROM x""")
def _(spark, sf_dir):
    return panel.powerset(adapters.ship_days(spark, sf_dir), "entity")


# audits


@_add("a1_series_summary", f"""{SHIP} SELECT entity, variable, count(*) AS n_days, count(value) AS n_obs, {r('1 - count(value) / count(*)', 'missing_rate')}, {r('avg(value)', 'mean')}, {r('stddev_pop(value)', 'std')}, {r('min(value)', 'min')}, {r('max(value)', 'max')},
{', '.join(r(f'quantile_cont(value, {q})', n) for q, n in ((0.01, 'q01'), (0.25, 'q25'), (0.5, 'median'), (0.75, 'q75'), (0.99, 'q99')))} FROM panel GROUP BY entity, variable""")
def _(spark, sf_dir):
    return audit.series_summary(_ship(spark, sf_dir))


@_add("a3_date_continuity", f"{ORDERS} SELECT entity, datediff('day', min(ts), max(ts)) + 1 AS expected, count(DISTINCT ts) AS unique_days, count(*) - count(DISTINCT ts) AS duplicates, datediff('day', min(ts), max(ts)) + 1 - count(DISTINCT ts) AS missing_days FROM obs GROUP BY entity")
def _(spark, sf_dir):
    return audit.date_continuity(adapters.order_panel(spark, sf_dir))


@_add("a4_constant_runs", f"""{ORDERS}, f AS (SELECT *, CASE WHEN lag(value) OVER w = value AND lag(ts) OVER w = ts - 1 THEN 0 ELSE 1 END AS new FROM obs WINDOW w AS ({_W})),
g AS (SELECT *, sum(new) OVER ({_W}) AS run FROM f) SELECT entity, variable, min(ts) AS start_date, max(ts) AS end_date, count(*) AS n_days, any_value(value) AS value FROM g GROUP BY entity, variable, run HAVING count(*) >= 3""", dates="start_date end_date")
def _(spark, sf_dir):
    return audit.constant_runs(adapters.order_panel(spark, sf_dir), 3)


@_add("a7_availability", f"{ORDERS} SELECT split, entity, variable, count(*) AS n_days, count(*) FILTER (observed) AS n_observed, {r('count(*) FILTER (observed) / count(*)', 'availability')} FROM panel GROUP BY ALL")
def _(spark, sf_dir):
    return audit.availability(_orders(spark, sf_dir))


@_add("a8_quality_crosstab", f"{SHIP} SELECT variable, split, CASE WHEN GROUPING(observed) = 1 THEN NULL WHEN observed THEN 'observed_unflagged' ELSE 'missing' END AS qc_status, count(*) AS n FROM panel GROUP BY GROUPING SETS ((variable, split, observed), ())")
def _(spark, sf_dir):
    return audit.quality_crosstab(panel.qc_fields(_ship(spark, sf_dir)))


@_add("a9_series_description", f"{SHIP} SELECT entity, variable, {r('avg(CAST(observed AS INT))', 'coverage')}, {r('stddev_samp(value)', 'std')}, {r('quantile_cont(value, 0.1)', 'q10')}, {r('quantile_cont(value, 0.9)', 'q90')} FROM panel GROUP BY ALL")
def _(spark, sf_dir):
    return audit.series_description(_ship(spark, sf_dir))


@_add("a10_annual_coverage", f"{ORDERS} SELECT entity, variable, year(ts) AS year, {r('avg(CAST(observed AS INT))', 'coverage')} FROM panel GROUP BY ALL")
def _(spark, sf_dir):
    return audit.annual_coverage(_orders(spark, sf_dir))


_SCALER = "sc AS (SELECT entity, variable, avg(value) FILTER (split = 'train') AS mean, CASE WHEN stddev_pop(value) FILTER (split = 'train') > 0 THEN stddev_pop(value) FILTER (split = 'train') ELSE 1.0 END AS std FROM panel GROUP BY ALL)"


@_add("a11_scaler", f"{SHIP}, {_SCALER} SELECT entity, variable, {r('mean')}, {r('std')} FROM sc")
def _(spark, sf_dir):
    return audit.scaler(_ship(spark, sf_dir))


@_add("a12_standardise", f"{SHIP}, {_SCALER} SELECT entity, variable, ts, {r('(value - mean) / std', 'z')} FROM panel JOIN sc USING (entity, variable)", dates="ts")
def _(spark, sf_dir):
    return audit.standardise(_ship(spark, sf_dir)).select("entity", "variable", "ts", "z")


@_add("a13_train_reference", f"{SHIP} SELECT entity, variable, {r('quantile_cont(value, 0.1)', 'q10')}, {r('quantile_cont(value, 0.9)', 'q90')}, {r('quantile_cont(value, 0.75) - quantile_cont(value, 0.25)', 'iqr')}, {r('stddev_pop(value)', 'std')} FROM panel WHERE split = 'train' AND observed GROUP BY ALL")
def _(spark, sf_dir):
    return audit.train_reference(_ship(spark, sf_dir))


@_add("a14_group_means", f"{EV} SELECT model, gap, {r('avg(mae)', 'mae')}, {r('avg(mae_clim)', 'mae_clim')}, count(*) AS size FROM ev GROUP BY ALL")
def _(spark, sf_dir):
    return audit.group_means(adapters.eval_table(spark, sf_dir), ["model", "condition", "gap"], ["mae", "mae_clim"])


@_add("a15_seed_collapse", f"{EV} SELECT model, anchor, gap, {r('avg(m)', 'mae')}, count(*) AS n_seeds FROM (SELECT model, anchor, gap, seed, avg(mae) AS m FROM ev GROUP BY ALL) GROUP BY ALL")
def _(spark, sf_dir):
    return audit.seed_collapse(adapters.eval_table(spark, sf_dir), ["model", "anchor", "gap"], "seed", "mae")


# exploration

_ANOM = """md AS (SELECT entity, variable, strftime(ts, '%m-%d') AS md, quantile_cont(value, 0.5) AS m FROM panel WHERE split = 'train' GROUP BY ALL), ma AS (SELECT entity, variable, quantile_cont(value, 0.5) AS m FROM panel WHERE split = 'train' GROUP BY ALL),
anom AS (SELECT p.*, p.value - coalesce(md.m, ma.m) AS anomaly FROM panel p LEFT JOIN md ON p.entity = md.entity AND p.variable = md.variable AND strftime(p.ts, '%m-%d') = md.md LEFT JOIN ma ON p.entity = ma.entity AND p.variable = ma.variable)"""


@_add("w1_seasonal_anomaly", f"{SHIP}, {_ANOM} SELECT entity, variable, ts, {r('anomaly')} FROM anom", dates="ts")
def _(spark, sf_dir):
    return explore.seasonal_anomaly(_ship(spark, sf_dir)).select("entity", "variable", "ts", "anomaly")


@_add("w2_mean_anomaly", f"{SHIP} SELECT entity, variable, ts, {r(f'value - avg(value) FILTER (split = $$train$$) OVER (PARTITION BY entity, variable, {_DOY})', 'anomaly')} FROM panel", dates="ts")
def _(spark, sf_dir):
    return explore.mean_anomaly(_ship(spark, sf_dir)).select("entity", "variable", "ts", "anomaly")


@_add("w3_steps", f"""{SHIP}, d AS (SELECT *, value - lag(value) OVER w AS delta, split = 'train' AND lag(split) OVER w = 'train' AS both_train FROM panel WINDOW w AS ({_W})),
q AS (SELECT entity, variable, quantile_cont(abs(delta), 0.99) AS threshold FROM d WHERE both_train GROUP BY ALL) SELECT entity, variable, ts, {r('delta')}, {r('threshold')} FROM d JOIN q USING (entity, variable) WHERE abs(delta) > threshold""", dates="ts")
def _(spark, sf_dir):
    return explore.steps(_ship(spark, sf_dir))


@_add("w4_anomaly_by_season", f"{SHIP}, {_ANOM} SELECT entity, variable, {_SEASON} AS season, count(anomaly) AS n, {r('avg(anomaly)', 'mean_anomaly')}, {r('stddev_samp(anomaly)', 'std_anomaly')} FROM anom GROUP BY ALL")
def _(spark, sf_dir):
    return explore.anomaly_by_season(_ship(spark, sf_dir))


@_add("w5_autocorrelation", f"{SHIP}, p AS (SELECT a.entity, a.variable, CAST(l AS BIGINT) AS lag, a.value AS x, b.value AS y FROM panel a, (VALUES (1), (7), (30), (90), (365)) v(l), panel b WHERE a.entity = b.entity AND a.variable = b.variable AND b.ts = a.ts + l AND a.value IS NOT NULL AND b.value IS NOT NULL) SELECT entity, variable, lag, count(*) AS n, {r(_corr('x', 'y'), 'acf')} FROM p GROUP BY ALL")
def _(spark, sf_dir):
    return explore.autocorrelation(_ship(spark, sf_dir), [1, 7, 30, 90, 365])


@_add("w8_pair_correlations", f"""{SHIP}, p AS (SELECT a.entity, a.variable, b.variable AS other, a.value AS x, b.value AS y FROM panel a JOIN panel b ON a.entity = b.entity AND a.ts = b.ts AND a.variable < b.variable WHERE a.split = 'train' AND a.value IS NOT NULL AND b.value IS NOT NULL),
k AS (SELECT *, rank() OVER (PARTITION BY entity, variable, other ORDER BY x) + (count(*) OVER (PARTITION BY entity, variable, other, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY entity, variable, other ORDER BY y) + (count(*) OVER (PARTITION BY entity, variable, other, y) - 1) / 2.0 AS ry FROM p)
SELECT entity, variable, other, count(*) AS n, {r(_corr('x', 'y'), 'pearson')}, {r(_corr('CAST(rx AS DOUBLE)', 'CAST(ry AS DOUBLE)'), 'spearman')} FROM k GROUP BY ALL""")
def _(spark, sf_dir):
    return explore.pair_correlations(_ship(spark, sf_dir))


@_add("w9_best_lags", f"""{SHIP}, t AS (SELECT entity, ts, value FROM panel WHERE variable = 'F' AND split = 'train' AND value IS NOT NULL),
p AS (SELECT a.entity AS source, b.entity AS target, CAST(l AS BIGINT) AS lag, a.value AS x, b.value AS y FROM t a, (SELECT unnest(range(-30, 31)) AS l), t b WHERE b.ts = a.ts + CAST(l AS INT) AND a.entity <> b.entity),
c AS (SELECT source, target, lag, count(*) AS n, round({_corr('x', 'y')}, 9) AS r FROM p GROUP BY ALL) SELECT source, target, lag, n, {r('r')} FROM c QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY abs(r) DESC NULLS LAST, abs(lag), lag DESC) = 1""")
def _(spark, sf_dir):
    return explore.best_lags(_ship(spark, sf_dir), "F", 30)


@_add("w12_days_since_observed", f"{ORDERS} SELECT entity, variable, ts, coalesce(datediff('day', max(ts) FILTER (observed) OVER ({_W}), ts), -1) AS days_since FROM panel", dates="ts")
def _(spark, sf_dir):
    return explore.days_since_observed(_orders(spark, sf_dir)).select("entity", "variable", "ts", "days_since")


@_add("w13_gap_distance", f"{ORDERS} SELECT entity, variable, ts, least(coalesce(datediff('day', max(ts) FILTER (observed) OVER ({_W}), ts), 5), 5) AS to_previous, least(coalesce(datediff('day', ts, min(ts) FILTER (observed) OVER (PARTITION BY entity, variable ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 5), 5) AS to_next FROM panel", dates="ts")
def _(spark, sf_dir):
    return explore.gap_distance(_orders(spark, sf_dir), 5).select("entity", "variable", "ts", "to_previous", "to_next")


_RUNS = f"runs AS (SELECT entity, variable, min(ts) AS start_date, max(ts) AS end_date, count(*) AS n_days FROM (SELECT *, ts - CAST(row_number() OVER ({_W}) AS INT) AS isle FROM panel WHERE observed) GROUP BY entity, variable, isle)"


@_add("w14_true_runs", f"{ORDERS}, {_RUNS} SELECT * FROM runs WHERE n_days >= 5", dates="start_date end_date")
def _(spark, sf_dir):
    return sqlfn.true_runs(_orders(spark, sf_dir), sqlfn.SERIES, "ts", "observed").where("n_days >= 5")


@_add("w15_merge_runs", f"""{ORDERS}, {_RUNS}, m AS (SELECT *, sum(far) OVER (PARTITION BY entity, variable ORDER BY start_date) AS g FROM (SELECT *, CASE WHEN start_date - lag(end_date) OVER (PARTITION BY entity, variable ORDER BY start_date) - 1 <= 2 THEN 0 ELSE 1 END AS far FROM runs))
SELECT entity, variable, min(start_date) AS start_date, max(end_date) AS end_date, count(*) AS n_runs, CAST(sum(n_days) AS BIGINT) AS n_days FROM m GROUP BY entity, variable, g""", dates="start_date end_date")
def _(spark, sf_dir):
    p = _orders(spark, sf_dir)
    return explore.merge_runs(sqlfn.true_runs(p, sqlfn.SERIES, "ts", "observed"), sqlfn.SERIES, 2)


_STARTS = "starts AS (SELECT entity, variable, ts FROM (SELECT *, sum(CAST(observed AS INT)) OVER (PARTITION BY entity, variable ORDER BY ts ROWS BETWEEN CURRENT ROW AND {n} FOLLOWING) AS k FROM panel) WHERE k = {n} + 1)"


@_add("w16_block_starts", f"{ORDERS}, {_STARTS.format(n=9)} SELECT * FROM starts", dates="ts")
def _(spark, sf_dir):
    return explore.block_starts(_orders(spark, sf_dir), 10)


# events, anchors and gaps

_THR = f"sp AS (SELECT *, {_SEASON} AS season FROM panel), th AS (SELECT entity, variable, season, count(*) AS n, CASE WHEN count(*) >= 30 THEN quantile_cont(value, 0.9) END AS threshold FROM sp WHERE split = 'train' AND value IS NOT NULL GROUP BY ALL)"


@_add("e2_season_thresholds", f"{SHIP}, {_THR} SELECT entity, variable, season, n, {r('threshold')} FROM th")
def _(spark, sf_dir):
    return gaps.season_thresholds(_ship(spark, sf_dir), 0.9)


@_add("e6_episodes", f"""{SHIP}, {_THR}, hot AS (SELECT sp.* FROM sp JOIN th USING (entity, variable, season) WHERE value > threshold),
runs AS (SELECT entity, variable, min(ts) AS start_date, max(ts) AS end_date, count(*) AS n_days FROM (SELECT *, ts - CAST(row_number() OVER ({_W}) AS INT) AS isle FROM hot) GROUP BY entity, variable, isle HAVING count(*) >= 2),
m AS (SELECT *, sum(far) OVER (PARTITION BY entity, variable ORDER BY start_date) AS g FROM (SELECT *, CASE WHEN start_date - lag(end_date) OVER (PARTITION BY entity, variable ORDER BY start_date) - 1 <= 3 THEN 0 ELSE 1 END AS far FROM runs)),
ep AS (SELECT entity, variable, min(start_date) AS start_date, max(end_date) AS end_date, count(*) AS n_runs, CAST(sum(n_days) AS BIGINT) AS n_days FROM m GROUP BY entity, variable, g)
SELECT ep.*, {r('max(value)', 'peak')}, first(hot.ts ORDER BY value DESC, hot.ts) AS peak_date FROM ep JOIN hot ON ep.entity = hot.entity AND ep.variable = hot.variable AND hot.ts BETWEEN start_date AND end_date GROUP BY ALL""", dates="start_date end_date peak_date")
def _(spark, sf_dir):
    return gaps.episodes(stored(_ship(spark, sf_dir), "panel"), 0.9, 2, 3)


_KEY = f"md5(concat_ws('|', '{SEED}', entity, variable, CAST(ts AS VARCHAR)))"


@_add("g1_point_gaps", f"{ORDERS} SELECT entity, variable, ts FROM panel WHERE observed QUALIFY row_number() OVER (PARTITION BY entity, variable ORDER BY {_KEY}) <= floor(count(*) OVER (PARTITION BY entity, variable) * 0.3 + 0.5)", dates="ts")
def _(spark, sf_dir):
    return gaps.point_gaps(_orders(spark, sf_dir), 0.3, SEED)


@_add("g2_nested_points", f"""{ORDERS}, a AS (SELECT *, {_SEASON} AS season, row_number() OVER (PARTITION BY entity, variable, {_SEASON} ORDER BY {_KEY}) AS i FROM panel WHERE observed),
b AS (SELECT *, row_number() OVER (PARTITION BY entity, variable ORDER BY i, season) AS k, count(*) OVER (PARTITION BY entity, variable) AS n FROM a) SELECT entity, variable, CAST(rate AS DOUBLE) AS rate, ts FROM b, (VALUES (0.1), (0.3), (0.5)) v(rate) WHERE k <= floor(n * CAST(rate AS DOUBLE) + 0.5)""", dates="ts")
def _(spark, sf_dir):
    return gaps.nested_points(_orders(spark, sf_dir), [0.1, 0.3, 0.5], SEED)


_BLOCK = f"blk AS (SELECT entity, variable, ts AS start_date, ts + 29 AS end_date FROM starts QUALIFY row_number() OVER (PARTITION BY entity, variable ORDER BY {_KEY}) = 1)"
_HIDDEN = f"{SHIP}, {_STARTS.format(n=29)}, {_BLOCK}, hid AS (SELECT p.*, b.start_date IS NOT NULL AS hidden, CASE WHEN b.start_date IS NULL THEN p.value END AS seen FROM panel p LEFT JOIN blk b ON p.entity = b.entity AND p.variable = b.variable AND p.ts BETWEEN b.start_date AND b.end_date)"


def _hidden(spark, sf_dir):
    p = stored(_ship(spark, sf_dir), "panel")
    return stored(gaps.hide(p, gaps.block_cells(gaps.block_gaps(p, 30, SEED))), "hidden")


@_add("g3_block_gaps", f"{SHIP}, {_STARTS.format(n=29)}, {_BLOCK} SELECT * FROM blk", dates="start_date end_date")
def _(spark, sf_dir):
    return gaps.block_gaps(_ship(spark, sf_dir), 30, SEED)


@_add("g5_outage_gaps", f"""{SHIP}, {_STARTS.format(n=19)}, j AS (SELECT entity, ts FROM starts GROUP BY ALL HAVING count(*) = 3)
SELECT entity, ts AS start_date, ts + 19 AS end_date FROM j QUALIFY row_number() OVER (PARTITION BY entity ORDER BY md5(concat_ws('|', '{SEED}', entity, CAST(ts AS VARCHAR)))) = 1""", dates="start_date end_date")
def _(spark, sf_dir):
    return gaps.outage_gaps(_ship(spark, sf_dir), 20, SEED)


@_add("g9_anchors", f"""{ORDERS}, {_STARTS.format(n=9)}, c AS (SELECT entity, variable, ts + 4 AS ts FROM starts), s AS (SELECT *, {_SEASON} AS season FROM c)
SELECT entity, variable, ts AS center_date, season, row_number() OVER (PARTITION BY entity, variable, season ORDER BY {_KEY}) AS anchor_no, greatest(5 - count(*) OVER (PARTITION BY entity, variable, season), 0) AS shortfall FROM s QUALIFY anchor_no <= 5""", dates="center_date")
def _(spark, sf_dir):
    return gaps.anchors(_orders(spark, sf_dir), 10, 5, SEED)


@_add("g14_mask_metadata", f"{_HIDDEN} SELECT entity, variable, count(*) FILTER (observed) AS eligible_cells, count(*) FILTER (hidden AND observed) AS masked_cells, count(*) FILTER (hidden AND NOT observed) AS outside, {r('count(*) FILTER (hidden AND observed) / nullif(count(*) FILTER (observed), 0)', 'masked_rate')} FROM hid GROUP BY ALL")
def _(spark, sf_dir):
    return gaps.mask_metadata(_hidden(spark, sf_dir))


# fillers and metrics

_CLIM = f"""near AS (SELECT entity, variable, value, (({_DOY} - 1 + o + 366) % 366) + 1 AS doy FROM panel, (SELECT unnest(range(-7, 8)) AS o) WHERE split = 'train' AND value IS NOT NULL),
cd AS (SELECT entity, variable, doy, quantile_cont(value, 0.5) AS m FROM near GROUP BY ALL), ca AS (SELECT entity, variable, quantile_cont(value, 0.5) AS m FROM panel WHERE split = 'train' GROUP BY ALL)"""


@_add("i1_climatology", f"{ORDERS}, {_CLIM} SELECT p.entity, p.variable, p.ts, {r('coalesce(cd.m, ca.m)', 'pred')} FROM panel p LEFT JOIN cd ON p.entity = cd.entity AND p.variable = cd.variable AND dayofyear(make_date(2000, month(p.ts), day(p.ts))) = cd.doy LEFT JOIN ca ON p.entity = ca.entity AND p.variable = ca.variable", dates="ts")
def _(spark, sf_dir):
    return fillers.climatology(_orders(spark, sf_dir)).select("entity", "variable", "ts", "pred")


def _line(src: str, v: str) -> str:
    return f"""ab AS (SELECT *, max(ts) FILTER ({v} IS NOT NULL) OVER ({_W}) AS ta, min(ts) FILTER ({v} IS NOT NULL) OVER (PARTITION BY entity, variable ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tb FROM {src}),
lin AS (SELECT ab.*, coalesce(ab.{v}, a.{v} + (b.{v} - a.{v}) * ((ab.ts - ab.ta) / (ab.tb - ab.ta))) AS pred FROM ab LEFT JOIN {src} a ON a.entity = ab.entity AND a.variable = ab.variable AND a.ts = ab.ta LEFT JOIN {src} b ON b.entity = ab.entity AND b.variable = ab.variable AND b.ts = ab.tb)"""


@_add("i2_linear", f"{ORDERS}, {_line('panel', 'value')} SELECT entity, variable, ts, {r('pred')} FROM lin", dates="ts")
def _(spark, sf_dir):
    return fillers.linear(_orders(spark, sf_dir)).select("entity", "variable", "ts", "pred")


@_add("i12_persistence", f"{ORDERS} SELECT entity, variable, ts, {r(f'coalesce(last_value(value IGNORE NULLS) OVER ({_W}), avg(value) FILTER (split = $$train$$) OVER (PARTITION BY entity, variable))', 'pred')} FROM panel", dates="ts")
def _(spark, sf_dir):
    return fillers.persistence(_orders(spark, sf_dir)).select("entity", "variable", "ts", "pred")


@_add("i9_rating_curve", f"""WITH {_DAYS}, t AS (SELECT entity, "L" AS x, "F" AS y FROM days WHERE ts <= DATE '1998-12-31'), u AS (SELECT t.*, x - avg(x) OVER (PARTITION BY entity) AS u, avg(x) OVER (PARTITION BY entity) AS center FROM t),
m AS (SELECT entity, any_value(center) AS center, count(*) AS n, sum(u) AS s1, sum(u*u) AS s2, sum(u*u*u) AS s3, sum(u*u*u*u) AS s4, sum(y) AS y0, sum(u*y) AS y1, sum(u*u*y) AS y2 FROM u GROUP BY entity),
d AS (SELECT *, n*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2) AS d FROM m)
SELECT entity, round(center, 4) AS center, round((y0*(s2*s4-s3*s3) - s1*(y1*s4-s3*y2) + s2*(y1*s3-s2*y2)) / d, 4) AS c0, round((n*(y1*s4-y2*s3) - y0*(s1*s4-s3*s2) + s2*(s1*y2-y1*s2)) / d, 4) AS c1, round((n*(s2*y2-s3*y1) - s1*(s1*y2-y1*s2) + y0*(s1*s3-s2*s2)) / d, 4) AS c2 FROM d""", 4)
def _(spark, sf_dir):
    return fillers.rating_curve(panel.with_split(adapters.ship_days(spark, sf_dir)), "L", "F")


_FILLED = f"{_HIDDEN}, {_line('hid', 'seen')}, sc AS (SELECT entity, variable, value AS truth, pred, pred - value AS e FROM lin WHERE hidden AND value IS NOT NULL AND pred IS NOT NULL)"


@_add("m1_metrics_of_linear_fill", f"""{_FILLED}, k AS (SELECT *, rank() OVER (PARTITION BY entity, variable ORDER BY truth) + (count(*) OVER (PARTITION BY entity, variable, truth) - 1) / 2.0 AS rt, rank() OVER (PARTITION BY entity, variable ORDER BY pred) + (count(*) OVER (PARTITION BY entity, variable, pred) - 1) / 2.0 AS rp FROM sc)
SELECT entity, variable, count(*) AS n, {r('avg(abs(e))', 'mae')}, {r('sqrt(avg(e * e))', 'rmse')}, {r('avg(e)', 'bias')}, {r(_corr('truth', 'pred', 2), 'pearson')}, {r(_corr('CAST(rt AS DOUBLE)', 'CAST(rp AS DOUBLE)', 2), 'spearman')}, {r('sqrt(avg(e * e)) / nullif(stddev_pop(truth), 0)', 'nrmse')} FROM k GROUP BY ALL""")
def _(spark, sf_dir):
    return metrics.basic(fillers.linear(_hidden(spark, sf_dir)).where("hidden"), sqlfn.SERIES)


@_add("m2_boundary_jumps", f"""{_HIDDEN}, {_line('hid', 'seen')}, j AS (SELECT entity, variable, CASE WHEN hidden AND value IS NOT NULL AND NOT lag(hidden) OVER w THEN abs(pred - lag(seen) OVER w) END AS l, CASE WHEN hidden AND value IS NOT NULL AND NOT lead(hidden) OVER w THEN abs(pred - lead(seen) OVER w) END AS r FROM lin WINDOW w AS ({_W}))
SELECT entity, variable, {r('avg(l)', 'jump_left')}, {r('avg(r)', 'jump_right')} FROM j GROUP BY ALL""")
def _(spark, sf_dir):
    return metrics.boundary_jumps(fillers.linear(_hidden(spark, sf_dir)))


@_add("m4_flow_metrics", f"{_FILLED} SELECT entity, variable, {r('1 - sum(e * e) / nullif(var_pop(truth) * count(*), 0)', 'nse')}, {r('100 * sum(e) / nullif(sum(truth), 0)', 'pbias')}, {r('avg(abs(ln(1 + greatest(pred, 0)) - ln(1 + greatest(truth, 0))))', 'log_mae')} FROM sc WHERE variable = 'F' GROUP BY ALL")
def _(spark, sf_dir):
    return metrics.flow(fillers.linear(_hidden(spark, sf_dir)).where("hidden and variable = 'F'"), sqlfn.SERIES)


@_add("m6_pinball", f"{EV} SELECT model, gap, {', '.join(r(f'avg(greatest({q} * (mae - mae_clim), ({q} - 1) * (mae - mae_clim)))', f'q{int(q * 100):02d}') for q in (0.05, 0.25, 0.5, 0.75, 0.95))} FROM ev GROUP BY ALL")
def _(spark, sf_dir):
    ev = adapters.eval_table(spark, sf_dir)
    return ev.groupBy("model", "gap").agg(*(metrics.pinball("mae", "mae_clim", q).alias(f"q{int(q * 100):02d}") for q in (0.05, 0.25, 0.5, 0.75, 0.95)))


@_add("m7_intervals", f"{EV} SELECT model, gap, count(*) AS n, {r('avg(CAST(gap BETWEEN least(mae, mae_clim) AND greatest(mae, mae_clim) AS INT))', 'coverage')}, {r('avg(greatest(mae, mae_clim) - least(mae, mae_clim))', 'width')}, {r('avg(CAST(mae > mae_clim AS INT))', 'crossing_rate')} FROM ev GROUP BY ALL")
def _(spark, sf_dir):
    return metrics.intervals(adapters.eval_table(spark, sf_dir), ["model", "gap"], "gap", "mae", "mae_clim")


@_add("m13_sen_slope", f"{ORDERS}, y AS (SELECT entity, year(ts) * 12 + month(ts) AS x, sum(value) AS y FROM obs GROUP BY ALL) SELECT a.entity, count(*) AS pairs, {r('quantile_cont((b.y - a.y) / (b.x - a.x), 0.5)', 'slope')} FROM y a JOIN y b ON a.entity = b.entity AND a.x < b.x GROUP BY ALL")
def _(spark, sf_dir):
    y = adapters.order_panel(spark, sf_dir).groupBy("entity", (F.year("ts") * 12 + F.month("ts")).alias("x")).agg(F.sum("value").alias("y"))
    return metrics.sen_slope(y, ["entity"], "x", "y")


# comparison and analysis

_PAIR = "pr AS (SELECT year, anchor, a, b, a - b AS diff FROM (SELECT year, anchor, avg(mae) FILTER (model = 'A') AS a, avg(mae) FILTER (model = 'N') AS b FROM ev GROUP BY ALL) WHERE a IS NOT NULL AND b IS NOT NULL)"


def _pairs(spark, sf_dir):
    return analysis.paired(adapters.eval_table(spark, sf_dir), ["year", "anchor"], "model", "A", "N", "mae")


@_add("b2_paired", f"{EV}, {_PAIR} SELECT year, anchor, {r('a')}, {r('b')}, {r('diff')} FROM pr")
def _(spark, sf_dir):
    return _pairs(spark, sf_dir)




@_add("b3_signed_rank", f"""{EV}, {_PAIR}, z AS (SELECT year, round(diff, 9) AS diff, abs(round(diff, 9)) AS a FROM pr WHERE round(diff, 9) <> 0), k AS (SELECT *, rank() OVER (PARTITION BY year ORDER BY a) + (count(*) OVER (PARTITION BY year, a) - 1) / 2.0 AS r FROM z),
t AS (SELECT year, sum(t * t * t - t) AS tie FROM (SELECT year, a, count(*) AS t FROM z GROUP BY ALL) GROUP BY ALL), g AS (SELECT year, count(*) AS n, CAST(coalesce(sum(r) FILTER (diff > 0), 0) AS DOUBLE) AS w_plus, CAST(coalesce(sum(r) FILTER (diff < 0), 0) AS DOUBLE) AS w_minus FROM k GROUP BY ALL)
SELECT year, n, {r('w_plus')}, {r('w_minus')}, {r('(w_plus - n * (n + 1) / 4) / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48), 0)', 'z')} FROM g JOIN t USING (year)""")
def _(spark, sf_dir):
    return analysis.signed_rank(_pairs(spark, sf_dir).withColumn("diff", F.round("diff", 9)), ["year"])


_P = "pv AS (SELECT anchor, anchor % 3 AS family, CASE WHEN anchor % 7 <> 0 THEN round(avg(mae) / 500.0, 9) END AS p FROM ev GROUP BY anchor)"


def _pvalues(spark, sf_dir):
    ev = adapters.eval_table(spark, sf_dir)
    g = ev.groupBy("anchor").agg(F.avg("mae").alias("m"))
    return g.select("anchor", (F.col("anchor") % 3).alias("family"), F.when(F.col("anchor") % 7 != 0, F.round(F.col("m") / 500.0, 9)).alias("p"))


@_add("b4_holm", f"{EV}, {_P}, s AS (SELECT *, least((count(p) OVER (PARTITION BY p IS NULL) - row_number() OVER (PARTITION BY p IS NULL ORDER BY p, anchor) + 1) * p, 1.0) AS s FROM pv) SELECT anchor, family, {r('p')}, {r('CASE WHEN p IS NOT NULL THEN max(s) OVER (PARTITION BY p IS NULL ORDER BY p, anchor ROWS UNBOUNDED PRECEDING) END', 'p_holm')} FROM s")
def _(spark, sf_dir):
    return analysis.holm(_pvalues(spark, sf_dir), "p", "anchor")


@_add("b5_benjamini_hochberg", f"{EV}, {_P}, k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, anchor) AS k, count(*) OVER (PARTITION BY family) AS m FROM pv WHERE p IS NOT NULL) SELECT anchor, family, {r('p')}, {r('least(min(p * m / k) OVER (PARTITION BY family ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 1.0)', 'q_bh')} FROM k")
def _(spark, sf_dir):
    return analysis.benjamini_hochberg(_pvalues(spark, sf_dir), "p", ["family"], "anchor")


@_add("b9_guarded_skill", f"{EV} SELECT model, anchor, gap, {r('CASE WHEN c > 0.5 THEN 1 - m / c END', 'skill')}, CASE WHEN c IS NULL THEN 'no_baseline' WHEN c <= 0.5 THEN 'withheld' ELSE 'ok' END AS skill_status FROM (SELECT model, anchor, gap, avg(mae) AS m, avg(mae_clim) AS c FROM ev GROUP BY ALL)")
def _(spark, sf_dir):
    ev = adapters.eval_table(spark, sf_dir).groupBy("model", "anchor", "gap").agg(F.avg("mae").alias("m"), F.avg("mae_clim").alias("c"))
    return analysis.guarded_skill(ev, "m", "c", 1.0).drop("m", "c")


@_add("b11_standardised_difference", f"{EV} SELECT gap, {r('(avg(mae) FILTER (model = $$A$$) - avg(mae) FILTER (model = $$N$$)) / nullif(sqrt((power(stddev_samp(mae) FILTER (model = $$A$$), 2) + power(stddev_samp(mae) FILTER (model = $$N$$), 2)) / 2), 0)', 'smd')} FROM ev GROUP BY gap")
def _(spark, sf_dir):
    return analysis.standardised_difference(adapters.eval_table(spark, sf_dir), ["gap"], "model", "A", "N", "mae")


_CURVE = "cv AS (SELECT anchor, gap, round(1 - avg(mae) / 10.0, 9) AS skill, count(*) AS n FROM ev GROUP BY ALL)"


def _curves(spark, sf_dir):
    ev = adapters.eval_table(spark, sf_dir)
    return ev.groupBy("anchor", "gap").agg(F.round(1 - F.avg("mae") / 10.0, 9).alias("skill"), F.count(F.lit(1)).alias("n"))


@_add("f2_first_loss", f"""{EV}, {_CURVE}, a AS (SELECT *, min(skill) OVER (PARTITION BY anchor ORDER BY gap) AS m FROM cv), b AS (SELECT *, lag(m) OVER (PARTITION BY anchor ORDER BY gap) AS pm, lag(gap) OVER (PARTITION BY anchor ORDER BY gap) AS pg FROM a),
f AS (SELECT anchor, first(coalesce(pg + (gap - pg) * ((pm - 0.45) / (pm - m)), 0) ORDER BY gap) AS g_at, first(pg IS NULL ORDER BY gap) AS lft FROM b WHERE m <= 0.45 GROUP BY anchor), l AS (SELECT anchor, max(gap) AS last FROM cv GROUP BY anchor)
SELECT l.anchor, {r('coalesce(g_at, last)', 'frontier')}, CASE WHEN f.anchor IS NULL THEN 'right' WHEN lft THEN 'left' ELSE 'none' END AS censoring FROM l LEFT JOIN f USING (anchor)""")
def _(spark, sf_dir):
    return analysis.first_loss(_curves(spark, sf_dir), ["anchor"], "gap", "skill", 0.45)


@_add("f4_pava", f"""{EV}, {_CURVE}, q AS (SELECT *, sum(n) OVER w AS cw, sum(n * skill) OVER w AS cs FROM cv WINDOW w AS (PARTITION BY anchor ORDER BY gap)),
m AS (SELECT i.anchor, i.gap, s.gap AS s, max((t.cs - s.cs + s.n * s.skill) / (t.cw - s.cw + s.n)) AS m FROM q i JOIN q s ON i.anchor = s.anchor AND s.gap <= i.gap JOIN q t ON i.anchor = t.anchor AND t.gap >= i.gap GROUP BY ALL)
SELECT anchor, gap, {r('any_value(skill)', 'skill')}, any_value(n) AS n, {r('min(m)', 'fit')}, dense_rank() OVER (PARTITION BY anchor ORDER BY round(min(m), 9) DESC) - 1 AS block FROM m JOIN cv USING (anchor, gap) GROUP BY anchor, gap""")
def _(spark, sf_dir):
    return analysis.pava(_curves(spark, sf_dir), ["anchor"], "gap", "skill", "n")


_COAL = "co AS (SELECT l_returnflag AS unit, CAST(l_orderkey % 16 AS BIGINT) AS mask, round(avg(l_quantity), 6) AS v FROM lineitem GROUP BY ALL)"


@_add("v2_shapley", f"""WITH {_COAL}, w(k, w) AS (VALUES (0, 0.25), (1, 1 / 12.0), (2, 1 / 12.0), (3, 0.25)), p AS (SELECT a.unit, CAST(pl AS BIGINT) AS player, bit_count(a.mask) AS k, b.v - a.v AS d FROM co a, (SELECT unnest(range(0, 4)) AS pl), co b WHERE a.unit = b.unit AND (a.mask >> CAST(pl AS INT)) & 1 = 0 AND b.mask = a.mask + (1 << CAST(pl AS INT)))
SELECT unit, player, {r('sum(CAST(w AS DOUBLE) * d)', 'shapley')}, {r('avg(d)', 'mean_marginal')} FROM p JOIN w USING (k) GROUP BY ALL""")
def _(spark, sf_dir):
    v = adapters.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("unit"), (F.col("l_orderkey") % 16).alias("mask")).agg(F.round(F.avg("l_quantity"), 6).alias("v"))
    return analysis.shapley(v, ["unit"], "mask", "v", 4)


@_add("n3_resilience_area", f"""{EV}, c AS (SELECT model, (gap - 1) / 6.0 AS f, avg(mae) AS mean FROM ev GROUP BY ALL), q AS (SELECT model, CAST(f AS DOUBLE) AS f, CASE WHEN max(mean) FILTER (f = 0) OVER (PARTITION BY model) > 0 THEN mean / max(mean) FILTER (f = 0) OVER (PARTITION BY model) END AS rel FROM c),
t AS (SELECT *, (lead(f) OVER w - f) * (lead(rel) OVER w + rel) / 2 AS a FROM q WINDOW w AS (PARTITION BY model ORDER BY f)) SELECT model, {r('CASE WHEN min(f) = 0 AND max(f) = 1 THEN sum(a) END', 'area')} FROM t GROUP BY model""")
def _(spark, sf_dir):
    ev = adapters.eval_table(spark, sf_dir).withColumn("f", (F.col("gap") - 1) / F.lit(6.0))
    return analysis.resilience(ev, ["model"], "f", "mae")


@_add("u3_pooled_calibration", f"{EV}, u AS (SELECT model, gap, count(*) AS n, avg(CAST(gap BETWEEN least(mae, mae_clim) AND greatest(mae, mae_clim) AS INT)) AS c FROM ev GROUP BY ALL) SELECT model, {r('sum(c * n) / sum(n)', 'coverage')}, {r('sum(c * n) / sum(n) - 0.9', 'calibration_error')} FROM u GROUP BY model")
def _(spark, sf_dir):
    u = metrics.intervals(adapters.eval_table(spark, sf_dir), ["model", "gap"], "gap", "mae", "mae_clim")
    c = F.sum(F.col("coverage") * F.col("n")) / F.sum("n")
    return u.groupBy("model").agg(c.alias("coverage"), (c - 0.9).alias("calibration_error"))


@_add("j8_interval_overlaps", f"""{IV} SELECT a.entity, a.interval_id, b.interval_id AS other_id, datediff('day', greatest(a.start_date, b.start_date), least(a.end_date, b.end_date)) + 1 AS overlap_days,
{r("(datediff('day', greatest(a.start_date, b.start_date), least(a.end_date, b.end_date)) + 1) / (61.0 + 1 - (datediff('day', greatest(a.start_date, b.start_date), least(a.end_date, b.end_date)) + 1))", 'jaccard')} FROM iv a JOIN iv b ON a.entity = b.entity AND a.interval_id < b.interval_id AND a.start_date <= b.end_date AND b.start_date <= a.end_date""")
def _(spark, sf_dir):
    return analysis.interval_overlaps(adapters.interval_table(spark, sf_dir))


@_add("o2_interval_clusters", f"""{IV}, c AS (SELECT *, CASE WHEN start_date <= max(end_date) OVER (PARTITION BY entity ORDER BY start_date, interval_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM iv),
g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY entity ORDER BY start_date, interval_id) AS BIGINT) AS cluster FROM c) SELECT entity, cluster, count(*) AS n_intervals, min(start_date) AS start_date, max(end_date) AS end_date FROM g GROUP BY ALL""", dates="start_date end_date")
def _(spark, sf_dir):
    return analysis.interval_clusters(adapters.interval_table(spark, sf_dir))


@_add("o3_effective_cells", f"""{IV}, c AS (SELECT entity, interval_id, unnest(range(0, 31)) AS o, start_date FROM iv), k AS (SELECT *, count(*) OVER (PARTITION BY entity, start_date + CAST(o AS INT)) AS k FROM c) SELECT entity, interval_id, count(*) AS n_days, {r('sum(1 / k)', 'effective_days')}, count(*) FILTER (k = 1) AS exclusive_days FROM k GROUP BY ALL""")
def _(spark, sf_dir):
    return analysis.effective_cells(adapters.interval_table(spark, sf_dir))


@_add("k1_rank_models", f"""{EV}, s AS (SELECT model, gap, anchor, seed, avg(mae) AS m FROM ev GROUP BY ALL), u AS (SELECT model, gap, anchor, avg(m) AS m FROM s GROUP BY ALL), t AS (SELECT model, gap, avg(m) AS m FROM u GROUP BY ALL), f AS (SELECT model, round(avg(m), 9) AS score, max(m) AS worst FROM t GROUP BY model)
SELECT model, {r('score')}, {r('worst')}, row_number() OVER (ORDER BY f.score, model) AS rank FROM f""")
def _(spark, sf_dir):
    return analysis.rank_models(adapters.eval_table(spark, sf_dir), "model", "gap", ["anchor"], "seed", "mae")


@_add("j13_missing_from_grid", f"{EV} SELECT * FROM (SELECT DISTINCT anchor FROM ev), (SELECT DISTINCT model, gap FROM ev), (SELECT DISTINCT year FROM ev) EXCEPT SELECT anchor, model, gap, year FROM ev")
def _(spark, sf_dir):
    return analysis.missing_from_grid(adapters.eval_table(spark, sf_dir), [["anchor"], ["model", "gap"], ["year"]])


@_add("k5_contract", """SELECT 'unique_key' AS "check", count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'null_l_shipdate', count(*) FILTER (l_shipdate IS NULL) FROM lineitem UNION ALL SELECT 'infinite_l_tax', count(*) FILTER (isnan(l_tax) OR isinf(l_tax)) FROM lineitem""")
def _(spark, sf_dir):
    return analysis.contract(adapters.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate"], ["l_tax"])


def _skill(hidden):
    """Skill of a linear fill over climatology on the hidden cells."""
    clim = fillers.climatology(hidden).withColumnRenamed("pred", "climatology_pred")
    return metrics.skill(fillers.linear(clim).where("hidden"), sqlfn.SERIES)


def recoverability(spark, sf_dir):
    """Complete calendar, one hidden block per series, two fills, scores, skill."""
    return _skill(_hidden(spark, sf_dir))


def recoverability_of_points(spark, sf_dir):
    """The flagship: the same with a tenth of each series' days hidden, which any series has."""
    p = stored(_ship(spark, sf_dir), "panel")
    return _skill(stored(gaps.hide(p, gaps.point_gaps(p, 0.1, SEED)), "hidden"))


_POINTS = f"""{SHIP}, pk AS (SELECT entity, variable, ts FROM panel WHERE observed QUALIFY row_number() OVER (PARTITION BY entity, variable ORDER BY {_KEY}) <= floor(count(*) OVER (PARTITION BY entity, variable) * 0.1 + 0.5)),
hid AS (SELECT p.*, k.ts IS NOT NULL AS hidden, CASE WHEN k.ts IS NULL THEN p.value END AS seen FROM panel p LEFT JOIN pk k ON p.entity = k.entity AND p.variable = k.variable AND p.ts = k.ts)"""
_SKILL = f"""{_line('hid', 'seen')}, near AS (SELECT entity, variable, seen, (({_DOY} - 1 + o + 366) % 366) + 1 AS doy FROM hid, (SELECT unnest(range(-7, 8)) AS o) WHERE split = 'train' AND seen IS NOT NULL),
cd AS (SELECT entity, variable, doy, quantile_cont(seen, 0.5) AS m FROM near GROUP BY ALL), ca AS (SELECT entity, variable, quantile_cont(seen, 0.5) AS m FROM hid WHERE split = 'train' GROUP BY ALL),
sc AS (SELECT l.entity, l.variable, l.value AS truth, l.pred, coalesce(cd.m, ca.m) AS c FROM lin l LEFT JOIN cd ON l.entity = cd.entity AND l.variable = cd.variable AND dayofyear(make_date(2000, month(l.ts), day(l.ts))) = cd.doy LEFT JOIN ca ON l.entity = ca.entity AND l.variable = ca.variable WHERE l.hidden AND l.value IS NOT NULL AND l.pred IS NOT NULL)
SELECT entity, variable, count(*) AS n, {r('avg(abs(pred - truth))', 'mae')}, {r('avg(abs(c - truth))', 'mae_clim')}, {r('1 - avg(abs(pred - truth)) / nullif(avg(abs(c - truth)), 0)', 'skill')} FROM sc WHERE c IS NOT NULL GROUP BY ALL"""
_add("recoverability", f"{_HIDDEN}, {_SKILL}")(recoverability)
_add("recoverability_of_points", f"{_POINTS}, {_SKILL}")(recoverability_of_points)
