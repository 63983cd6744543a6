"""Queries on the event catalogue and its matched controls, with their SQL twins.

The twins give each event its control one after the other, by a recursive query.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelscope.operators import catalogue
from panelscope.operators.catalogue import KINDS
from panelscope.plans.catalog import _DOY, _SEASON, SHIP, _add, _ship, r
from panelscope.sources.storage import stored


def _season(e: str) -> str:
    return _SEASON.replace("(ts)", f"({e})")


def _doy(e: str) -> str:
    return _DOY.replace("(ts)", f"({e})")


_KIND = ", ".join(f"('{k.name}', '{k.variable}', {k.least}, {k.merge}, {k.window}, {'true' if k.above else 'false'})" for k in KINDS)
_DAYS_OF = f"""{SHIP.replace('WITH', 'WITH RECURSIVE', 1)}, kinds(event_type, variable, least, gap, win, above) AS (VALUES {_KIND}),
chg AS (SELECT *, {_SEASON} AS season, CASE WHEN observed AND lag(observed) OVER w AND split = lag(split) OVER w THEN value - lag(value) OVER w END AS change FROM panel WINDOW w AS (PARTITION BY entity, variable ORDER BY ts)),
mz AS (SELECT c.entity, k.event_type, c.ts, c.value, c.observed, c.split, c.season, CASE WHEN observed THEN CASE k.event_type WHEN 'rapid_warming' THEN change ELSE value END END AS measure FROM chg c JOIN kinds k USING (variable) WHERE k.event_type <> 'high_temperature'),
tq AS (SELECT entity, event_type, season, count(*) AS tn, CASE WHEN count(*) >= 30 THEN CASE event_type WHEN 'low_flow' THEN quantile_cont(measure, 0.1) ELSE quantile_cont(measure, 0.9) END END AS threshold FROM mz WHERE split = 'train' AND measure IS NOT NULL GROUP BY entity, event_type, season),
tt AS (SELECT entity, value, {_DOY} AS d FROM panel WHERE variable = 'T' AND split = 'train' AND value IS NOT NULL), tm AS (SELECT entity, ((d - 1 + o + 366) % 366) + 1 AS doy, avg(value) AS mean FROM tt, (SELECT unnest(range(-7, 8)) AS o) GROUP BY ALL),
ta AS (SELECT entity, ((d - 1 + o + 366) % 366) + 1 AS doy, count(*) AS tn, quantile_cont(value - mean, 0.9) AS threshold FROM (SELECT tt.entity, tt.d, value, mean FROM tt JOIN tm ON tt.entity = tm.entity AND tt.d = tm.doy), (SELECT unnest(range(-15, 16)) AS o) GROUP BY ALL HAVING count(*) >= 30),
un AS (SELECT entity, event_type, ts, value, observed AND split = 'test' AS ok, measure, threshold, tn FROM mz LEFT JOIN tq USING (entity, event_type, season) UNION ALL
  SELECT p.entity, 'high_temperature', p.ts, p.value, observed AND split = 'test', CASE WHEN ta.threshold IS NOT NULL THEN p.value - tm.mean END, ta.threshold, ta.tn FROM panel p LEFT JOIN ta ON p.entity = ta.entity AND {_doy('p.ts')} = ta.doy LEFT JOIN tm ON p.entity = tm.entity AND {_doy('p.ts')} = tm.doy WHERE variable = 'T'),
dd AS MATERIALIZED (SELECT u.*, coalesce(ok AND CASE WHEN above THEN measure >= threshold ELSE measure <= threshold END, false) AS event FROM un u JOIN kinds USING (event_type))"""
_WINDOWS = f"""{_DAYS_OF}, rn AS (SELECT entity, event_type, min(ts) AS start_date, max(ts) AS end_date, count(*) AS n_days FROM (SELECT *, ts - CAST(row_number() OVER (PARTITION BY entity, event_type ORDER BY ts) AS INT) AS isle FROM dd WHERE event) JOIN kinds USING (event_type) GROUP BY entity, event_type, isle HAVING count(*) >= any_value(least)),
mg AS (SELECT *, sum(far) OVER (PARTITION BY entity, event_type ORDER BY start_date) AS g FROM (SELECT rn.*, CASE WHEN start_date - lag(end_date) OVER (PARTITION BY entity, event_type ORDER BY start_date) - 1 <= gap THEN 0 ELSE 1 END AS far FROM rn JOIN kinds USING (event_type))),
ep AS (SELECT entity, event_type, min(start_date) AS start_date, max(end_date) AS end_date, count(*) AS n_runs FROM mg GROUP BY entity, event_type, g),
ex AS (SELECT ep.*, first({{'ts': d.ts, 'v': d.value, 'm': measure, 'th': threshold, 'tn': tn}} ORDER BY CASE ep.event_type WHEN 'high_temperature' THEN measure - threshold WHEN 'low_flow' THEN -measure ELSE measure END DESC, d.ts) AS x FROM ep JOIN dd d ON d.entity = ep.entity AND d.event_type = ep.event_type AND d.ts BETWEEN start_date AND end_date WHERE d.event GROUP BY ALL),
w1 AS (SELECT entity, event_type, variable, start_date, end_date, end_date - start_date + 1 AS raw_length, n_runs, x.ts AS extreme_date, x.v AS extreme_value, CASE WHEN above THEN x.m - x.th ELSE x.th - x.m END AS intensity, x.th AS threshold, x.tn AS threshold_n, CASE WHEN win > 0 THEN x.ts - CAST(win // 2 AS INT) ELSE start_date END AS window_start, CASE WHEN win > 0 THEN win ELSE end_date - start_date + 1 END AS window_length,
  CASE WHEN win > 0 AND start_date < x.ts THEN start_date END AS rising_start, CASE WHEN win > 0 AND start_date < x.ts THEN x.ts - 1 END AS rising_end, CASE WHEN win > 0 AND x.ts < end_date THEN x.ts + 1 END AS recession_start, CASE WHEN win > 0 AND x.ts < end_date THEN end_date END AS recession_end FROM ex JOIN kinds USING (event_type)),
w2 AS (SELECT *, window_start + CAST(window_length - 1 AS INT) AS window_end, window_start + CAST((window_length - 1) // 2 AS INT) AS center FROM w1), wi AS MATERIALIZED (SELECT *, {_season('center')} AS season FROM w2)"""
_MATCHED = f"""{_WINDOWS}, tk AS (SELECT DISTINCT entity, event_type, CAST(unnest(generate_series(window_start, window_end, INTERVAL 1 DAY)) AS DATE) AS ts FROM wi),
cm AS (SELECT d.entity, d.event_type, d.ts, sum(CAST(ok AND NOT event AND tk.ts IS NULL AS INT)) OVER v AS c, sum(CAST(ok AS INT)) OVER v AS o FROM dd d LEFT JOIN tk ON tk.entity = d.entity AND tk.event_type = d.event_type AND tk.ts = d.ts WINDOW v AS (PARTITION BY d.entity, d.event_type ORDER BY d.ts)),
se AS (SELECT entity, event_type, min(ts) AS d0, count(*) AS n, list_prepend(0, list(c ORDER BY ts)) AS cc, list_prepend(0, list(o ORDER BY ts)) AS oo FROM cm GROUP BY ALL),
ca AS (SELECT w.entity, w.event_type, w.start_date, w.center, w.season, d0 + CAST(i AS INT) AS s, d0 + CAST(i + (window_length - 1) // 2 AS INT) AS sc FROM wi w JOIN se USING (entity, event_type), range(1, 20000) t(i) WHERE i + window_length + 1 <= n AND cc[i + window_length + 1] - cc[i + 1] = window_length AND oo[i + window_length + 2] - oo[i] = window_length + 2),
cl AS (SELECT entity, event_type, start_date, list(s ORDER BY abs(year(center) - year(sc)), least(abs({_doy('center')} - {_doy('sc')}), 366 - abs({_doy('center')} - {_doy('sc')})), abs(center - sc), s) AS cand FROM ca WHERE {_season('sc')} = season GROUP BY ALL),
tu AS MATERIALIZED (SELECT wi.entity, wi.event_type, window_length, season, wi.start_date, row_number() OVER (PARTITION BY wi.entity, wi.event_type, window_length, season ORDER BY wi.start_date) AS nth, cand FROM wi LEFT JOIN cl USING (entity, event_type, start_date)),
rc AS (SELECT entity, event_type, window_length, season, CAST(0 AS BIGINT) AS nth, CAST(NULL AS DATE) AS start_date, CAST(NULL AS DATE) AS pick, CAST([] AS DATE[]) AS used FROM tu GROUP BY ALL UNION ALL
  SELECT entity, event_type, window_length, season, nth, start_date, pick, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END FROM (SELECT rc.entity, rc.event_type, rc.window_length, rc.season, tu.nth, tu.start_date, list_filter(tu.cand, lambda s: NOT list_contains(rc.used, s))[1] AS pick, rc.used FROM rc JOIN tu ON tu.entity = rc.entity AND tu.event_type = rc.event_type AND tu.window_length = rc.window_length AND tu.season = rc.season AND tu.nth = rc.nth + 1)),
mt AS (SELECT entity, event_type, start_date, pick AS control_start FROM rc WHERE pick IS NOT NULL)"""
_ID = "substr(sha256(concat_ws('|', {})), 1, 16)"
_TEXT = "entity, event_type, CAST(start_date AS VARCHAR), CAST(end_date AS VARCHAR), CAST(window_start AS VARCHAR), CAST(window_end AS VARCHAR)"
_CATALOGUE = f"""{_MATCHED}, cx AS (SELECT w.entity, w.event_type, w.start_date, count(*) FILTER (ok AND ts BETWEEN window_start AND window_end) = any_value(window_length) AS window_ok, coalesce(bool_or(ok) FILTER (ts = window_start - 1), false) AS left_ok, coalesce(bool_or(ok) FILTER (ts = window_end + 1), false) AS right_ok FROM wi w JOIN dd d ON d.entity = w.entity AND d.event_type = w.event_type AND d.ts BETWEEN window_start - 1 AND window_end + 1 GROUP BY w.entity, w.event_type, w.start_date),
al AS (SELECT wi.* REPLACE ({r('extreme_value')}, {r('intensity')}, {r('threshold')}), window_ok, left_ok, right_ok, concat_ws(';', CASE WHEN NOT window_ok THEN 'event_window_not_fully_eligible' END, CASE WHEN NOT left_ok THEN 'missing_left_context' END, CASE WHEN NOT right_ok THEN 'missing_right_context' END) AS reasons, window_ok AND left_ok AND right_ok AS eligible, control_start, control_start + CAST(window_length - 1 AS INT) AS control_end, 'event-' || {_ID.format(_TEXT)} AS event_id
  FROM wi JOIN cx USING (entity, event_type, start_date) LEFT JOIN mt USING (entity, event_type, start_date)), ct AS (SELECT *, CASE WHEN control_start IS NOT NULL THEN 'pair-' || {_ID.format('event_id, CAST(control_start AS VARCHAR), CAST(control_end AS VARCHAR)')} END AS pair_id FROM al)"""
_DATES = "start_date end_date extreme_date window_start window_end center rising_start rising_end recession_start recession_end control_start control_end"


def _made(spark, sf_dir):
    return catalogue.event_catalogue(stored(_ship(spark, sf_dir), "panel"), KINDS, "test")


@_add("e5_event_days", f"{_DAYS_OF} SELECT entity, event_type, count(*) AS days, count(*) FILTER (ok) AS ok_days, count(*) FILTER (event) AS event_days, count(measure) FILTER (ok) AS measured, round(avg(measure) FILTER (event) + 1e-10, 3) + 0.0 AS mean_measure, round(avg(threshold) + 1e-10, 3) + 0.0 AS mean_threshold FROM dd GROUP BY ALL", 3)
def _(spark, sf_dir):
    d = catalogue.day_conditions(stored(_ship(spark, sf_dir), "panel"), KINDS, "test")
    return d.groupBy("entity", "event_type").agg(
        F.count(F.lit(1)).alias("days"), F.count_if("ok").alias("ok_days"), F.count_if("event").alias("event_days"), F.count_if(F.col("ok") & F.col("measure").isNotNull()).alias("measured"), F.avg(F.when(F.col("event"), F.col("measure"))).alias("mean_measure"), F.avg("threshold").alias("mean_threshold")
    )


@_add("j7_matched_controls", f"{_MATCHED} SELECT entity, event_type, window_length, season, start_date, control_start FROM mt JOIN wi USING (entity, event_type, start_date)", dates="start_date control_start")
def _(spark, sf_dir):
    days = stored(catalogue.day_conditions(stored(_ship(spark, sf_dir), "panel"), KINDS, "test"), "days")
    found = stored(catalogue.windows(days, KINDS), "windows")
    return catalogue.matched_in_turn(catalogue.control_candidates(days, found, 1), ["entity", "event_type", "window_length", "season"], "start_date", "control_start")


@_add("e8_event_catalogue", f"{_CATALOGUE} SELECT * FROM ct", dates=_DATES)
def _(spark, sf_dir):
    return _made(spark, sf_dir)


#: What an audit is to find: some rows gone, some twice, some controls moved by a day.
_SPOILT = "SELECT * REPLACE (control_start + 1 AS control_start, control_end + 1 AS control_end) FROM ct WHERE day(start_date) % 5 = 0 AND day(start_date) <> 10 UNION ALL SELECT * FROM ct WHERE day(start_date) % 5 <> 0 UNION ALL SELECT * FROM ct WHERE day(start_date) = 7"


@_add("e9_catalogue_audit", f"""{_CATALOGUE}, sp AS MATERIALIZED ({_SPOILT}), sc AS (SELECT * FROM sp WHERE control_start IS NOT NULL)
SELECT 'only_stored' AS "check", (SELECT count(*) FROM (SELECT * FROM sp EXCEPT ALL SELECT * FROM ct)) AS "rows" UNION ALL SELECT 'only_regenerated', (SELECT count(*) FROM (SELECT * FROM ct EXCEPT ALL SELECT * FROM sp)) UNION ALL SELECT 'repeated_event', (SELECT count(*) FROM (SELECT 1 FROM sp GROUP BY event_id HAVING count(*) > 1)) UNION ALL
SELECT 'shared_control', (SELECT count(*) FROM (SELECT 1 FROM sc GROUP BY entity, event_type, control_start, control_end HAVING count(*) > 1)) UNION ALL SELECT 'other_season', (SELECT count(*) FROM sc WHERE {_season('(control_start + CAST((window_length - 1) // 2 AS INT))')} <> season) UNION ALL SELECT 'other_length', (SELECT count(*) FROM sc WHERE control_end - control_start + 1 <> window_length) UNION ALL
SELECT 'control_meets_event', (SELECT count(*) FROM (SELECT DISTINCT a.entity, a.event_type, a.start_date FROM sc a JOIN sp b ON a.entity = b.entity AND a.event_type = b.event_type AND a.control_start <= b.window_end AND a.control_end >= b.window_start))""")
def _(spark, sf_dir):
    p = stored(_ship(spark, sf_dir), "panel")
    made = stored(catalogue.event_catalogue(p, KINDS, "test"), "catalogue")
    day = F.dayofmonth("start_date")
    moved = made.where((day % 5 == 0) & (day != 10)).withColumns({c: F.date_add(c, 1) for c in ("control_start", "control_end")})
    spoilt = moved.unionByName(made.where(day % 5 != 0)).unionByName(made.where(day == 7))
    return catalogue.audit_catalogue(spoilt, p, KINDS, "test")


def _stored_catalogue(spark, sf_dir):
    return stored(_made(spark, sf_dir), "catalogue")


def _islands(keys: str, out: str) -> str:
    """CTE ``out`` (event_id, c): overlap groups by a running maximum of the ends."""
    part = f"PARTITION BY {keys} " if keys else ""
    name = " || '|' || ".join([*(k.strip() for k in keys.split(",") if k), "CAST(min(window_start) OVER (PARTITION BY {g}) AS VARCHAR)"]).replace("{g}", ", ".join(x for x in (keys, "g") if x))
    return f"{out}0 AS (SELECT *, sum(CASE WHEN window_start <= e THEN 0 ELSE 1 END) OVER ({part}ORDER BY window_start, window_end, event_id) AS g FROM (SELECT *, max(window_end) OVER ({part}ORDER BY window_start, window_end, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 AS e FROM ct)), {out} AS (SELECT event_id, {name} AS c FROM {out}0)"


_GROUPS = f"{_CATALOGUE}, {_islands('', 'ga')}, {_islands('entity', 'ge')}, {_islands('entity, event_type', 'gk')}, cg AS MATERIALIZED (SELECT ct.*, ga.c AS cluster, ge.c AS entity_cluster, gk.c AS kind_cluster FROM ct JOIN ga USING (event_id) JOIN ge USING (event_id) JOIN gk USING (event_id))"


@_add("o7_event_clusters", f"{_GROUPS} SELECT event_id, cluster, count(*) OVER (PARTITION BY cluster) AS cluster_size, entity_cluster, count(*) OVER (PARTITION BY entity_cluster) AS entity_cluster_size, kind_cluster, count(*) OVER (PARTITION BY kind_cluster) AS kind_cluster_size FROM cg")
def _(spark, sf_dir):
    c = catalogue.with_clusters(_stored_catalogue(spark, sf_dir))
    return c.select("event_id", *(f"{g}{s}" for g in ("cluster", "entity_cluster", "kind_cluster") for s in ("", "_size")))


@_add("o7_overlap_graph", f"""{_CATALOGUE}, gr AS (SELECT a.event_id AS left_id, b.event_id AS right_id, least(a.window_end, b.window_end) - greatest(a.window_start, b.window_start) + 1 AS overlap_days, a.window_length + b.window_length AS both_days, CASE WHEN a.entity <> b.entity THEN 'cross_station' WHEN a.event_type <> b.event_type THEN 'cross_type' WHEN a.event_type = 'flood' THEN 'same_type_flood' ELSE 'same_type' END AS overlap_class FROM ct a JOIN ct b ON a.event_id < b.event_id AND a.window_start <= b.window_end AND b.window_start <= a.window_end)
SELECT left_id, right_id, overlap_days, {r('overlap_days / (both_days - overlap_days)', 'jaccard')}, overlap_class FROM gr""")
def _(spark, sf_dir):
    return catalogue.overlap_graph(_stored_catalogue(spark, sf_dir))


@_add("o7_effective_sizes", f"""{_GROUPS}, dy AS (SELECT entity, event_type, CAST(unnest(generate_series(window_start, window_end, INTERVAL 1 DAY)) AS DATE) AS d FROM ct), sz AS (SELECT 0 AS scope, NULL::VARCHAR AS entity, NULL::VARCHAR AS event_type, cluster AS c FROM cg UNION ALL SELECT 1, entity, NULL, entity_cluster FROM cg UNION ALL SELECT 2, entity, event_type, kind_cluster FROM cg),
sn AS (SELECT scope, entity, event_type, c, count(*) AS k FROM sz GROUP BY ALL), dn AS (SELECT 0 AS scope, NULL::VARCHAR AS entity, NULL::VARCHAR AS event_type, count(DISTINCT d) AS days FROM dy UNION ALL SELECT 1, entity, NULL, count(DISTINCT d) FROM dy GROUP BY entity UNION ALL SELECT 2, entity, event_type, count(DISTINCT d) FROM dy GROUP BY entity, event_type)
SELECT CAST(s.scope AS BIGINT) AS scope, s.entity, s.event_type, CAST(sum(k) AS BIGINT) AS episodes, count(*) AS effective_n, count(*) FILTER (k > 1) AS several, max(k) AS largest, any_value(days) AS days FROM sn s JOIN dn ON s.scope = dn.scope AND s.entity IS NOT DISTINCT FROM dn.entity AND s.event_type IS NOT DISTINCT FROM dn.event_type GROUP BY s.scope, s.entity, s.event_type""")
def _(spark, sf_dir):
    return catalogue.effective_sizes(stored(catalogue.with_clusters(_stored_catalogue(spark, sf_dir)), "clustered"))


@_add("o7_matching_balance", f"""{_CATALOGUE}, cb AS (SELECT *, control_start + CAST((window_length - 1) // 2 AS INT) AS cc FROM ct), cd AS (SELECT cb.*, abs(year(center) - year(cc)) AS yd, least(abs({_doy('center')} - {_doy('cc')}), 366 - abs({_doy('center')} - {_doy('cc')})) AS dd, control_start = window_end + 1 OR control_end = window_start - 1 AS ab FROM cb),
wm AS (SELECT c.event_id, avg(p.value) FILTER (p.ts BETWEEN window_start AND window_end) AS e, avg(p.value) FILTER (p.ts BETWEEN control_start AND control_end) AS k FROM ct c JOIN panel p ON p.entity = c.entity AND p.variable = c.variable AND (p.ts BETWEEN window_start AND window_end OR p.ts BETWEEN control_start AND control_end) WHERE control_start IS NOT NULL AND p.value IS NOT NULL GROUP BY c.event_id),
ce AS (SELECT cd.*, CASE WHEN e IS NOT NULL AND k IS NOT NULL THEN e END AS e, CASE WHEN e IS NOT NULL AND k IS NOT NULL THEN k END AS k FROM cd LEFT JOIN wm USING (event_id))
SELECT CASE WHEN grouping(window_length) = 0 THEN 2 WHEN grouping(entity) = 0 THEN 1 ELSE 0 END::BIGINT AS grain, entity, event_type, season, window_length, count(DISTINCT event_id) AS n_events, count(DISTINCT pair_id) AS n_controls, count(*) AS n_pairs, count(*) FILTER (eligible) AS n_eligible, {r('avg(yd)', 'mean_year_distance')}, {r('avg(dd)', 'mean_day_distance')}, max(dd) AS max_day_distance, count(*) FILTER (ab) AS abutting,
{r('CASE WHEN count(e) >= 2 AND var_samp(e) + var_samp(k) > 0 THEN (avg(e) - avg(k)) / sqrt((var_samp(e) + var_samp(k)) / 2) END', 'smd')}, count(DISTINCT event_id) = count(*) AND count(DISTINCT pair_id) = count(*) AS matched_one_to_one, CASE WHEN count(*) FILTER (eligible) < 5 THEN 'descriptive_only' ELSE 'testable' END AS status FROM ce GROUP BY GROUPING SETS ((), (entity, event_type, season), (entity, event_type, season, window_length))""")
def _(spark, sf_dir):
    p = stored(_ship(spark, sf_dir), "panel")
    return catalogue.matching_balance(stored(catalogue.event_catalogue(p, KINDS, "test"), "catalogue"), p)


@_add("o7_strata", f"""{_CATALOGUE}, gd AS (SELECT entity, event_type, season FROM (SELECT DISTINCT entity FROM ct), (SELECT event_type FROM kinds), (SELECT unnest(['DJF', 'MAM', 'JJA', 'SON']) AS season)), nn AS (SELECT entity, event_type, season, count(*) AS n, count(*) FILTER (eligible) AS e FROM ct GROUP BY ALL)
SELECT entity, event_type, season, coalesce(n, 0) AS n_pairs, coalesce(e, 0) AS n_eligible, CASE WHEN n IS NULL THEN 'missing' WHEN e < 5 THEN 'descriptive_only' ELSE 'testable' END AS status FROM gd LEFT JOIN nn USING (entity, event_type, season)""")
def _(spark, sf_dir):
    return catalogue.strata_coverage(_stored_catalogue(spark, sf_dir), KINDS)
