"""Queries on pairings, resampled clusters, null models, anchors of two versions and stored tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelscope.functions.sqlfn import season
from panelscope.operators import fillers, gaps, joins, metrics, panel, results
from panelscope.plans.catalog import _CLIM, _FLAGGED, _HIDDEN, _KEY, _SEASON, _STARTS, _W, EV, ORDERS, SEED, SHIP, SQL, _add, _flagged, _hidden, _line, _orders, _ship, r
from panelscope.plans.results import _BIN, _bins
from panelscope.sources import adapters, storage


def _ev(spark, sf_dir):
    return adapters.eval_table(spark, sf_dir)


# joins


@_add("j2_paired_results", f"{EV}, s AS (SELECT model, anchor, year, avg(mae) AS m FROM ev GROUP BY ALL) SELECT a.anchor, a.year, {r('a.m', 'a')}, {r('b.m', 'b')}, {r('a.m - b.m', 'diff')} FROM s a JOIN s b ON a.anchor = b.anchor AND a.year = b.year AND a.model = 'A' AND b.model = 'R'")
def _(spark, sf_dir):
    e = _ev(spark, sf_dir)
    return joins.paired_results(e.where("model = 'A'"), e.where("model = 'R'"), ["anchor", "year"], "mae")


@_add("j6_window_counts", f"{ORDERS}, t AS (SELECT entity, variable, dayofyear(make_date(2000, month(ts), day(ts))) AS d FROM panel WHERE split = 'train' AND value IS NOT NULL) SELECT entity, variable, x AS doy, count(*) AS n FROM t, (SELECT unnest(range(1, 367)) AS x) WHERE least(abs(d - x), 366 - abs(d - x)) <= 7 GROUP BY ALL")
def _(spark, sf_dir):
    return joins.window_counts(_orders(spark, sf_dir), 7)


@_add("j9_lagged_pairs", f"{SHIP}, s AS (SELECT * FROM obs WHERE variable = 'F'), t AS (SELECT * FROM obs WHERE variable = 'T') SELECT s.entity, lag, count(*) AS n, {r('avg(t.value)', 'mean_target')} FROM s JOIN (SELECT CAST(unnest([-7, -1, 0, 1, 7]) AS BIGINT) AS lag) ON true JOIN t ON s.entity = t.entity AND t.ts = s.ts + CAST(lag AS INT) GROUP BY ALL", digits=6)
def _(spark, sf_dir):
    o = adapters.ship_panel(spark, sf_dir)
    p = joins.lagged_pairs(o.where("variable = 'F'"), o.where("variable = 'T'"), ["entity"], [-7, -1, 0, 1, 7])
    return p.groupBy("entity", F.col("lag").cast("long").alias("lag")).agg(F.count(F.lit(1)).alias("n"), F.avg("target").alias("mean_target"))


@_add("j10_days_in_episodes", f"WITH ep AS ({SQL['e6_episodes']}), p AS (SELECT * FROM ({SHIP} SELECT * FROM panel)) SELECT e.entity, e.variable, e.start_date, count(*) AS days, count(*) FILTER (observed) AS observed_days FROM ep e JOIN p ON e.entity = p.entity AND e.variable = p.variable AND p.ts BETWEEN CAST(start_date AS DATE) AND CAST(end_date AS DATE) GROUP BY ALL")
def _(spark, sf_dir):
    p = storage.stored(_ship(spark, sf_dir), "panel")
    d = joins.days_inside(gaps.episodes(p, 0.9, 2, 3).select("entity", "variable", "start_date", "end_date"), p, ["entity", "variable"])
    return d.groupBy("entity", "variable", "start_date").agg(F.count(F.lit(1)).alias("days"), F.count_if("observed").alias("observed_days"))


@_add("w7_spearman", f"""{SHIP}, k AS (SELECT entity, rank() OVER (PARTITION BY entity ORDER BY "T") + (count(*) OVER (PARTITION BY entity, "T") - 1) / 2.0 AS x, rank() OVER (PARTITION BY entity ORDER BY "F") + (count(*) OVER (PARTITION BY entity, "F") - 1) / 2.0 AS y FROM days) SELECT entity, count(*) AS n, {r('CASE WHEN count(*) >= 3 THEN covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) END', 'spearman')} FROM k GROUP BY entity""")
def _(spark, sf_dir):
    return joins.rank_correlation(adapters.ship_days(spark, sf_dir), ["entity"], "T", "F")


# keys, filters and views of a panel


@_add("p9_version_features", f"{_FLAGGED}, v AS (SELECT 'published' AS data_version, * FROM flagged UNION ALL SELECT 'exclude', * REPLACE (CASE WHEN code IS NULL THEN value END AS value) FROM flagged) SELECT data_version, entity, variable, count(value) AS n_values, count(value) FILTER (split = 'train') AS n_train FROM v GROUP BY ALL HAVING count(value) FILTER (split = 'train') > 0")
def _(spark, sf_dir):
    f = storage.stored(_flagged(spark, sf_dir), "flagged")
    v = None
    for name in ("published", "exclude"):
        one = panel.version_values(f, name).withColumn("data_version", F.lit(name))
        v = one if v is None else v.unionByName(one)
    return v.groupBy("data_version", "entity", "variable").agg(F.count("value").alias("n_values"), F.count(F.when(F.col("split") == "train", F.col("value"))).alias("n_train")).where("n_train > 0")


@_add("p15_seasons", f"SELECT {_SEASON.replace('ts', 'l_shipdate')} AS season, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, sf_dir):
    return adapters.table(spark, sf_dir, "lineitem").groupBy(season("l_shipdate").alias("season")).agg(F.count(F.lit(1)).alias("n"))


_LIN = f"{_HIDDEN}, {_line('hid', 'seen')}"


@_add("p16_evaluated_cells", f"{_LIN} SELECT entity, variable, ts, {r('value', 'truth')}, {r('pred')} FROM lin WHERE observed AND hidden AND value IS NOT NULL AND pred IS NOT NULL", dates="ts")
def _(spark, sf_dir):
    return joins.evaluated(fillers.linear(_hidden(spark, sf_dir)), F.col("observed")).select("entity", "variable", "ts", "truth", "pred")


@_add("p17_hidden_cells", f"{_HIDDEN} SELECT entity, variable, split, count(*) FILTER (hidden) AS hidden, count(seen) AS left_values, count(value) AS truths FROM hid GROUP BY ALL")
def _(spark, sf_dir):
    return _hidden(spark, sf_dir).groupBy("entity", "variable", "split").agg(F.count_if("hidden").alias("hidden"), F.count("value").alias("left_values"), F.count("truth").alias("truths"))


@_add("p18_approved_values", f"{_FLAGGED} SELECT entity, variable, ts, CASE WHEN code IS NULL THEN {r('value', 'x').replace(' AS x', '')} END AS approved FROM flagged", dates="ts")
def _(spark, sf_dir):
    return _flagged(spark, sf_dir).select("entity", "variable", "ts", F.when(~F.col("known_issue_flag"), F.col("value")).alias("approved"))


@_add("p20_condition_families", f"{EV} SELECT concat_ws('|', model, coalesce(CAST(nullif(gap, 7) AS VARCHAR), 'default'), CAST(year AS VARCHAR)) AS family, count(*) AS n FROM ev GROUP BY ALL")
def _(spark, sf_dir):
    e = _ev(spark, sf_dir).withColumn("gap", F.nullif("gap", F.lit(7)))
    return e.groupBy(results.family_key("model", "gap", "year").alias("family")).agg(F.count(F.lit(1)).alias("n"))


@_add("p24_failure_classes", "WITH s AS (SELECT l_orderkey, count(DISTINCT l_returnflag) AS k FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL) SELECT CAST(k AS BIGINT) AS failures, round(k / 3.0 + 1e-10, 6) + 0.0 AS fraction, CASE k WHEN 3 THEN 'full' WHEN 1 THEN 'single' WHEN 2 THEN 'double' END AS class, count(*) AS n FROM s GROUP BY ALL")
def _(spark, sf_dir):
    # an order has seven items at most
    s = adapters.table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("sites"))
    k = F.size("sites").cast("long")
    return s.groupBy(k.alias("failures"), (k / F.lit(3.0)).alias("fraction"), results.failure_class("sites", 3).alias("class")).agg(F.count(F.lit(1)).alias("n"))


# stored tables


@_add("s8_eligibility_grid", f"{ORDERS} SELECT ts, min(split) AS split, count(DISTINCT split) AS n_splits, count(*) FILTER (observed) AS eligible, count(*) AS cells FROM panel GROUP BY ts", dates="ts")
def _(spark, sf_dir):
    g = _orders(spark, sf_dir).groupBy("ts")
    return g.agg(F.min("split").alias("split"), F.countDistinct("split").alias("n_splits"), F.count_if("observed").alias("eligible"), F.count(F.lit(1)).alias("cells"))


@_add("s10_date_value_payloads", f"{ORDERS} SELECT entity, ts, CASE WHEN value <> 3 THEN {r('value', 'x').replace(' AS x', '')} END AS value FROM obs", dates="ts")
def _(spark, sf_dir):
    o = adapters.order_panel(spark, sf_dir).withColumn("k", F.date_format("ts", "yyyyMMdd"))
    days = F.map_from_entries(F.collect_list(F.struct("k", "value")))  # a payload holds a year of one series
    body = F.to_json(F.struct(F.struct(F.create_map(F.lit("N"), days).alias("parameter")).alias("properties")))
    payloads = o.groupBy("entity", F.year("ts").alias("year")).agg(body.alias("body"))
    return storage.parse_date_value_json(payloads, "body", "N", 3.0, "entity")


@_add("s12_prepared_outputs", f"{SHIP} SELECT entity, variable, split, count(*) AS n_rows, count(value) AS n_values FROM panel GROUP BY ALL")
def _(spark, sf_dir):
    path = storage.scratch(spark, "prepared")
    storage.write_versioned(_ship(spark, sf_dir).withColumn("data_version", F.lit("published")), path, "data_version", "split")
    return spark.read.parquet(path).where("data_version = 'published'").groupBy("entity", "variable", "split").agg(F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_values"))


@_add("s14_upsert", "SELECT o_custkey AS unit, CAST(year(o_orderdate) AS BIGINT) AS year, CASE WHEN max(o_orderkey) % 3 = 0 THEN 2 ELSE 1 END AS run, count(*) AS n FROM orders GROUP BY ALL")
def _(spark, sf_dir):
    g = adapters.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("unit"), F.year("o_orderdate").cast("long").alias("year"))
    first = storage.stored(g.agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("k")), "results")
    again = first.where("k % 3 = 0").withColumn("run", F.lit(2))
    return storage.upsert(first.withColumn("run", F.lit(1)), again, ["unit", "year"], "run").select("unit", "year", "run", "n")


@_add("s16_hidden_cell_catalogue", f"{_HIDDEN} SELECT entity, variable, ts FROM hid WHERE hidden", dates="ts")
def _(spark, sf_dir):
    p = storage.stored(_ship(spark, sf_dir), "panel")
    return storage.stored(gaps.block_cells(gaps.block_gaps(p, 30, SEED)), "hidden-cells")


# resampling and fits


_MOMENTS = ", ".join(f"{e} AS {k}" for k, e in joins.HINGE_MOMENTS.items())


@_add("f9_one_hinge", f"""{EV}, p AS (SELECT model, year, CAST(gap AS DOUBLE) AS x, avg(mae) AS y, CAST(count(*) AS DOUBLE) AS w FROM ev GROUP BY ALL), b AS (SELECT model, year, x AS bend FROM p QUALIFY row_number() OVER (PARTITION BY model, year ORDER BY x) >= 2 AND row_number() OVER (PARTITION BY model, year ORDER BY x) < count(*) OVER (PARTITION BY model, year)), m AS (SELECT p.*, bend, greatest(x - bend, 0) AS h FROM p JOIN b USING (model, year)),
g AS (SELECT model, year, bend, sum(w) AS s, sum(w*x) AS sx, sum(w*h) AS sh, sum(w*x*x) AS xx, sum(w*x*h) AS xh, sum(w*h*h) AS hh, sum(w*y) AS sy, sum(w*x*y) AS xy, sum(w*h*y) AS hy, sum(w*y*y) AS yy FROM m GROUP BY ALL), n AS (SELECT model, year, bend, {_MOMENTS} FROM g),
d AS (SELECT *, (p * b - q * c) / nullif(a * b - c * c, 0) AS slope, (q * a - p * c) / nullif(a * b - c * c, 0) AS change FROM n) SELECT model, year, bend, {r('slope')}, {r('change')}, {r('sse')} FROM (SELECT *, round(greatest(t - slope * p - change * q, 0), 9) AS sse FROM d WHERE slope IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY model, year ORDER BY sse, bend) = 1""")
def _(spark, sf_dir):
    c = _ev(spark, sf_dir).groupBy("model", "year", "gap").agg(F.avg("mae").alias("y"), F.count(F.lit(1)).alias("w"))
    return joins.one_hinge(c, ["model", "year"], "gap", "y", "w")


# null models


@_add("x4_permuted_donors", f"{ORDERS}, k AS (SELECT entity, md5(concat_ws('|', '{SEED}', entity)) AS h FROM (SELECT DISTINCT entity FROM obs)), d AS (SELECT entity, coalesce(lead(entity) OVER (ORDER BY h), first_value(entity) OVER (ORDER BY h)) AS donor FROM k) SELECT a.entity, a.donor, o.ts, o.value, p.value AS donor_value FROM obs o JOIN d a USING (entity) LEFT JOIN obs p ON p.entity = a.donor AND p.ts = o.ts", dates="ts")
def _(spark, sf_dir):
    o = adapters.order_panel(spark, sf_dir)
    given = o.select(F.col("entity").alias("donor"), "ts", F.col("value").alias("donor_value"))
    return joins.permuted_donors(o, "entity", SEED).join(given, ["donor", "ts"], "left").select("entity", "donor", "ts", "value", "donor_value")


@_add("v10_shift_null", f"""{ORDERS}, {_BIN}, i AS (SELECT entity, ts, bin, CAST(dayofweek(ts) AS BIGINT) + 1 AS x, row_number() OVER (PARTITION BY entity ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY entity) AS n FROM m), a AS (SELECT *, CASE WHEN draw = 0 THEN 0 ELSE 1 + CAST(('0x' || substr(md5(concat_ws('|', '{SEED}', entity, CAST(draw AS VARCHAR))), 1, 8)) AS BIGINT) % greatest(n - 1, 1) END AS shift FROM i, (SELECT unnest(range(0, 200)) AS draw)),
j AS (SELECT a.entity, a.draw, a.ts, a.bin, b.x FROM a JOIN a b ON a.entity = b.entity AND a.draw = b.draw AND a.i = (b.i + b.shift) % b.n), t AS (SELECT entity, draw, bin AS y, lag(bin) OVER w AS p, lag(x, 2) OVER w AS s FROM j WINDOW w AS (PARTITION BY entity, draw ORDER BY ts)), c AS (SELECT entity, draw, y, p, s, count(*) AS n FROM t WHERE p IS NOT NULL AND s IS NOT NULL GROUP BY ALL),
q AS (SELECT *, sum(n) OVER (PARTITION BY entity, draw, p, s) AS ps, sum(n) OVER (PARTITION BY entity, draw, y, p) AS yp, sum(n) OVER (PARTITION BY entity, draw, p) AS pp, sum(n) OVER (PARTITION BY entity, draw) AS total FROM c), e AS (SELECT entity, draw, round(greatest(sum(n / total * ln(n * pp / (ps * yp))), 0), 9) AS te FROM q GROUP BY ALL), o AS (SELECT *, max(te) FILTER (draw = 0) OVER (PARTITION BY entity) AS own FROM e)
SELECT entity, {r('first(own)', 'te')}, {r('avg(te)', 'null_mean')}, count(*) FILTER (te >= own) AS at_least, {r('CASE WHEN stddev_pop(te) > 1e-12 THEN (first(own) - avg(te)) / stddev_pop(te) END', 'z')}, {r('stddev_pop(te)', 'null_std')}, {r('(1 + count(*) FILTER (te >= own)) / 200', 'p_value')} FROM o WHERE draw > 0 GROUP BY entity""")
def _(spark, sf_dir):
    b = _bins(spark, sf_dir).withColumn("dow", F.dayofweek("ts"))
    return joins.shift_null(b, ["entity"], "dow", "bin", "ts", 2, 199, SEED)


# anchors and events

_ANCHORS = f"c AS (SELECT entity, variable, ts + 4 AS ts FROM starts), sn AS (SELECT *, {_SEASON} AS season FROM c), an AS (SELECT entity, variable, ts AS center_date FROM sn QUALIFY row_number() OVER (PARTITION BY entity, variable, season ORDER BY {_KEY}) <= 5)"
_CELLS = f"{_FLAGGED}, {_STARTS.format(n=9)}, {_ANCHORS}, ce AS (SELECT a.entity, a.variable, center_date, f.value AS v1, CASE WHEN code IS NULL THEN f.value END AS v2 FROM an a JOIN flagged f ON a.entity = f.entity AND a.variable = f.variable AND f.ts BETWEEN center_date - 4 AND center_date + 5)"


def _anchors(spark, sf_dir):
    f = storage.stored(_flagged(spark, sf_dir), "flagged")
    return f, storage.stored(gaps.anchors(f, 10, 5, SEED), "anchors")


@_add("g12_anchor_availability", f"{_CELLS} SELECT entity, variable, center_date, count(v2) AS present, CAST(10 AS BIGINT) AS required, count(v2) = 10 AS available FROM ce GROUP BY ALL", dates="center_date")
def _(spark, sf_dir):
    f, a = _anchors(spark, sf_dir)
    return joins.anchor_availability(a, panel.version_values(f, "exclude"), 10)


@_add("g13_anchor_bridge", f"{_CELLS} SELECT entity, variable, center_date, count(*) FILTER (v1 IS DISTINCT FROM v2) AS changed, count(*) FILTER (v1 IS DISTINCT FROM v2) = 0 AS equivalent FROM ce GROUP BY ALL", dates="center_date")
def _(spark, sf_dir):
    f, a = _anchors(spark, sf_dir)
    return joins.anchor_bridge(a, f, panel.version_values(f, "exclude"), 10)


@_add("o6_anchor_independence", f"""{SHIP}, {_STARTS.format(n=9)}, {_ANCHORS}, o AS (SELECT *, coalesce(center_date - lag(center_date) OVER w < 10, false) OR coalesce(lead(center_date) OVER w - center_date < 10, false) AS o FROM an WINDOW w AS (PARTITION BY entity, variable ORDER BY center_date)), d AS (SELECT entity, variable, count(DISTINCT center_date + CAST(k AS INT)) AS days FROM an, (SELECT unnest(range(-4, 6)) AS k) GROUP BY ALL)
SELECT entity, variable, count(*) AS n_anchors, count(*) FILTER (o) AS n_overlapping, days, {r('days / 10', 'effective_n')} FROM o JOIN d USING (entity, variable) GROUP BY entity, variable, days""")
def _(spark, sf_dir):
    return joins.anchor_independence(storage.stored(gaps.anchors(_ship(spark, sf_dir), 10, 5, SEED), "anchors"), 10)


_NUM = " UNION ALL ".join(f"SELECT entity, variable, CAST({n} AS BIGINT) AS length, count(*) FILTER (k = {n}) AS starts FROM (SELECT entity, variable, sum(CAST(observed AS INT)) OVER ({_W} ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS k FROM panel) GROUP BY ALL" for n in (3, 10, 30))


@_add("g15_feasibility", f"{ORDERS}, f AS ({_NUM}) SELECT *, starts > 0 AS feasible FROM f")
def _(spark, sf_dir):
    return joins.feasibility(storage.stored(_orders(spark, sf_dir), "panel"), [3, 10, 30])


@_add("m10_event_scores", f"""WITH ep AS ({SQL['e6_episodes']}), cl AS ({SQL['i1_climatology'].replace(ORDERS, SHIP)}), p AS (SELECT * FROM ({SHIP} SELECT * FROM panel)), d AS (SELECT e.entity, e.variable, e.start_date, e.end_date, p.ts, p.value AS truth, pred FROM ep e JOIN p ON e.entity = p.entity AND e.variable = p.variable AND p.ts BETWEEN CAST(e.start_date AS DATE) AND CAST(e.end_date AS DATE) JOIN cl ON cl.entity = p.entity AND cl.variable = p.variable AND CAST(cl.ts AS DATE) = p.ts WHERE p.value IS NOT NULL AND pred IS NOT NULL)
SELECT entity, variable, start_date, end_date, count(*) AS n, {r('avg(abs(pred - truth))', 'mae')}, {r('max(pred) - max(truth)', 'peak_error')}, first(ts ORDER BY pred DESC, ts) - first(ts ORDER BY truth DESC, ts) AS peak_lag FROM d GROUP BY ALL""")
def _(spark, sf_dir):
    p = storage.stored(_ship(spark, sf_dir), "panel")
    scored = fillers.climatology(p).withColumn("pred", F.round(F.col("pred") + 1e-10, 6)).withColumn("truth", F.col("value"))
    return joins.event_scores(gaps.episodes(p, 0.9, 2, 3), scored)


_HP = f"{_HIDDEN}, hp AS (SELECT * EXCLUDE (value, seen), value AS truth, seen AS value FROM hid), {_CLIM.replace('FROM panel', 'FROM hp')}, {_line('hp', 'value')}"


@_add("i13_models_scored", f"""{_HP}, al AS (SELECT 'linear' AS model, entity, variable, hidden, truth, pred FROM lin UNION ALL SELECT 'persistence', entity, variable, hidden, truth, coalesce(last_value(value IGNORE NULLS) OVER ({_W}), avg(value) FILTER (split = 'train') OVER (PARTITION BY entity, variable)) FROM hp
UNION ALL SELECT 'climatology', p.entity, p.variable, hidden, truth, coalesce(cd.m, ca.m) FROM hp p LEFT JOIN cd ON p.entity = cd.entity AND p.variable = cd.variable AND dayofyear(make_date(2000, month(p.ts), day(p.ts))) = cd.doy LEFT JOIN ca ON p.entity = ca.entity AND p.variable = ca.variable)
SELECT model, entity, variable, count(*) AS n, {r('avg(abs(pred - truth))', 'mae')}, {r('avg(pred - truth)', 'bias')} FROM al WHERE hidden AND truth IS NOT NULL AND pred IS NOT NULL GROUP BY ALL""")
def _(spark, sf_dir):
    every = fillers.by_name(_hidden(spark, sf_dir), ["climatology", "linear", "persistence"])
    return metrics.basic(every.where("hidden"), ["model", "entity", "variable"]).select("model", "entity", "variable", "n", "mae", "bias")


# whole tables of a run


@_add("s13_version_manifest", f"{_FLAGGED}, v AS (SELECT 'published' AS data_version, * FROM flagged UNION ALL SELECT 'exclude', * REPLACE (CASE WHEN code IS NULL THEN value END AS value) FROM flagged) SELECT data_version, split, count(*) AS n_rows, count(DISTINCT ts) AS n_days, count(DISTINCT entity) AS n_entities, count(value) AS n_values, count(code) AS n_flagged FROM v GROUP BY ALL")
def _(spark, sf_dir):
    f, path = storage.stored(_flagged(spark, sf_dir), "flagged"), storage.scratch(spark, "versions")
    for name in ("published", "exclude"):  # each run replaces its own version's folders only
        storage.write_versioned(panel.version_values(f, name).withColumn("data_version", F.lit(name)), path, "data_version", "split")
    g = spark.read.parquet(path).groupBy("data_version", "split")
    return g.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("ts").alias("n_days"), F.countDistinct("entity").alias("n_entities"), F.count("value").alias("n_values"), F.count("known_issue_code").alias("n_flagged"))


def _lib(n: int) -> str:
    return f"SELECT CAST({n} AS BIGINT) AS length, b.entity, b.variable, b.ts + CAST(k AS INT) AS ts FROM (SELECT entity, variable, ts FROM (SELECT *, sum(CAST(observed AS INT)) OVER ({_W} ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS k FROM panel) WHERE k = {n} QUALIFY row_number() OVER (PARTITION BY entity, variable ORDER BY {_KEY}) = 1) b, (SELECT unnest(range(0, {n})) AS k)"


@_add("g16_gap_library", f"{SHIP} {_lib(10)} UNION ALL {_lib(30)}", dates="ts")
def _(spark, sf_dir):
    p = storage.stored(_ship(spark, sf_dir), "panel")
    cells = lambda n: gaps.block_cells(gaps.block_gaps(p, n, SEED)).select(F.lit(n).cast("long").alias("length"), "entity", "variable", "ts")
    return cells(10).unionByName(cells(30))
