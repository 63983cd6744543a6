"""Queries on units, flags, quality fields, labels, keys and table checks, with their SQL twins.

Texts that the driver's tables lack are spelled from their columns by an expression that
both sides share.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelscope.functions.sqlfn import doy366, safe_corr
from panelscope.operators import panel, rules
from panelscope.plans.catalog import _DOY, EV, ORDERS, SHIP, _add, _corr, _orders, _ship, r
from panelscope.sources import adapters

_UNIT = "CASE l_linenumber WHEN 1 THEN 'identity' WHEN 2 THEN 'Knots to m/s' WHEN 3 THEN ' inch -> mm ' WHEN 4 THEN concat('factor ', CAST(CAST(l_quantity AS INT) AS VARCHAR(9)), '.5') WHEN 5 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR(9)) WHEN 6 THEN 'some cups' END"
_CODES = "concat('codes: ', CAST(CAST(l_quantity AS INT) AS VARCHAR(9)), '; -', CAST(l_linenumber AS VARCHAR(9)), '.50,+7')"
_FLAG = "CASE l_linenumber WHEN 1 THEN 'true' WHEN 2 THEN ' FALSE ' WHEN 3 THEN '1' WHEN 4 THEN '0' WHEN 5 THEN 'yes' WHEN 6 THEN '' END"
_TEXT = "CASE l_linenumber WHEN 1 THEN ' 12.5 ' WHEN 2 THEN 'n/a' WHEN 3 THEN '1e3' WHEN 4 THEN '-7' WHEN 5 THEN 'NaN' WHEN 6 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR(9)) END"
_COND = "CASE l_linenumber WHEN 1 THEN 'VAL-PNT-B1-T-P30' WHEN 2 THEN 'VAL-BLK1-B1-T-D030' WHEN 3 THEN 'VAL-BLK1-P3-T-D180' WHEN 4 THEN 'VAL-BLK1-B1-TFL-D090' WHEN 5 THEN 'VAL-SITE-B1-HYDROONLY-D090' WHEN 6 THEN 'VAL-BLK1-T-D030' END"
_COAL = "CASE l_linenumber WHEN 1 THEN 'S0' WHEN 2 THEN 'S0+C+A' WHEN 3 THEN 'b, d' WHEN 4 THEN '[\"A\", \"D\"]' WHEN 5 THEN 'DCA' WHEN 6 THEN 'A;Q' END"


def _items(spark, sf_dir, text):
    return adapters.table(spark, sf_dir, "lineitem").withColumn("text", F.expr(text))


#: The twins of texts state what each should give.
_ASKED = "CASE l_linenumber WHEN 2 THEN 0.514444 WHEN 3 THEN 25.4 WHEN 4 THEN CAST(CAST(l_quantity AS INT) AS DOUBLE) + 0.5 WHEN 5 THEN CAST(CAST(l_quantity AS INT) AS DOUBLE) WHEN 6 THEN NULL ELSE 1.0 END"
_STRATUM = "CASE l_linenumber WHEN 1 THEN 'point_30pct' WHEN 2 THEN 't_block_30d' WHEN 3 THEN 't_block_180d' WHEN 4 THEN 'tfl_block_90d' WHEN 5 THEN 'station_outage' END"
_LABEL = "CASE l_linenumber WHEN 1 THEN 'S0' WHEN 2 THEN 'S0+A+C' WHEN 3 THEN 'S0+B+D' WHEN 4 THEN 'S0+A+D' WHEN 5 THEN 'S0+A+C+D' WHEN 6 THEN NULL ELSE 'S0' END"


@_add("p2_conversion_factor", f"SELECT {_UNIT} AS text, {r(_ASKED, 'factor')}, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, sf_dir):
    return _items(spark, sf_dir, _UNIT).groupBy("text", rules.conversion_factor("text").alias("factor")).agg(F.count(F.lit(1)).alias("n"))


@_add("s4_missing_codes", f"SELECT text, {r('CAST(c AS DOUBLE)', 'code')}, count(*) AS n FROM (SELECT text, unnest(regexp_extract_all(text, '[-+]?\\d+(?:\\.\\d+)?')) AS c FROM (SELECT {_CODES} AS text FROM lineitem)) GROUP BY ALL")
def _(spark, sf_dir):
    found = _items(spark, sf_dir, _CODES).select("text", F.explode(rules.numbers_in("text")).alias("code"))
    return found.groupBy("text", "code").agg(F.count(F.lit(1)).alias("n"))


@_add("p19_strict_boolean", f"SELECT text, CASE WHEN lower(trim(text)) IN ('true', '1') THEN 'true' WHEN lower(trim(text)) IN ('false', '0') THEN 'false' END AS flag, count(*) AS n FROM (SELECT {_FLAG} AS text FROM lineitem) GROUP BY ALL")
def _(spark, sf_dir):
    return _items(spark, sf_dir, _FLAG).groupBy("text", rules.strict_boolean("text").cast("string").alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@_add("p35_as_number", f"SELECT text, {r('CASE WHEN NOT isnan(TRY_CAST(trim(text) AS DOUBLE)) THEN TRY_CAST(trim(text) AS DOUBLE) END', 'x')}, count(*) AS n FROM (SELECT {_TEXT} AS text FROM lineitem) GROUP BY ALL")
def _(spark, sf_dir):
    return _items(spark, sf_dir, _TEXT).groupBy("text", rules.as_number("text").alias("x")).agg(F.count(F.lit(1)).alias("n"))


@_add("p21_condition_stratum", f"SELECT {_COND} AS text, {_STRATUM} AS stratum, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, sf_dir):
    return _items(spark, sf_dir, _COND).groupBy("text", rules.condition_stratum("text").alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


@_add("p22_coalition_label", f"SELECT {_COAL} AS text, {_LABEL} AS label, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, sf_dir):
    return _items(spark, sf_dir, _COAL).groupBy("text", rules.coalition_label("text", ["A", "B", "C", "D"]).alias("label")).agg(F.count(F.lit(1)).alias("n"))


_DENSE = "CASE WHEN o_orderkey % 3 = 0 THEN 'sci_dense' ELSE 'SCI_NET' END AS experiment, CASE o_orderkey % 5 WHEN 0 THEN 'Block' WHEN 1 THEN 'point' WHEN 2 THEN 'single-block' END AS mask_type, CASE o_orderkey % 7 WHEN 0 THEN 'single' WHEN 1 THEN 'multi' END AS layout, CASE o_orderkey % 4 WHEN 0 THEN 'x' ELSE CAST(o_orderkey % 4 * 90 AS VARCHAR(9)) END AS window_length"


@_add("p25_single_block_design", f"""WITH t AS (SELECT o_orderkey, {_DENSE} FROM orders) SELECT o_orderkey, experiment, coalesce(lower(mask_type), 'block') AS mask_type, coalesce(lower(layout), 'single') AS layout, TRY_CAST(window_length AS DOUBLE) AS window_length FROM t
WHERE upper(experiment) = 'SCI_DENSE' AND coalesce(lower(mask_type), 'block') IN ('block', 'single_block', 'single-block') AND coalesce(lower(layout), 'single') IN ('single', 'single_block', 'single-block') AND TRY_CAST(window_length AS DOUBLE) IS NOT NULL""")
def _(spark, sf_dir):
    return rules.single_block_design(adapters.table(spark, sf_dir, "orders").selectExpr("o_orderkey", *_split_select(_DENSE)))


def _split_select(text):
    return [x.strip() for x in text.replace(" AS experiment,", " AS experiment;").replace(" AS mask_type,", " AS mask_type;").replace(" AS layout,", " AS layout;").split(";")]


@_add("p3_qc_mapping", f"{ORDERS} SELECT entity, variable, ts, CASE WHEN observed THEN 'observed_unflagged' ELSE 'missing' END AS qc_status, observed AS analysis_eligible, CASE WHEN observed THEN 'unknown' ELSE 'missing' END AS provider_qc_status FROM panel", dates="ts")
def _(spark, sf_dir):
    return rules.provider_fields(_orders(spark, sf_dir)).select("entity", "variable", "ts", "qc_status", "analysis_eligible", "provider_qc_status")


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'unknown' END"
_QC = "CASE WHEN o_orderkey % 4 = 0 THEN 'observed_unflagged' WHEN o_orderkey % 4 = 1 THEN 'approved' END"


def _qc_rows(spark, sf_dir):
    o = adapters.table(spark, sf_dir, "orders")
    return rules.attach_qc(o.select("o_orderpriority", "o_orderkey", F.expr(_STATUS).alias("provider_qc_status"), F.expr(_QC).alias("qc_status"), (F.col("o_totalprice") > 100000).alias("analysis_eligible")))


@_add("p5_attach_qc", f"SELECT o_orderkey, coalesce({_QC}, 'missing') AS qc_status, coalesce({_STATUS}, 'unknown') AS provider_qc_status, o_totalprice > 100000 AS analysis_eligible, false AS known_issue_flag, coalesce({_QC}, 'missing') = 'observed_unflagged' AND coalesce({_STATUS}, 'unknown') = 'approved' AS qc_conflict FROM orders")
def _(spark, sf_dir):
    return _qc_rows(spark, sf_dir).select("o_orderkey", "qc_status", "provider_qc_status", "analysis_eligible", "known_issue_flag", "qc_conflict")


@_add("p6_qc_counts", f"SELECT o_orderpriority, count(*) FILTER (o_totalprice > 100000) AS eligible, count(*) FILTER (coalesce({_STATUS}, 'unknown') = 'unknown') AS unknown, count(*) FILTER ({_STATUS} = 'approved') AS approved, CAST(0 AS BIGINT) AS known_issue FROM orders GROUP BY ALL")
def _(spark, sf_dir):
    return rules.qc_counts(_qc_rows(spark, sf_dir), ["o_orderpriority"])


@_add("p8_changed_cells", f"{SHIP} SELECT entity, variable, count(*) FILTER (value IS NOT NULL AND month(ts) = 6) AS changed, count(*) AS cells FROM panel GROUP BY ALL")
def _(spark, sf_dir):
    p = _ship(spark, sf_dir).withColumn("known_issue_flag", F.month("ts") == 6)
    return panel.changed_cells(panel.version_values(p, "exclude"), "raw_value", "value", ["entity", "variable"])


@_add("p10_manifest", f"{SHIP} SELECT split, count(*) AS rows, count(DISTINCT ts) AS days, count(DISTINCT entity) AS entities, count(DISTINCT variable) AS variables, count(*) FILTER (observed) AS observed FROM panel GROUP BY GROUPING SETS ((split), ())")
def _(spark, sf_dir):
    return rules.manifest(_ship(spark, sf_dir))


@_add("p11_split_by_ranges", f"{ORDERS} SELECT entity, CASE WHEN ts BETWEEN DATE '1995-02-01' AND DATE '1998-12-31' THEN 'train' WHEN ts BETWEEN DATE '1999-02-01' AND DATE '1999-12-31' THEN 'validation' ELSE 'unassigned' END AS split, count(*) AS n FROM obs GROUP BY ALL")
def _(spark, sf_dir):
    ranges = [("train", "1995-02-01", "1998-12-31"), ("validation", "1999-02-01", "1999-12-31")]
    return rules.split_by_ranges(adapters.order_panel(spark, sf_dir), ranges).groupBy("entity", "split").agg(F.count(F.lit(1)).alias("n"))


@_add("p14_circular_distance", f"{ORDERS} SELECT entity, ts, least(abs({_DOY} - 15), 366 - abs({_DOY} - 15)) AS distance FROM obs", dates="ts")
def _(spark, sf_dir):
    return adapters.order_panel(spark, sf_dir).select("entity", "ts", rules.circular_distance(doy366("ts"), F.lit(15)).cast("long").alias("distance"))


@_add("p13_climatological_day", f"{ORDERS} SELECT {_DOY} AS doy, CASE WHEN month(ts) IN (12, 1, 2) THEN 'DJF' WHEN month(ts) IN (3, 4, 5) THEN 'MAM' WHEN month(ts) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END AS season, count(*) AS n, {r('avg(value)', 'mean')} FROM obs GROUP BY ALL")
def _(spark, sf_dir):
    from panelscope.functions.sqlfn import season

    return adapters.order_panel(spark, sf_dir).groupBy(doy366("ts").cast("long").alias("doy"), season("ts").alias("season")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


@_add("p27_overlap_class", """WITH k AS (SELECT l_linestatus AS e, CASE WHEN l_linenumber <= 2 THEN 'flood' WHEN l_linenumber <= 4 THEN 'low_flow' ELSE 'heat' END AS t, CASE WHEN l_quantity > 25 THEN 'flood' ELSE 'heat' END AS t2, l_returnflag = 'A' AS same FROM lineitem)
SELECT e, CASE WHEN same AND t = t2 AND t = 'flood' THEN 'same_type_flood' WHEN same AND t = t2 THEN 'same_type' WHEN same THEN 'cross_type' ELSE 'cross_station' END AS class, count(*) AS n FROM k GROUP BY ALL""")
def _(spark, sf_dir):
    k = adapters.table(spark, sf_dir, "lineitem").selectExpr("l_linestatus AS e", "CASE WHEN l_linenumber <= 2 THEN 'flood' WHEN l_linenumber <= 4 THEN 'low_flow' ELSE 'heat' END AS t", "CASE WHEN l_quantity > 25 THEN 'flood' ELSE 'heat' END AS t2", "l_returnflag = 'A' AS same")
    return k.groupBy("e", rules.overlap_class(F.col("same"), F.col("t") == F.col("t2"), F.col("t")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@_add("p29_digest", "WITH t AS (SELECT md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority)) AS h FROM orders) SELECT count(*) AS rows, bit_xor(CAST(('0x' || substr(h, 1, 12)) AS BIGINT)) AS xor_hash, CAST(sum(CAST(('0x' || substr(h, 13, 12)) AS BIGINT) % 1000003) % 1000003 AS BIGINT) AS sum_hash FROM t")
def _(spark, sf_dir):
    return rules.digest(adapters.table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@_add("p30_donors", f"{SHIP} SELECT a.entity AS target, b.entity AS donor, b.variable FROM (SELECT DISTINCT entity FROM obs) a JOIN (SELECT DISTINCT entity, variable FROM obs WHERE variable IN ('T', 'F')) b ON a.entity <> b.entity")
def _(spark, sf_dir):
    return rules.donors(_ship(spark, sf_dir), ["T", "F"])


@_add("p31_changed_rows", f"{ORDERS} SELECT entity, ts, {r('value + 1', 'value')}, 'after' AS side, CAST(1 AS BIGINT) AS n FROM obs WHERE month(ts) = 2 UNION ALL SELECT entity, ts, {r('value')}, 'before', 1 FROM obs WHERE month(ts) = 2", dates="ts")
def _(spark, sf_dir):
    o = adapters.order_panel(spark, sf_dir).select("entity", "ts", "value")
    return rules.changed_rows(o, o.withColumn("value", F.when(F.month("ts") == 2, F.col("value") + 1).otherwise(F.col("value"))))


@_add("p32_result_year", "SELECT CAST(year(coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 40 DAY END)) AS VARCHAR) AS year, count(*) AS n FROM orders GROUP BY ALL")
def _(spark, sf_dir):
    o = adapters.table(spark, sf_dir, "orders")
    first = F.coalesce(F.when(F.col("o_orderstatus") == "F", F.to_date("o_orderdate")), F.when(F.col("o_orderkey") % 2 == 0, F.date_add(F.to_date("o_orderdate"), 40)))
    return o.groupBy(F.year(first).cast("string").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@_add("p33_median_filled", f"{ORDERS}, m AS (SELECT entity, variable, quantile_cont(value, 0.5) AS m FROM panel WHERE split = 'train' GROUP BY ALL) SELECT panel.entity, panel.variable, ts, {r('coalesce(value, m)', 'filled')} FROM panel JOIN m ON panel.entity = m.entity AND panel.variable = m.variable", dates="ts")
def _(spark, sf_dir):
    return rules.median_filled(_orders(spark, sf_dir)).select("entity", "variable", "ts", "filled")


@_add("p34_joint_days", f"{SHIP} SELECT ts FROM panel WHERE observed GROUP BY ts HAVING count(*) = (SELECT count(*) FROM (SELECT DISTINCT entity, variable FROM obs))", dates="ts")
def _(spark, sf_dir):
    p = _ship(spark, sf_dir)
    return rules.joint_days(p, [], p.select("entity", "variable").distinct().count())


@_add("p36_series", f"{ORDERS} SELECT ts, split, observed, {r('value')} FROM panel WHERE entity = '1-URGENT'", dates="ts")
def _(spark, sf_dir):
    return _orders(spark, sf_dir).where("entity = '1-URGENT'").select("ts", "split", "observed", "value")


@_add("j5_append_variable", f"{SHIP}, n AS (SELECT entity, ts, \"F\" * 2 AS value FROM days WHERE day(ts) <= 15) SELECT entity, variable, ts, {r('value')}, observed, split FROM panel UNION ALL SELECT p.entity, 'Rs', p.ts, {r('n.value', 'value')}, n.value IS NOT NULL, split FROM panel p LEFT JOIN n ON p.entity = n.entity AND p.ts = n.ts WHERE variable = 'T'", dates="ts")
def _(spark, sf_dir):
    new = adapters.ship_days(spark, sf_dir).where(F.dayofmonth("ts") <= 15).select("entity", "ts", (F.col("F") * 2).alias("value"))
    return rules.append_variable(_ship(spark, sf_dir), "T", "Rs", new)


@_add("j11_clear_windows", f"{ORDERS}, f AS (SELECT *, observed AND coalesce(value, 0) <= 2 AS ok FROM panel) SELECT entity, variable, ts FROM f QUALIFY count(*) FILTER (ok) OVER (PARTITION BY entity, variable ORDER BY ts ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) = 4", dates="ts")
def _(spark, sf_dir):
    return rules.clear_windows(_orders(spark, sf_dir).withColumn("busy", F.col("value") > 2), "busy", 4)


@_add("r3_stack", f"{EV} SELECT model, gap, m.k AS metric, {r('m.v', 'value')} FROM (SELECT model, gap, unnest([{{'k': 'mae', 'v': avg(mae)}}, {{'k': 'mae_clim', 'v': avg(mae_clim)}}]) AS m FROM ev GROUP BY model, gap)")
def _(spark, sf_dir):
    g = adapters.eval_table(spark, sf_dir).groupBy("model", "gap").agg(F.avg("mae").alias("mae"), F.avg("mae_clim").alias("mae_clim"))
    return g.unpivot(["model", "gap"], ["mae", "mae_clim"], "metric", "value")


@_add("r4_concatenate", f"{EV} SELECT model, CAST(gap AS VARCHAR) AS gap, {r('avg(mae)', 'mae')}, CAST(NULL AS VARCHAR) AS year, CAST(NULL AS DOUBLE) AS mae_clim FROM ev GROUP BY model, gap UNION ALL SELECT model, NULL, NULL, CAST(year AS VARCHAR), {r('avg(mae_clim)', 'mae_clim')} FROM ev GROUP BY model, year")
def _(spark, sf_dir):
    ev = adapters.eval_table(spark, sf_dir)
    return ev.groupBy("model", F.col("gap").cast("string").alias("gap")).agg(F.avg("mae").alias("mae")).unionByName(ev.groupBy("model", F.col("year").cast("string").alias("year")).agg(F.avg("mae_clim").alias("mae_clim")), allowMissingColumns=True)


@_add("r6_key_sets", "SELECT k, CASE WHEN bool_or(s = 1) AND bool_or(s = 2) THEN 'both' WHEN bool_or(s = 1) THEN 'missing' ELSE 'extra' END AS place FROM (SELECT c_custkey AS k, 1 AS s FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT o_custkey, 2 FROM orders) GROUP BY k")
def _(spark, sf_dir):
    c, o = (adapters.table(spark, sf_dir, t) for t in ("customer", "orders"))
    return rules.key_sets(c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k")), o.select(F.col("o_custkey").alias("k")), ["k"])


@_add("r11_shards", "SELECT o_orderkey, o_orderpriority, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) % 4 AS shard FROM orders")
def _(spark, sf_dir):
    o = adapters.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return rules.shard_of(o, "o_orderkey", ["o_orderpriority"], 4)


@_add("w17_window_bounds", "SELECT l_orderkey, l_linenumber, c - (n - 1) // 2 AS first_row, c - (n - 1) // 2 + n - 1 AS last_row, c - (n - 1) // 2 >= 0 AND c - (n - 1) // 2 + n - 1 < 2000 AS fits FROM (SELECT l_orderkey, l_linenumber, l_partkey % 2000 AS c, CAST(l_linenumber * 30 AS BIGINT) AS n FROM lineitem)")
def _(spark, sf_dir):
    t = adapters.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), (F.col("l_partkey") % 2000).alias("c"), (F.col("l_linenumber") * 30).alias("n"), F.lit(2000).alias("days"))
    first, last, fits = rules.bounds("c", "n", "days")
    return t.select("l_orderkey", "l_linenumber", first.alias("first_row"), last.alias("last_row"), fits.alias("fits"))


@_add("w6_guarded_pearson", f"{SHIP}, w AS (SELECT entity, year(ts) AS year, month(ts) AS month, \"T\" AS x, \"F\" AS y FROM days) SELECT entity, year, month, {r(_corr('x', 'y'), 'r')}, {r('coalesce(' + _corr('x', 'y') + ', 0.0)', 'r_or_zero')} FROM w GROUP BY ALL")
def _(spark, sf_dir):
    d = adapters.ship_days(spark, sf_dir).groupBy("entity", F.year("ts").cast("long").alias("year"), F.month("ts").cast("long").alias("month")).agg(safe_corr("T", "F").alias("r"))
    return d.withColumn("r_or_zero", F.coalesce("r", F.lit(0.0)))
