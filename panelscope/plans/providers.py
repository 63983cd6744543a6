"""Queries on provider payloads and training layouts, with their SQL twins.

Payloads are spelled from the driver's events, one text a user: both sides share the rules by
which a row becomes a feature.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelscope.operators import gaps
from panelscope.plans.catalog import SEED, SHIP, _add, _ship, r
from panelscope.sources import adapters, provider
from panelscope.sources.storage import stored

#: Every seventh event is provisional, every fifth estimated, every eleventh has no number.
_FEATURE = "named_struct('id', concat('f', cast(event_id as string)), 'geometry', named_struct('coordinates', array(cast(user_id % 90 as double), 10.5D)), 'properties', named_struct('monitoring_location_id', concat('U-', cast(user_id as string)), 'parameter_code', IF(event_id % 13 = 0, '60', '10'), 'statistic_id', '3', 'unit_of_measure', 'degC', 'time_series_id', event_type, 'time', date_format(ts, 'yyyy-MM-dd'), 'value', IF(event_id % 11 = 0, 'Ice', cast(cast(value as decimal(12, 2)) as string)), 'approval_status', IF(event_id % 7 = 0, 'Provisional', 'Approved'), 'qualifier', IF(event_id % 5 = 0, array(' e '), IF(event_id % 3 = 0, array('ESTIMATED', 'x'), CAST(NULL AS ARRAY<STRING>)))))"


def _payloads(spark, sf_dir):
    e = adapters.table(spark, sf_dir, "events").withColumn("feature", F.expr(_FEATURE))
    every = e.groupBy("user_id").agg(F.to_json(F.struct(F.collect_list("feature").alias("features"))).alias("payload"))
    none = e.select((-F.col("user_id") - 1).alias("user_id")).distinct().where("user_id % 3 = 0").withColumn("payload", F.lit('{"features": []}'))
    return every.unionByName(none)


@_add("s11_series_metadata", """SELECT user_id, 'f' || CAST(event_id AS VARCHAR) AS feature_id, CAST(user_id % 90 AS DOUBLE) AS longitude, 10.5::DOUBLE AS latitude, CASE WHEN event_id % 13 = 0 THEN '60' ELSE '10' END AS parameter_code, '3' AS statistic_id, 'degC' AS unit_of_measure, true AS metadata_available, CASE WHEN event_id % 13 = 0 THEN 'parameter_code' ELSE '' END AS mismatch FROM events
UNION ALL SELECT DISTINCT -user_id - 1, NULL, NULL, NULL, NULL, NULL, NULL, false, NULL FROM events WHERE (-user_id - 1) % 3 = 0""")
def _(spark, sf_dir):
    return provider.series_metadata(_payloads(spark, sf_dir), "payload", "user_id", {"parameter_code": "10", "statistic_id": "3", "unit_of_measure": "degC"})


_DAILY = """d AS (SELECT user_id, CAST(ts AS DATE) AS ts, event_type AS time_series_id, CASE WHEN event_id % 11 <> 0 THEN CAST(CAST(value AS DECIMAL(12, 2)) AS DOUBLE) END AS raw_value, event_id % 7 <> 0 AS ok, event_id % 5 = 0 OR event_id % 3 = 0 AS estimated FROM events), k AS (SELECT *, count(*) OVER (PARTITION BY user_id, time_series_id, ts) AS c FROM d)"""


@_add("s9_daily_values", f"""WITH {_DAILY} SELECT user_id, ts, time_series_id, {r('raw_value')}, {r('CASE WHEN ok THEN raw_value * 0.3048 END', 'value')}, 'degC' AS unit_of_measure, CASE WHEN ok THEN 'Approved' ELSE 'Provisional' END AS approval_status, ok AS quality_approved, estimated, CASE WHEN ok AND estimated THEN 'approved_estimated' WHEN ok THEN 'approved' ELSE 'excluded_provisional' END AS qc_status,
CASE WHEN raw_value IS NULL THEN 'not_finite' WHEN ts > DATE '2024-06-30' THEN 'outside_period' WHEN c > 1 THEN 'repeated' END AS problem FROM k""", dates="ts")
def _(spark, sf_dir):
    return provider.daily_values(_payloads(spark, sf_dir), "payload", "user_id", 0.3048, "1900-01-01", "2024-06-30")


_LENGTHS = [10, 5, 3]


def _hash(*cols: str) -> str:
    return f"md5(concat_ws('|', '{SEED}', {', '.join(cols)}))"


@_add("g8_training_layouts", f"""{SHIP}, ob AS (SELECT *, sum(CAST(observed AS INT)) OVER w20 AS k20, sum(CAST(observed AS INT)) OVER w10 AS k10, sum(CAST(observed AS INT)) OVER w5 AS k5, sum(CAST(observed AS INT)) OVER w3 AS k3 FROM panel WHERE split = 'train' WINDOW w20 AS (PARTITION BY entity, variable ORDER BY ts ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING), w10 AS (PARTITION BY entity, variable ORDER BY ts ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING), w5 AS (PARTITION BY entity, variable ORDER BY ts ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), w3 AS (PARTITION BY entity, variable ORDER BY ts ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
sp AS (SELECT entity, variable, ts AS f FROM ob WHERE k20 = 20 QUALIFY row_number() OVER (PARTITION BY entity, variable ORDER BY {_hash('entity', 'variable', 'CAST(ts AS VARCHAR)')}) = 1),
pa AS (SELECT *, row_number() OVER (PARTITION BY entity, variable ORDER BY {_hash('entity', 'variable', 'CAST(i AS VARCHAR)')}) - 1 AS part FROM sp, (VALUES (0, 10), (1, 5), (2, 3)) v(i, n)), la AS (SELECT entity, variable, part, n, f + CAST(coalesce(sum(n + 1) OVER (PARTITION BY entity, variable ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS s FROM pa),
no AS (SELECT DISTINCT entity, variable FROM ob WHERE (entity, variable) NOT IN (SELECT (entity, variable) FROM sp)),
a1 AS (SELECT entity, variable, ts AS s FROM ob JOIN no USING (entity, variable) WHERE k10 = 10 QUALIFY row_number() OVER (PARTITION BY entity, variable ORDER BY {_hash('entity', 'variable', "'0'", 'CAST(ts AS VARCHAR)')}) = 1),
a2 AS (SELECT o.entity, o.variable, o.ts AS s FROM ob o JOIN no USING (entity, variable) LEFT JOIN a1 ON a1.entity = o.entity AND a1.variable = o.variable WHERE k5 = 5 AND (a1.s IS NULL OR o.ts + 5 < a1.s OR o.ts > a1.s + 10) QUALIFY row_number() OVER (PARTITION BY o.entity, o.variable ORDER BY {_hash('o.entity', 'o.variable', "'1'", 'CAST(o.ts AS VARCHAR)')}) = 1),
a3 AS (SELECT o.entity, o.variable, o.ts AS s FROM ob o JOIN no USING (entity, variable) LEFT JOIN a1 ON a1.entity = o.entity AND a1.variable = o.variable LEFT JOIN a2 ON a2.entity = o.entity AND a2.variable = o.variable WHERE k3 = 3 AND (a1.s IS NULL OR o.ts + 3 < a1.s OR o.ts > a1.s + 10) AND (a2.s IS NULL OR o.ts + 3 < a2.s OR o.ts > a2.s + 5) QUALIFY row_number() OVER (PARTITION BY o.entity, o.variable ORDER BY {_hash('o.entity', 'o.variable', "'2'", 'CAST(o.ts AS VARCHAR)')}) = 1),
al AS (SELECT entity, variable, part, n, s FROM la UNION ALL SELECT * FROM (SELECT entity, variable, 0 AS part, 10 AS n, s FROM a1 UNION ALL SELECT entity, variable, 1, 5, s FROM a2 UNION ALL SELECT entity, variable, 2, 3, s FROM a3) QUALIFY count(*) OVER (PARTITION BY entity, variable) = 3)
SELECT entity, variable, CAST(part AS BIGINT) AS part, CAST(n AS BIGINT) AS length, s AS start_date, s + CAST(n - 1 AS INT) AS end_date FROM al""", dates="start_date end_date")
def _(spark, sf_dir):
    return gaps.training_layout(stored(_ship(spark, sf_dir).where("split = 'train'"), "train"), _LENGTHS, SEED)
