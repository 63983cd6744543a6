"""Streaming queries: the events table read as a stream, run to its end, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.functions.sqlfn import doy366
from panelscope.sources.storage import scratch, stored
from panelscope.streaming import causal


def _events(spark, sf_dir) -> DataFrame:
    """The table's files as a stream; the trailing glob lets a single file be a source."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def _run(out: DataFrame) -> DataFrame:
    spark = out.sparkSession
    sink = scratch(spark, "stream")
    causal.run_to_table(out, sink, scratch(spark, "progress"))
    return spark.read.schema(out.schema).parquet(sink)


def q3_daily_scores(spark, sf_dir):
    ev = _events(spark, sf_dir).withColumn("pred", F.lit(50.0))
    out = causal.daily_scores(ev, ["event_type"], "value", "pred")
    last = causal.run_to_end(out, scratch(spark, "stream"), scratch(spark, "progress"))
    got = spark.read.schema(out.schema).parquet(last) if last else spark.createDataFrame([], out.schema)
    return got.select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", (F.round(F.col("abs_error") + 1e-10, 4) + 0.0).alias("abs_error"))


def q5_activity(spark, sf_dir):
    out = causal.activity(_events(spark, sf_dir), ["user_id"], "12 hours", None)
    last = causal.run_to_end(out, scratch(spark, "stream"), scratch(spark, "progress"))
    got = spark.read.schema(out.schema).parquet(last) if last else spark.createDataFrame([], out.schema)
    return got.select("user_id", F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss").alias("start_ts"), "n")


def q4_stuck_runs(spark, sf_dir):
    ev = _events(spark, sf_dir).withColumn("value", F.floor(F.col("value") / 25).cast("double"))
    got = _run(causal.stuck_runs(ev, "event_type", 5))
    return got.groupBy("entity").agg(F.count(F.lit(1)).alias("alarms"))


def q2_last_value_fill(spark, sf_dir):
    got = _run(causal.last_value_fill(_events(spark, sf_dir), "user_id"))
    return got.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.count("previous").alias("n_with_previous"), F.max("age_seconds").alias("longest_age"))


def q1_climatology_fill(spark, sf_dir):
    doy = doy366("ts").alias("doy")
    seen = F.when(F.col("value") <= 90, F.col("value")).alias("value")
    known = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", doy, seen).groupBy("event_type", "doy").agg(F.round(F.avg("value"), 6).alias("pred"))
    ev = _events(spark, sf_dir).select("event_type", doy, seen)
    got = _run(causal.climatology_fill(ev, stored(known, "climatology"), ["event_type"]))
    filled = F.count_if(F.col("value").isNull() & F.col("filled").isNotNull())
    return got.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), filled.alias("n_filled"), (F.round(F.sum("filled") + 1e-10, 2) + 0.0).alias("total"))


QUERIES = {"q1_climatology_fill": q1_climatology_fill, "q2_last_value_fill": q2_last_value_fill, "q3_daily_scores": q3_daily_scores, "q4_stuck_runs": q4_stuck_runs, "q5_activity": q5_activity}
SQL = {
    "q1_climatology_fill": """WITH v AS (SELECT event_type, dayofyear(make_date(2000, month(ts), day(ts))) AS doy, CASE WHEN value <= 90 THEN value END AS v FROM events), c AS (SELECT event_type, doy, round(avg(v), 6) AS pred FROM v GROUP BY ALL)
SELECT event_type, count(*) AS n, count(*) FILTER (v IS NULL AND pred IS NOT NULL) AS n_filled, round(sum(coalesce(v, pred)) + 1e-10, 2) + 0.0 AS total FROM v LEFT JOIN c USING (event_type, doy) GROUP BY event_type""",
    "q2_last_value_fill": """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS entity, ts, row_number() OVER w AS i, ts - lag(ts) OVER w AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT entity, count(*) AS n, count(*) FILTER (i > 1) AS n_with_previous, CAST(max(floor(epoch(d))) AS BIGINT) AS longest_age FROM e GROUP BY entity""",
    "q3_daily_scores": """SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, round(sum(abs(50.0 - value)) + 1e-10, 4) + 0.0 AS abs_error
FROM events GROUP BY ALL""",
    "q4_stuck_runs": """WITH f AS (SELECT event_type AS entity, ts, CASE WHEN floor(value / 25) = lag(floor(value / 25)) OVER (PARTITION BY event_type ORDER BY ts) THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM f), h AS (SELECT entity, run FROM g GROUP BY ALL HAVING count(*) >= 5) SELECT entity, count(*) AS alarms FROM h GROUP BY entity""",
    "q5_activity": """WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM f), h AS (SELECT user_id, min(ts) AS a, max(ts) AS b, count(*) AS n FROM g GROUP BY user_id, s)
SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS start_ts, n FROM h""",
}
