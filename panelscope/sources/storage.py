"""Readers and sinks: station CSV, provider JSON, versioned and idempotent Parquet, scratch space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelscope.operators.panel import latest_per_key


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in ``spark.checkpoint.dir``, which driver and executors share; only a purely
    local session may use a temporary folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/panelscope-{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once as Parquet and read back: for a table that several steps of a query use."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_station_csv(spark: SparkSession, path: str, entity: str, variables: list[str], date: str = "DATE") -> DataFrame:
    """One entity's wide CSV as long rows (entity, variable, ts, raw_text, raw_value, bad): text that
    is there but no number is marked, not dropped."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (date, *variables)])
    wide = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    long = wide.select(F.lit(entity).alias("entity"), F.to_date(date).alias("ts"), *variables).unpivot(["entity", "ts"], variables, "variable", "raw_text")
    value = F.expr("try_cast(raw_text as double)")
    return long.select("entity", "variable", "ts", "raw_text", F.nullif(value, F.lit(float("nan"))).alias("raw_value"), (F.col("raw_text").isNotNull() & value.isNull()).alias("bad"))


def parse_date_value_json(df: DataFrame, text: str, parameter: str, fill: float, *keys: str) -> DataFrame:
    """Provider payloads ``{"properties": {"parameter": {name: {"yyyymmdd": value}}}}`` as rows
    (keys, ts, value); the fill value is null."""
    parsed = F.from_json(text, "properties STRUCT<parameter: MAP<STRING, MAP<STRING, DOUBLE>>>")
    rows = df.select(*keys, F.explode(parsed["properties"]["parameter"][parameter]).alias("k", "v"))
    return rows.select(*keys, F.to_date("k", "yyyyMMdd").alias("ts"), F.when(F.col("v") != fill, F.col("v")).alias("value"))


def parse_missing_codes(c: str):
    """Numbers in a text such as ``-999; 99.9`` as an array of doubles."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"[-+]?\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))


def write_versioned(df: DataFrame, path: str, *partitions: str) -> None:
    """Parquet by version and split; a rerun replaces only the partitions it writes."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], run: str) -> DataFrame:
    """Rows of both, the last run's row of each key kept."""
    return latest_per_key(existing.unionByName(new, allowMissingColumns=True), keys, F.desc(run))
