"""Driver tables as observation panels and evaluation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Split: last day of training, last day of validation; what follows is the test split.
TRAIN_END, VALIDATION_END = "1998-12-31", "1999-12-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mean_cents(c: str):
    """A mean from a whole-number sum: the same in any order of the rows."""
    return F.sum(F.round(F.col(c) * 100).cast("long")).cast("double") / F.count(F.lit(1)) / 100


def ship_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide: entity, ts, T (mean price), F (summed quantity), L (mean discount) of each ship day."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.concat("l_returnflag", "l_linestatus").alias("entity"), F.to_date("l_shipdate").alias("ts"))
        .agg(_mean_cents("l_extendedprice").alias("T"), F.sum("l_quantity").cast("double").alias("F"), _mean_cents("l_discount").alias("L"))
    )


def ship_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long observations (entity, variable, ts, value) of ``ship_days``."""
    return ship_days(spark, sf_dir).unpivot(["entity", "ts"], ["T", "F", "L"], "variable", "value").select("entity", "variable", "ts", "value")


def order_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long observations of order counts by priority and day: many real gaps."""
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("entity"), F.to_date("o_orderdate").alias("ts"))
    return days.agg(F.count(F.lit(1)).cast("double").alias("value")).select("entity", F.lit("N").alias("variable"), "ts", "value")


def eval_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items seen as scored gap fills: model, gap, anchor, seed, year, mae."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("model"),
        F.col("l_linestatus").alias("seed"),
        F.col("l_suppkey").alias("anchor"),
        F.col("l_linenumber").cast("long").alias("gap"),
        F.year("l_shipdate").cast("long").alias("year"),
        F.round(F.col("l_discount") * 100).cast("long").alias("mae"),
        F.round(F.col("l_tax") * 100).cast("long").alias("mae_clim"),
    )


def interval_table(spark: SparkSession, sf_dir: str, days: int = 30) -> DataFrame:
    """(entity, interval_id, start_date, end_date): each order holds its customer for some days."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("interval_id"), F.to_date("o_orderdate").alias("start_date"), F.date_add(F.to_date("o_orderdate"), days).alias("end_date")
    )
