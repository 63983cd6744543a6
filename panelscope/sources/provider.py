"""Provider payloads of nested features: daily values and series metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What is read of a feature; anything else in a payload is left alone.
_FEATURES = "features ARRAY<STRUCT<id: STRING, geometry: STRUCT<coordinates: ARRAY<DOUBLE>>, properties: STRUCT<monitoring_location_id: STRING, parameter_code: STRING, statistic_id: STRING, unit_of_measure: STRING, time_series_id: STRING, time: STRING, value: STRING, approval_status: STRING, qualifier: ARRAY<STRING>>>>"


def features(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, feature_id, longitude, latitude, and the properties): a row for each feature of a
    payload; a payload without any, or that is no JSON, gives one row with nulls."""
    rows = df.select(*keys, F.explode_outer(F.from_json(text, _FEATURES)["features"]).alias("f"))
    return rows.select(*keys, F.col("f.id").alias("feature_id"), F.get("f.geometry.coordinates", F.lit(0)).alias("longitude"), F.get("f.geometry.coordinates", F.lit(1)).alias("latitude"), "f.properties.*")


def series_metadata(df: DataFrame, text: str, site: str, expected: dict[str, str]) -> DataFrame:
    """One row for each series of a site, ``metadata_available``; one placeholder for a site without
    any; ``mismatch`` names the expected properties that a feature does not have, in order."""
    f = features(df, text, site)
    wrong = F.concat_ws(",", *(F.when(~F.col(k).eqNullSafe(F.lit(v)), F.lit(k)) for k, v in sorted(expected.items())))
    there = F.col("feature_id").isNotNull()
    return f.select(site, "feature_id", "longitude", "latitude", "parameter_code", "statistic_id", "unit_of_measure", there.alias("metadata_available"), F.when(there, wrong).alias("mismatch"))


def daily_values(df: DataFrame, text: str, site: str, factor: float, first: str, last: str) -> DataFrame:
    """Daily values with their evidence: approved ones converted, provisional ones null, and a mark
    on estimated ones (a qualifier E, or one that says so). ``problem`` names what makes a row
    unusable: a value that is no finite number, a day that is none or lies outside the period, an
    unknown approval status, or a repeated day of a series; null for a good row."""
    f = features(df, text, site).where("feature_id is not null")
    raw, day = F.col("value").try_cast("double"), F.try_to_date(F.substring("time", 1, 10))
    said = F.transform(F.coalesce("qualifier", F.array().cast("array<string>")), lambda q: F.upper(F.trim(q)))
    approved = F.col("approval_status") == "Approved"
    rows = f.select(
        site, day.alias("ts"), "time_series_id", raw.alias("raw_value"), F.when(approved, raw * factor).alias("value"), "unit_of_measure", "approval_status", F.coalesce(approved, F.lit(False)).alias("quality_approved"),
        F.exists(said, lambda q: (q == "E") | q.contains("ESTIMAT")).alias("estimated"),
    )
    status = F.when(F.col("quality_approved") & F.col("estimated"), "approved_estimated").when(F.col("quality_approved"), "approved").otherwise("excluded_provisional")
    finite = F.col("raw_value").isNotNull() & ~F.isnan("raw_value") & (F.abs("raw_value") < float("inf"))
    repeated = F.count(F.lit(1)).over(Window.partitionBy(site, "time_series_id", "ts")) > 1
    problem = (
        F.when(~finite, "not_finite")
        .when(F.col("ts").isNull() | ~F.col("ts").between(first, last), "outside_period")
        .when(~F.coalesce(F.col("approval_status").isin("Approved", "Provisional"), F.lit(False)), "unknown_approval")
        .when(repeated, "repeated")
    )
    return rows.withColumn("qc_status", status).withColumn("problem", problem)

