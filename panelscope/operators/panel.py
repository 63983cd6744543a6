"""Preparing a panel: calendar, splits, calendar features, quality rules, versions, reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelscope.functions.sqlfn import SERIES, doy366, season
from panelscope.sources.adapters import TRAIN_END, VALIDATION_END


def complete_calendar(obs: DataFrame, keys: list[str] = SERIES, date: str = "ts", value: str = "value") -> DataFrame:
    """Every key on every day from the first to the last of the whole table; absent values are null."""
    span = obs.agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias(date))  # one row per day: small
    grid = obs.select(*keys).distinct().crossJoin(F.broadcast(days))
    return grid.join(obs.select(*keys, date, value), [*keys, date], "left")


def with_split(df: DataFrame, date: str = "ts") -> DataFrame:
    return df.withColumn("split", F.when(F.col(date) <= TRAIN_END, "train").when(F.col(date) <= VALIDATION_END, "validation").otherwise("test"))


def prepared(obs: DataFrame) -> DataFrame:
    """entity, variable, ts, value, observed, split on the full calendar."""
    return with_split(complete_calendar(obs)).withColumn("observed", F.col("value").isNotNull())


def calendar_features(df: DataFrame, date: str = "ts", origin_year: int = 1995) -> DataFrame:
    """Day and month on the circle, year index, leap flag, season and leap-calendar day."""
    leap = F.dayofyear(F.make_date(F.year(date), F.lit(12), F.lit(31))) == 366
    turn = 2 * F.pi() * (F.dayofyear(date) - 1) / F.when(leap, 366).otherwise(365)
    month = 2 * F.pi() * (F.month(date) - 1) / 12
    return df.select(
        "*",
        F.sin(turn).alias("doy_sin"),
        F.cos(turn).alias("doy_cos"),
        F.sin(month).alias("month_sin"),
        F.cos(month).alias("month_cos"),
        (F.year(date) - origin_year).alias("year_index"),
        leap.alias("leap_year"),
        season(date).alias("season"),
        doy366(date).alias("doy366"),
    )


def decode_missing(df: DataFrame, codes: list[float], value: str = "value") -> DataFrame:
    """``raw_value`` as read, ``value`` null where it equals a missing code."""
    hit = F.exists(F.array(*[F.lit(float(c)) for c in codes]), lambda c: F.abs(F.col(value) - c) <= 1e-9)
    return df.withColumn("raw_value", F.col(value)).withColumn(value, F.when(hit, None).otherwise(F.col(value)))


def qc_fields(df: DataFrame) -> DataFrame:
    """Observed values are eligible, absent ones missing."""
    return df.withColumn("qc_status", F.when(F.col("observed"), "observed_unflagged").otherwise("missing")).withColumn("analysis_eligible", F.col("observed"))


def apply_rules(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Known issues: ``rules`` (entity, variable, first_day, last_day, code, priority), the first in
    priority wins. The rules, a handful, become one array that every row is held against: no
    shuffle, and equal rows stay."""
    of = F.struct("priority", "code", F.col("entity").alias("e"), F.col("variable").alias("v"), "first_day", "last_day")
    every = rules.agg(F.array_sort(F.collect_list(of)).alias("_rules"))
    fits = lambda r: (r["e"] == F.col("entity")) & (r["v"] == F.col("variable")) & F.col("ts").between(r["first_day"], r["last_day"])
    met = df.crossJoin(F.broadcast(every)).withColumn("known_issue_code", F.get(F.filter("_rules", fits), F.lit(0))["code"])  # one row
    return met.drop("_rules").withColumn("known_issue_flag", F.col("known_issue_code").isNotNull())


def version_values(df: DataFrame, action: str, shift: float = -8.48) -> DataFrame:
    """A data version: flagged rows are left, excluded, or shifted; ``raw_value`` never changes."""
    flagged = F.col("known_issue_flag")
    new = {"published": F.col("value"), "exclude": F.when(~flagged, F.col("value")), "shift": F.when(flagged, F.col("value") + shift).otherwise(F.col("value"))}[action]
    return df.withColumn("raw_value", F.col("value")).withColumn("value", new)


def changed_cells(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias("changed"), F.count(F.lit(1)).alias("cells"))


def pivot_wide(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per day, a column for each ``entity_variable`` named."""
    named = df.withColumn("_c", F.concat_ws("_", "entity", "variable"))
    return named.groupBy("ts").pivot("_c", columns).agg(F.first("value"))


def duplicates(df: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Keys seen more than once, and whether their rows agree."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(F.struct(*payload)).alias("n_distinct"))
    return g.where("n_rows > 1").withColumn("kind", F.when(F.col("n_distinct") == 1, "same").otherwise("conflicting"))


def latest_per_key(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The last row of each key; what an idempotent sink keeps on a rerun."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def window_starts(df: DataFrame, size: int, stride: int) -> DataFrame:
    """(entity, n, starts): strided windows over n rows, the last one aligned to the right."""
    n = df.groupBy("entity").agg(F.countDistinct("ts").alias("n")).where(F.col("n") >= size)
    starts = F.array_union(F.sequence(F.lit(0).cast("long"), F.col("n") - size, F.lit(stride).cast("long")), F.array(F.col("n") - size))
    return n.select("entity", "n", F.explode(starts).alias("start_row"))


def powerset(sites: DataFrame, col: str) -> DataFrame:
    """(mask, members, n_members) of every subset of the (few) values of ``col``."""
    arr = sites.select(F.array_sort(F.collect_set(col)).alias("s"))
    masks = arr.select("s", F.explode(F.expr("sequence(0L, cast(pow(2, size(s)) as bigint) - 1)")).alias("mask"))
    members = F.expr("filter(s, (x, i) -> shiftright(mask, i) & 1 = 1)")
    return masks.select("mask", F.array_join(members, "+").alias("members"), F.size(members).cast("long").alias("n_members"))
