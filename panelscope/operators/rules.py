"""Rules on single rows and small tables: units, flags, quality fields, labels, keys, table checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelscope.functions.sqlfn import SERIES

# Words of unit texts, and the factors they stand for.
#: (word of the unit given, words of the unit wanted, factor)
UNIT_FACTORS = [("inch", ["millimet", "mm"], 25.4), ("knot", ["meter", "metre", "m s"], 0.514444)]
UNCHANGED = ["1", "1.0", "identity", "no conversion", "none"]
MULTIPLIERS = ["*", "factor", "multiply", "multiply by", "x", "\u00d7"]


def conversion_factor(text: str) -> Column:
    """The factor that a unit text asks for; null where it can't be read.

    The text is reduced to its words and held against the table of units; failing that, to its
    numbers, each with the words before it: the first number after a multiplier, or the text
    itself if it is a number.
    """
    given = F.trim(F.coalesce(F.col(text).cast("string"), F.lit("identity")))
    words = F.array_join(F.regexp_extract_all(F.lower(given), F.lit("[a-z0-9.]+"), F.lit(0)), " ")
    units = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(f).alias("f")) for a, b, f in UNIT_FACTORS))
    fits = F.filter(units, lambda u: words.contains(u["a"]) & F.exists(u["b"], lambda w: words.contains(w)))
    number = r"(\D*?)(\d+(?:\.\d+)?)"
    before = F.transform(F.regexp_extract_all(F.lower(given), F.lit(number), F.lit(1)), lambda x: F.regexp_replace(F.rtrim(F.translate(x, "_", " ")), " +", " "))
    pairs = F.arrays_zip(before.alias("w"), F.regexp_extract_all(given, F.lit(number), F.lit(2)).alias("n"))
    asked = F.filter(pairs, lambda p: F.exists(F.lit(MULTIPLIERS), lambda m: F.endswith(p["w"], m)))
    alone = F.filter(pairs, lambda p: (p["n"] == given) & (F.size(pairs) == 1))
    return (
        F.when((words == "") | words.isin(*UNCHANGED), 1.0)
        .when(F.size(fits) > 0, F.get(fits, F.lit(0))["f"])
        .otherwise(F.coalesce(F.get(asked, F.lit(0))["n"], F.get(alone, F.lit(0))["n"]).try_cast("double"))
    )


def numbers_in(text: str) -> Column:
    """All numbers of a text, in order: missing-value codes as people write them."""
    return F.transform(F.regexp_extract_all(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(r"([-+]?\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))


def strict_boolean(text: str) -> Column:
    """True or false as written, else null: a caller counts the nulls as errors."""
    t = F.lower(F.trim(F.col(text).cast("string")))
    return F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False)


def as_number(text: str) -> Column:
    """The number in a text; what is none, and NaN, is null."""
    x = F.trim(F.col(text).cast("string")).try_cast("double")
    return F.when(~F.isnan(x), x)


def provider_fields(df: DataFrame, observed: str = "observed") -> DataFrame:
    """What a provider without quality marks gives: observed values count, their status is unknown."""
    seen = F.coalesce(F.col(observed), F.lit(False))
    return df.withColumns({"qc_status": F.when(seen, "observed_unflagged").otherwise("missing"), "analysis_eligible": seen, "provider_qc_status": F.when(seen, "unknown").otherwise("missing")})


#: Quality fields and what they are where a table has none.
QC_DEFAULTS = {"qc_status": "missing", "provider_qc_status": "unknown", "analysis_eligible": False, "known_issue_flag": False}


def attach_qc(df: DataFrame) -> DataFrame:
    """All quality fields, absent ones and nulls by default, and ``qc_conflict``: a row can't be
    approved by the provider and unflagged at once."""
    out = df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in QC_DEFAULTS.items()})
    return out.withColumn("qc_conflict", (F.col("qc_status") == "observed_unflagged") & (F.col("provider_qc_status") == "approved"))


def qc_counts(df: DataFrame, by: list[str]) -> DataFrame:
    status = F.col("provider_qc_status")
    return df.groupBy(*by).agg(
        F.count_if("analysis_eligible").alias("eligible"), F.count_if(status == "unknown").alias("unknown"), F.count_if(status == "approved").alias("approved"), F.count_if("known_issue_flag").alias("known_issue")
    )


def manifest(panel: DataFrame) -> DataFrame:
    """Rows, days, entities, variables and observed values of each split, and of all (null)."""
    return panel.groupingSets([["split"], []], "split").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("ts").alias("days"), F.countDistinct("entity").alias("entities"), F.countDistinct("variable").alias("variables"), F.count_if("observed").alias("observed")
    )


def split_by_ranges(df: DataFrame, ranges: list[tuple[str, str, str]], date: str = "ts") -> DataFrame:
    """Label by (name, first day, last day); days outside all ranges are unassigned."""
    label = reduce(lambda c, r: c.when(F.col(date).between(F.lit(r[1]).cast("date"), F.lit(r[2]).cast("date")), r[0]), ranges, F)
    return df.withColumn("split", label.otherwise("unassigned"))


def circular_distance(a, b) -> Column:
    """Days between two days of the leap calendar, the short way round."""
    d = F.abs(a - b)
    return F.least(d, 366 - d)


#: Kind, target and size of a validation condition, and its stratum.
STRATA = {
    "PNT T P30": "point_30pct",
    "BLK1 T D010": "t_block_10d",
    "BLK1 T D030": "t_block_30d",
    "BLK1 T D090": "t_block_90d",
    "BLK1 T D180": "t_block_180d",
    "BLK1 TFL D090": "tfl_block_90d",
    "SITE HYDROONLY D090": "station_outage",
}


def condition_stratum(text: str) -> Column:
    """Stratum of a condition id ``VAL-kind-site...-target-size``, looked up in ``STRATA``; null for
    any other text."""
    known = F.create_map(*(F.lit(x) for pair in STRATA.items() for x in pair))
    key = F.regexp_replace(F.col(text), "^VAL-([^-]+)-(?:[^-]*-)+?([^-]+)-([^-]+)$", "$1 $2 $3")
    return F.try_element_at(known, key)


def coalition_label(text: str, sources: list[str]) -> Column:
    """``S0`` and the named sources in their order, from any separators; null if one is unknown.
    Words may stand apart or, if each is one letter, run together."""
    words = F.regexp_extract_all(F.upper(F.coalesce(F.col(text), F.lit(""))), F.lit(r'[^\s+,|;/\[\]"]+'), F.lit(0))
    named = F.array_except(words, F.array(*map(F.lit, ("S0", "NONE", "EMPTY"))))
    every = F.lit(sources)
    unknown = F.array_except(named, every)
    apart = F.split(F.array_join(named, ""), "")
    together = (F.size(named) == 1) & (F.size(F.array_except(apart, every)) == 0)
    members = F.when(F.size(unknown) == 0, named).when(together, apart)
    return F.array_join(F.concat(F.array(F.lit("S0")), F.array_intersect(every, members)), "+")


def single_block_design(df: DataFrame) -> DataFrame:
    """Rows of the dense single-block design with a window length; absent marks take their only value."""
    mask, layout = (F.lower(F.col(c)) for c in ("mask_type", "layout"))
    plain = lambda c, *ok: c.isNull() | c.isin(*ok)
    kept = df.where((F.upper("experiment") == "SCI_DENSE") & plain(mask, "block", "single_block", "single-block") & plain(layout, "single", "single_block", "single-block"))
    out = kept.withColumns({"mask_type": F.coalesce(mask, F.lit("block")), "layout": F.coalesce(layout, F.lit("single")), "window_length": as_number("window_length")})
    return out.where("window_length is not null")


def overlap_class(same_entity, same_type, kind) -> Column:
    return F.when(same_entity & same_type & (kind == "flood"), "same_type_flood").when(same_entity & same_type, "same_type").when(same_entity, "cross_type").otherwise("cross_station")


def digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: number of rows and a hash of them that no order of the rows changes; repeats count."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    h = lambda at: F.conv(F.substring(F.md5(text), at, 12), 16, 10).cast("long")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(h(1)).alias("xor_hash"), (F.sum(h(13) % 1_000_003) % 1_000_003).alias("sum_hash"))


def donors(panel: DataFrame, variables: list[str]) -> DataFrame:
    """(target, donor, variable): the other entities' series of the given variables."""
    series = panel.where(F.col("variable").isin(variables) & F.col("observed")).select("entity", "variable").distinct()
    targets = panel.select(F.col("entity").alias("target")).distinct()
    return targets.join(series, F.col("target") != F.col("entity")).select("target", F.col("entity").alias("donor"), "variable")  # series by series: narrow tables


def changed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, with how often and on which side; none if they agree."""
    both = before.withColumn("_d", F.lit(-1)).unionByName(after.withColumn("_d", F.lit(1)))
    g = both.groupBy(*before.columns).agg(F.sum("_d").alias("d")).where("d <> 0")
    return g.withColumn("side", F.when(F.col("d") > 0, "after").otherwise("before")).withColumn("n", F.abs("d")).drop("d")


def joint_days(panel: DataFrame, by: list[str], series: int) -> DataFrame:
    """Days on which all of the expected number of series are observed."""
    return panel.groupBy(*by, "ts").agg(F.count_if("observed").alias("n")).where(F.col("n") == series).drop("n")


def median_filled(df: DataFrame, value: str = "value") -> DataFrame:
    """``filled``: nulls take the series' median over training days."""
    m = df.where("split = 'train'").groupBy(*SERIES).agg(F.percentile(value, 0.5).alias("_m"))
    return df.join(m, SERIES, "left").withColumn("filled", F.coalesce(value, "_m")).drop("_m")


def append_variable(panel: DataFrame, like: str, name: str, values: DataFrame) -> DataFrame:
    """A new variable on the key grid of another: ``values`` (entity, ts, value), null where absent."""
    grid = panel.where(F.col("variable") == like).select("entity", "ts", "split")
    new = grid.join(values.select("entity", "ts", "value"), ["entity", "ts"], "left").select("entity", F.lit(name).alias("variable"), "ts", "value", F.col("value").isNotNull().alias("observed"), "split")
    return panel.select("entity", "variable", "ts", "value", "observed", "split").unionByName(new)


def clear_windows(panel: DataFrame, flag: str, length: int) -> DataFrame:
    """Starts of ``length`` observed days, none of which carries the flag: differences of running sums."""
    w = Window.partitionBy(*SERIES).orderBy("ts").rowsBetween(0, length - 1)
    ok = F.col("observed") & ~F.coalesce(F.col(flag), F.lit(False))
    n = panel.withColumn("_n", F.sum(ok.cast("int")).over(w)).withColumn("_k", F.count(F.lit(1)).over(w))
    return n.where((F.col("_n") == length) & (F.col("_k") == length)).select(*SERIES, "ts")


def key_sets(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Every key of either table and where it is: both, missing (only in ``a``), extra (only in ``b``)."""
    g = a.select(*keys, F.lit(1).alias("s")).distinct().unionByName(b.select(*keys, F.lit(2).alias("s")).distinct()).groupBy(*keys).agg(F.sum("s").alias("s"))
    return g.select(*keys, F.when(F.col("s") == 3, "both").when(F.col("s") == 1, "missing").otherwise("extra").alias("place"))


def shard_of(df: DataFrame, key: str, by: list[str], shards: int) -> DataFrame:
    """Deal the rows of each ``by`` over shards in the order of the key."""
    w = Window.partitionBy(*by).orderBy(key)
    return df.withColumn("shard", F.pmod(F.row_number().over(w) - 1, F.lit(shards)))


def bounds(center: str, length: str, n_days: str) -> tuple[Column, Column, Column]:
    """First and last day of a window around its centre (an even length takes the earlier middle), and whether it fits."""
    first = F.col(center) - F.floor((F.col(length) - 1) / 2)
    last = first + F.col(length) - 1
    return first.cast("long"), last.cast("long"), (first >= 0) & (last < F.col(n_days))
