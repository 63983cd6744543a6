"""Frontiers of whole paired curves on a declared grid of gaps, for one or more denominators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.operators.analysis import first_loss
from panelscope.operators.resampling import bootstrap_mean, complete_curves, frontier_interval
from panelscope.operators.results import two_line_break
from panelscope.sources.storage import stored


def paired_units(rows: DataFrame, by: list[str], unit: str, gap: str, value: str, gaps: list[int]) -> DataFrame:
    """(by, unit, g0, g1, ..., whole): the mean of a unit at each gap of the grid. A unit is whole if it
    has a value at every gap that anyone of its group has one at. Rows without a value or off the
    grid take no part; a group without any value has no row."""
    at = [f"g{i}" for i in range(len(gaps))]
    found = rows.where(F.col(value).isNotNull() & F.col(gap).isin(gaps))
    u = stored(complete_curves(found, [*by, unit], gap, value, gaps).drop("complete"), "units")
    tested = u.groupBy(*by).agg(*(F.bool_or(F.col(g).isNotNull()).alias(f"_t{g}") for g in at))
    whole = reduce(lambda a, b: a & b, [F.col(g).isNotNull() | ~F.col(f"_t{g}") for g in at])
    return u.join(tested, by).select(*by, unit, *at, whole.alias("whole"))


def _whole_units(rows: DataFrame, by: list[str], unit: str, gap: str, value: str, gaps: list[int]) -> tuple[DataFrame, DataFrame]:
    """``paired_units``, stored, and the values of the whole ones as rows (by, unit, gap, v)."""
    u = stored(paired_units(rows, by, unit, gap, value, gaps), "paired")
    points = F.explode(F.arrays_zip(F.lit(gaps).cast("array<long>").alias("g"), F.array(*(f"g{i}" for i in range(len(gaps)))).alias("v")))
    long = u.where("whole").select(*by, unit, points.alias("_p")).select(*by, unit, F.col("_p.g").alias("gap"), F.col("_p.v").alias("v")).where("v is not null")
    return u, long


def _drawn_curve(long: DataFrame, by: list[str], unit: str, draws: int, seed: int) -> DataFrame:
    drawn = bootstrap_mean(long, [*by, "gap"], unit, "v", draws, seed)
    return stored(drawn.select(*by, "gap", F.col("n_clusters").alias("n"), *(F.round(c, 9).alias(k) for c, k in (("estimate", "mean"), ("ci_lower", "ci_lower"), ("ci_upper", "ci_upper")))), "curve")


def paired_curves(rows: DataFrame, by: list[str], unit: str, gap: str, value: str, gaps: list[int], draws: int, seed: int) -> DataFrame:
    """The curve of ``frontier_summary`` alone: no whole curve is drawn for it."""
    return _drawn_curve(_whole_units(rows, by, unit, gap, value, gaps)[1], by, unit, draws, seed)


def frontier_summary(rows: DataFrame, by: list[str], unit: str, gap: str, value: str, gaps: list[int], draws: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(summary by group, curve by group and gap) over units that have whole curves.

    The curve has each gap's mean with its interval over units drawn with replacement. The summary
    has the first loss of the lower bound (statistical frontier) and of the mean (with the interval
    of the draws' own), and the break of two lines. A group whose whole curves lack a gap of
    the declared grid has a reason in place of frontiers, and so has one without a whole curve.
    ``gaps`` ascends; groups and units are not null.
    """
    u, long = _whole_units(rows, by, unit, gap, value, gaps)
    at = [f"g{i}" for i in range(len(gaps))]
    lacking = F.array_compact(F.array(*(F.when(F.count_if(F.col("whole") & F.col(g).isNotNull()) == 0, F.lit(str(x))) for g, x in zip(at, gaps, strict=True))))
    groups = u.groupBy(*by).agg(F.count_if("whole").alias("n_units"), F.count_if(~F.col("whole")).alias("n_incomplete"), F.array_join(lacking, ",").alias("missing_gaps"))
    groups = stored(groups.withColumn("grid_complete", F.col("missing_gaps") == ""), "groups")

    curve = _drawn_curve(long, by, unit, draws, seed)
    full = groups.where("grid_complete").select(*by)
    tested = curve.join(full, by, "left_semi")
    lower = first_loss(tested.where("ci_lower is not null"), by, "gap", "ci_lower", 0.0).select(*by, F.col("frontier").alias("statistical_frontier"), F.col("censoring").alias("statistical_censoring"))
    knee = two_line_break(tested, by, "gap", "mean").select(*by, F.col("brk").alias("breakpoint"), F.col("sse").alias("breakpoint_sse"))
    mean = frontier_interval(long.join(full, by, "left_semi"), by, unit, "gap", "v", gaps, draws, seed)
    mean = mean.select(*by, F.col("frontier_days").alias("mean_frontier"), F.col("censoring").alias("mean_censoring"), "ci_lower", "ci_upper", "left_censored", "right_censored")
    reason = F.when(F.col("n_units") == 0, "no whole curve").when(~F.col("grid_complete"), F.concat(F.lit("no value at gaps "), "missing_gaps"))
    out = groups.withColumn("reason", reason)
    for part in (lower, mean, knee):
        out = out.join(part, by, "left")
    return out, curve


def dual_frontiers(scored: DataFrame, by: list[str], unit: str, gap: str, skills: dict[str, str], gaps: list[int], draws: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The summary and curves for each denominator at once: ``skills`` names the column of each. A
    denominator is one more key of the groups, so all share the same scans and shuffles."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("denominator"), F.col(c).alias("skill")) for k, c in sorted(skills.items()))))
    long = scored.select(*by, unit, gap, each.alias("_s")).select(*by, unit, gap, "_s.*")
    return frontier_summary(long, ["denominator", *by], unit, gap, "skill", gaps, draws, seed)
