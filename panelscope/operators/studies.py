"""Studies on evaluation tables: frontiers, baselines, coalitions, failure sets, decisions, overlap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelscope.operators.analysis import first_loss


def curve_with_interval(units: DataFrame, by: list[str], gap: str, value: str) -> DataFrame:
    """Mean of each gap with a normal 95 % interval over units."""
    half = 1.96 * F.try_divide(F.stddev_samp(value), F.sqrt(F.count(value)))
    return units.groupBy(*by, gap).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.avg(value) - half).alias("ci_lower"), (F.avg(value) + half).alias("ci_upper"))


def statistical_frontier(curve: DataFrame, by: list[str], gap: str) -> DataFrame:
    """The first gap at which the lower bound of the interval is lost to zero."""
    return first_loss(curve.where(F.col("ci_lower").isNotNull()), by, gap, "ci_lower", 0.0)


def application_frontier(curve: DataFrame, by: list[str], gap: str, criteria: dict[str, tuple[str, float]]) -> DataFrame:
    """The shortest of the criteria's frontiers, and which criterion sets it (ties by name).
    ``criteria``: column -> ("<=" or ">=", limit)."""
    side = {"<=": lambda c, x: x - F.col(c), ">=": lambda c, x: F.col(c) - x}
    long = curve.select(*by, gap, F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), side[op](c, x).cast("double").alias("margin")) for c, (op, x) in sorted(criteria.items())))).alias("m")).select(*by, gap, "m.*")
    # at the limit itself a criterion still holds
    each = first_loss(long, [*by, "metric"], gap, "margin", -1e-12)
    return each.groupBy(*by).agg(F.min("frontier").alias("frontier"), F.min_by("metric", F.struct("frontier", "metric")).alias("limiting_metric"))


def best_baselines(events: DataFrame, family: list[str], model: str, gap: str, metric: str, order: list[str]) -> DataFrame:
    """The best of the simple models of each family: mean within a gap, then over gaps; ties in the given order."""
    means = events.where(F.col(model).isin(order)).groupBy(*family, model, gap).agg(F.avg(metric).alias("m")).groupBy(*family, model).agg(F.round(F.avg("m"), 9).alias("mean"))
    rank = F.array_position(F.lit(order), F.col(model))
    return means.groupBy(*family).agg(F.min_by(model, F.struct("mean", rank)).alias("best_model"), F.min("mean").alias("best_mean"))


def skill_over(events: DataFrame, best: DataFrame, keys: list[str], family: list[str], model: str, metric: str, climatology: str) -> DataFrame:
    """Skill against climatology and against the family's frozen best baseline on the same unit."""
    unit = events.groupBy(*keys, model).agg(F.avg(metric).alias("m"), F.avg(climatology).alias("c"))
    frozen = unit.join(best.select(*family, "best_model"), family)  # a row per family
    base = frozen.where(F.col(model) == F.col("best_model")).select(*keys, F.col("m").alias("b"))
    met = frozen.join(base, keys, "left")
    return met.select(*keys, model, "best_model", (1 - F.try_divide("m", "c")).alias("skill_climatology"), (1 - F.try_divide("m", "b")).alias("skill_best"))


def coalition_values(df: DataFrame, unit: list[str], mask: str, value: str, players: int) -> DataFrame:
    """One row per unit: coalitions seen, rows too many, rows without a number, and whether it is complete."""
    ok = F.col(value).isNotNull() & ~F.isnan(value)
    g = df.groupBy(*unit).agg(F.countDistinct(F.when(ok, F.col(mask))).alias("coalitions"), (F.count(F.lit(1)) - F.countDistinct(mask)).alias("duplicates"), F.count_if(~ok).alias("not_finite"))
    return g.withColumn("complete", (F.col("coalitions") == 2**players) & (F.col("duplicates") == 0) & (F.col("not_finite") == 0))


def contrasts_to_none(values: DataFrame, unit: list[str], mask: str, value: str, expected: int) -> DataFrame:
    """Each coalition's value against that of none, in units with the expected number of coalitions."""
    w = Window.partitionBy(*unit)
    v = values.withColumn("_none", F.max(F.when(F.col(mask) == 0, F.col(value))).over(w)).withColumn("_k", F.count(F.lit(1)).over(w))
    return v.where((F.col("_k") == expected) & (F.col(mask) > 0)).select(*unit, mask, (F.col(value) - F.col("_none")).alias("gain"))


def complete_units(df: DataFrame, unit: list[str], mask: str, sites: int) -> DataFrame:
    """Units with the sets of failed sites they lack, as text; empty for complete ones."""
    every = F.lit(list(range(2**sites))).cast("array<long>")
    g = df.groupBy(*unit).agg(F.collect_set(F.col(mask).cast("long")).alias("_s"))  # at most 2^sites numbers
    return g.select(*unit, F.size("_s").cast("long").alias("n_sets"), F.array_join(F.array_sort(F.array_except(every, "_s")).cast("array<string>"), ",").alias("missing"))


def resilience_curve(df: DataFrame, by: list[str], mask: str, value: str, sites: int) -> DataFrame:
    """Mean by number of failed sites, and relative to none failed (null unless that is positive)."""
    failed = F.bit_count(mask).cast("long")
    c = df.groupBy(*by, failed.alias("failed")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    ref = F.max(F.when(F.col("failed") == 0, F.col("mean"))).over(Window.partitionBy(*by))
    return c.select(*by, "failed", (F.col("failed") / sites).alias("fraction"), "n", "mean", F.when(ref > 0, F.col("mean") / ref).alias("relative"))


def role_differences(df: DataFrame, unit: list[str], by: list[str], role: str, a: str, b: str, value: str) -> DataFrame:
    """Paired difference of two roles within units: number, mean, median, standard error and 95 % interval."""
    side = lambda x: F.avg(F.when(F.col(role) == x, F.col(value)))
    d = df.groupBy(*by, *unit).agg((side(a) - side(b)).alias("d")).where("d is not null").withColumn("d", F.round("d", 9))
    se = F.stddev_samp("d") / F.sqrt(F.count("d"))
    g = d.groupBy(*by).agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.percentile("d", 0.5).alias("median"), se.alias("se"))
    return g.withColumn("ci_lower", F.col("mean") - 1.96 * F.col("se")).withColumn("ci_upper", F.col("mean") + 1.96 * F.col("se"))


def decision(contrasts: DataFrame, effect: str, p: str, level: float) -> DataFrame:
    """One row: how many contrasts hold, whether all point one way, and the verdict."""
    g = contrasts.agg(F.count(F.lit(1)).alias("contrasts"), F.count_if(F.col(p) < level).alias("significant"), F.count_if((F.col(p) < level) & (F.col(effect) > 0)).alias("positive"))
    verdict = F.when(F.col("significant") == 0, "no_evidence").when(F.col("positive") == F.col("significant"), "supported").when(F.col("positive") == 0, "contradicted").otherwise("mixed")
    return g.withColumn("verdict", verdict)


def criteria(df: DataFrame, checks: dict) -> DataFrame:
    """One row per named condition: rows it was asked of, rows that meet it, and whether all do."""
    g = df.agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(c).alias(k) for k, c in checks.items()))
    rows = g.select("_n", F.explode(F.map_from_arrays(F.lit(list(checks)), F.array(*(F.col(k) for k in checks)))).alias("criterion", "met"))
    return rows.select("criterion", F.col("_n").alias("asked"), "met", (F.col("met") == F.col("_n")).alias("passed"))


def grid_completeness(df: DataFrame, model: str, cell: list[str], value: str) -> DataFrame:
    """For each model: cells of all models' union that it has, lacks, repeats, or has without a value."""
    cells = df.select(*cell).distinct().agg(F.count(F.lit(1)).alias("expected"))
    per = df.groupBy(model, *cell).agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col(value).isNull()).alias("nulls"))
    g = per.groupBy(model).agg(F.count(F.lit(1)).alias("present"), F.count_if(F.col("k") > 1).alias("repeated"), F.sum("nulls").alias("nulls"))
    return g.crossJoin(F.broadcast(cells)).select(model, "expected", "present", (F.col("expected") - F.col("present")).alias("missing"), "repeated", "nulls")  # one row


def conflict_free_union(tables: list[DataFrame], key: list[str]) -> DataFrame:
    """The union of overlapping tables: equal rows once; keys whose rows disagree keep them all, marked."""
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    once = every.distinct()
    return once.withColumn("conflict", F.count(F.lit(1)).over(Window.partitionBy(*key)) > 1)


def covered_runs(daily: DataFrame, events: DataFrame, run: list[str]) -> DataFrame:
    """Event rows of runs that the daily table has too."""
    return events.join(daily.select(*run).distinct(), run, "left_semi")


def run_diagnostics(log: DataFrame, model: str, epoch: str, loss: str) -> DataFrame:
    """One row per model: epochs, best epoch and loss (the first of equal ones), whether all losses are numbers."""
    return log.groupBy(model).agg(F.max(epoch).alias("epochs"), F.min_by(epoch, F.struct(loss, epoch)).alias("best_epoch"), F.min(loss).alias("best_loss"), F.bool_and(F.col(loss).isNotNull() & ~F.isnan(loss)).alias("finite"))


def cell_overlaps(cells: DataFrame, name: str, cell: list[str]) -> DataFrame:
    """Pairs of gap sets that share a cell: shared cells, Jaccard index, overlap coefficient, sameness.
    The last column of ``cell`` may be a date: a set's cells of 64 days are then one word of bits, made
    before anything is shuffled. Cells with a null in ``cell`` are no cells."""
    c = cells.select(name, *cell).where(_known([name, *cell]))
    *keys, last = cell
    if dict(c.dtypes)[last] != "date":
        return _overlaps(c.select(name, *cell, F.lit(0).alias("_bin"), F.lit(1).cast("long").alias("_bits")), name, cell)
    day = F.unix_date(last)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), day.bitwiseAND(F.lit(63)))
    return _overlaps(c.groupBy(name, *keys, F.shiftright(day, 6).alias("_bin")).agg(F.bit_or(bit).alias("_bits")), name, keys)


def span_overlaps(spans: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """``cell_overlaps`` of sets given as spans (name, keys, start_date, end_date), one or more to a set,
    that may touch: no day becomes a row. A span that ends before it starts has no cells."""
    s = spans.select(name, *keys, F.unix_date("start_date").alias("_s"), F.unix_date("end_date").alias("_e")).where(_known([name, *keys])).where("_s <= _e")
    binned = s.withColumn("_bin", F.explode(F.sequence(F.shiftright("_s", 6), F.shiftright("_e", 6))))
    bits = F.expr("shiftleft(shiftrightunsigned(-1L, 63 - least(_e - 64 * _bin, 63) + greatest(_s - 64 * _bin, 0)), greatest(_s - 64 * _bin, 0))")
    return _overlaps(binned.select(name, *keys, "_bin", bits.alias("_bits")), name, keys)


def _known(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def _overlaps(words: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """The pairs of sets whose words (name, keys, _bin, _bits), none of them null, have a bit in common.
    Words are shuffled once, by the place they are of, and both sides of the pairs and the sizes read
    that. Spark takes the size of the table for theirs: the merge joins keep them from being broadcast."""
    at = [*keys, "_bin"]
    w = words.repartition(*at).groupBy(*at, name).agg(F.bit_or("_bits").alias("_bits"))
    size = w.groupBy(name).agg(F.sum(F.bit_count("_bits")).alias("n"))
    o = w.select(*at, F.col(name).alias("other"), F.col("_bits").alias("_other"))
    shared = F.bit_count(F.col("_bits").bitwiseAND(F.col("_other")))
    both = w.join(o.hint("merge"), at).where(F.col(name) < F.col("other")).select(name, "other", shared.alias("_k")).where("_k > 0")
    both = both.groupBy(name, "other").agg(F.sum("_k").alias("shared"))
    met = both.join(size.hint("merge"), name).join(size.select(F.col(name).alias("other"), F.col("n").alias("m")).hint("merge"), "other")
    s, n, m = F.col("shared"), F.col("n"), F.col("m")
    return met.select(name, "other", "shared", (s / (n + m - s)).alias("jaccard"), (s / F.least(n, m)).alias("overlap"), ((s == n) & (s == m)).alias("duplicate"))


def replication(clusters: DataFrame, by: list[str]) -> DataFrame:
    """Intervals, clusters, the largest cluster, and the effective number (sum squared over sum of squares)."""
    n = F.col("n_intervals")
    return clusters.groupBy(*by).agg(F.sum(n).alias("intervals"), F.count(F.lit(1)).alias("clusters"), F.max(n).alias("largest"), (F.sum(n) * F.sum(n) / F.sum(n * n)).alias("effective_n"))


def anchors_for(conditions: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """Conditions bound to their anchor by entity, variable and number; those without one are dropped."""
    return conditions.join(anchors, keys)


def station_summary(panel: DataFrame) -> DataFrame:
    """First and last day, variables, mean and least coverage of each entity."""
    s = panel.groupBy("entity", "variable").agg(F.min(F.when(F.col("observed"), F.col("ts"))).alias("lo"), F.max(F.when(F.col("observed"), F.col("ts"))).alias("hi"), F.avg(F.col("observed").cast("int")).alias("c"))
    return s.groupBy("entity").agg(F.min("lo").alias("first_day"), F.max("hi").alias("last_day"), F.array_join(F.array_sort(F.collect_set("variable")), ",").alias("variables"), F.avg("c").alias("mean_coverage"), F.min("c").alias("least_coverage"))
