"""The event catalogue: days, episodes and windows of each kind of event, and matched controls."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelscope.functions.sqlfn import SERIES, doy366, season, true_runs
from panelscope.operators import events
from panelscope.operators.design import local_threshold
from panelscope.operators.explore import merge_runs
from panelscope.operators.results import stable_id
from panelscope.operators.rules import circular_distance, overlap_class
from panelscope.sources.storage import stored


@dataclass(frozen=True)
class Kind:
    """An event: the quantile of a variable's measure that its days reach (or stay under), the least
    run of days, the days between runs that still make one episode, and a fixed window's length."""

    name: str
    variable: str
    quantile: float
    above: bool
    measure: str  # value, change from the day before, or anomaly from the time of year
    least: int
    merge: int
    window: int = 0


#: The declared events.
KINDS = (
    Kind("flood", "F", 0.90, True, "value", 1, 2, 15),
    Kind("high_temperature", "T", 0.90, True, "anomaly", 3, 2),
    Kind("low_flow", "F", 0.10, False, "value", 7, 0),
    Kind("rapid_warming", "T", 0.90, True, "change", 1, 0),
)
KEYS = ["entity", "event_type"]


def day_conditions(panel: DataFrame, kinds: tuple[Kind, ...], source: str, least: int = 30) -> DataFrame:
    """(entity, event_type, ts, value, ok, measure, threshold, threshold_n, event) for every day of
    each kind's series. ``ok``: observed in the source split. Thresholds are training quantiles of
    the measure, by season or around the time of year; null, and so no event, for fewer than
    ``least`` training days."""
    seasonal = [k for k in kinds if k.measure != "anomaly"]
    out = []
    changes = events.measures(panel).withColumn("season", season("ts"))
    for k in seasonal:
        p = changes.where(F.col("variable") == k.variable).withColumn("measure", F.when(F.col("observed"), F.col("value" if k.measure == "value" else "change")))
        q = p.where("split = 'train' and measure is not null").groupBy("entity", "season").agg(F.count(F.lit(1)).alias("threshold_n"), F.percentile("measure", k.quantile).alias("_q"))
        out.append((k, p.join(q, ["entity", "season"], "left").withColumn("threshold", F.when(F.col("threshold_n") >= least, F.col("_q")))))
    for k in kinds:
        if k.measure == "anomaly":
            p = panel.where(F.col("variable") == k.variable).withColumn("doy", doy366("ts"))
            q = local_threshold(p, k.quantile, least=least).select("entity", "doy", "mean", F.col("n").alias("threshold_n"), F.col("q").alias("threshold"))
            out.append((k, p.join(q, ["entity", "doy"], "left").withColumn("measure", F.when(F.col("observed"), F.col("value") - F.col("mean")))))
    ok = F.col("observed") & (F.col("split") == source)
    side = lambda k: F.col("measure") >= F.col("threshold") if k.above else F.col("measure") <= F.col("threshold")
    rows = [
        p.select("entity", F.lit(k.name).alias("event_type"), "ts", "value", ok.alias("ok"), "measure", "threshold", F.col("threshold_n").cast("long").alias("threshold_n"), F.coalesce(ok & side(k), F.lit(False)).alias("event"))
        for k, p in out
    ]
    return reduce(DataFrame.unionByName, rows)


def windows(days: DataFrame, kinds: tuple[Kind, ...]) -> DataFrame:
    """Episodes of ``day_conditions`` with the day of their extreme, their window and its centre."""
    out = []
    for k in kinds:
        d = days.where(F.col("event_type") == k.name)
        runs = merge_runs(true_runs(d, KEYS, "ts", "event").where(F.col("n_days") >= k.least), KEYS, k.merge)
        height = F.col("measure") - F.col("threshold") if k.measure == "anomaly" else F.col("measure")
        best = F.struct((height if k.above else -height).alias("h"), (-F.unix_date("ts")).alias("first"))
        met = runs.withColumn("ts", F.explode(F.sequence("start_date", "end_date"))).join(d.where("event"), [*KEYS, "ts"])
        e = met.groupBy(*KEYS, "start_date", "end_date", "n_runs").agg(F.max_by(F.struct("ts", "value", "measure", "threshold", "threshold_n"), best).alias("x"))
        size = F.datediff("end_date", "start_date") + 1
        first = F.date_sub("x.ts", k.window // 2) if k.window else F.col("start_date")
        out.append(
            e.select(
                *KEYS, F.lit(k.variable).alias("variable"), "start_date", "end_date", size.cast("long").alias("raw_length"), "n_runs", F.col("x.ts").alias("extreme_date"), F.col("x.value").alias("extreme_value"),
                (F.col("x.measure") - F.col("x.threshold") if k.above else F.col("x.threshold") - F.col("x.measure")).alias("intensity"), "x.threshold", "x.threshold_n", first.alias("window_start"),
                (F.lit(k.window) if k.window else size).cast("long").alias("window_length"), F.lit(bool(k.window)).alias("fixed_window"),
            )
        )
    e = reduce(DataFrame.unionByName, out)
    e = e.withColumn("window_end", F.expr("date_add(window_start, cast(window_length - 1 as int))"))
    e = e.withColumn("center", F.expr("date_add(window_start, cast((window_length - 1) div 2 as int))")).withColumn("season", season("center"))
    # only a fixed window has phases before and after the peak
    phase = lambda ok, c: F.when(F.col("fixed_window") & ok, c)
    rising, receding = F.col("start_date") < F.col("extreme_date"), F.col("extreme_date") < F.col("end_date")
    e = e.withColumns({"rising_start": phase(rising, F.col("start_date")), "rising_end": phase(rising, F.date_sub("extreme_date", 1)), "recession_start": phase(receding, F.date_add("extreme_date", 1)), "recession_end": phase(receding, F.col("end_date"))})
    return e.drop("fixed_window")


def _ahead(ok: Column) -> Column:
    """Days in a row, from this one on, on which ``ok`` holds; the calendar is complete."""
    w = Window.partitionBy(*KEYS).orderBy("ts")
    onward, whole = w.rowsBetween(Window.currentRow, Window.unboundedFollowing), Window.partitionBy(*KEYS)
    stop = F.min(F.when(~ok, F.col("ts"))).over(onward)
    return F.datediff(F.coalesce(stop, F.date_add(F.max("ts").over(whole), 1)), "ts")


def control_candidates(days: DataFrame, episodes: DataFrame, around: int) -> DataFrame:
    """(entity, event_type, start_date, nth, control_start, rank): for each episode the days from
    which a window of its length, centred in its season, and ``around`` days on either side are
    wholly observed, with no event day in the window and none of any episode's window. Nearest in
    years first, then in the time of year, then in days, then the earlier.

    ``nth`` is the episode's turn among those of its length and season. An earlier turn takes one
    candidate at most, so an episode's first ``nth`` candidates are all it can ever need.
    """
    taken = episodes.select(*KEYS, F.explode(F.sequence("window_start", "window_end")).alias("ts")).distinct().withColumn("_taken", F.lit(True))
    d = days.join(taken, [*KEYS, "ts"], "left").withColumn("_clear", F.col("ok") & ~F.col("event") & F.col("_taken").isNull())
    w = Window.partitionBy(*KEYS).orderBy("ts")
    d = d.withColumns({"_core": _ahead(F.col("_clear")), "_near": _ahead(F.col("ok"))}).withColumn("_near", F.lag("_near", around).over(w) if around else F.col("_near"))
    starts = d.where("_core > 0 and _near is not null").select(*KEYS, F.col("ts").alias("control_start"), "_core", "_near")
    lengths = episodes.select(*KEYS, "window_length").distinct()
    s = starts.join(lengths, KEYS).where(f"_core >= window_length and _near >= window_length + {2 * around}").drop("_core", "_near")
    s = s.withColumn("control_center", F.expr("date_add(control_start, cast((window_length - 1) div 2 as int))")).withColumn("season", season("control_center"))
    group = [*KEYS, "window_length", "season"]
    turn = F.row_number().over(Window.partitionBy(*group).orderBy("start_date"))
    met = episodes.select(*group, "start_date", "center", turn.alias("nth")).join(s, group)
    by = [F.abs(F.year("center") - F.year("control_center")), circular_distance(doy366("center"), doy366("control_center")), F.abs(F.datediff("center", "control_center")), F.col("control_start")]
    rank = F.row_number().over(Window.partitionBy(*KEYS, "start_date").orderBy(*by))
    return met.withColumn("rank", rank).where("rank <= nth").select(*group, "start_date", "nth", "rank", "control_start")


def matched_in_turn(candidates: DataFrame, pool: list[str], item: str, choice: str) -> DataFrame:
    """(pool, item, choice): each item takes the best choice that no item before it (``nth``) takes.

    In rounds over all pools at once: every item asks for its next candidate by ``rank``, each
    choice keeps the first in turn that ever asks for it, and who loses one asks for the next. As
    all choices go by the same turns, this ends where taking turns one by one does. An item whose
    candidates run out has no row.
    """
    ranked = stored(candidates.select(*pool, item, "nth", "rank", choice), "ranked")
    asking = stored(ranked.where("rank = 1").select(*pool, item, "rank"), "asking")
    while True:
        asked = ranked.join(asking, [*pool, item, "rank"])
        first = F.min("nth").over(Window.partitionBy(*pool, choice))
        now = stored(asked.withColumn("_lost", F.col("nth") > first), "asked")
        if now.where("_lost").isEmpty():
            return now.select(*pool, item, choice)
        asking = stored(now.select(*pool, item, (F.col("rank") + F.col("_lost").cast("int")).alias("rank")), "asking")


def event_catalogue(panel: DataFrame, kinds: tuple[Kind, ...], source: str, around: int = 1, least: int = 30) -> DataFrame:
    """One row for each episode of the source split: its window, extreme, phases and surroundings,
    its matched control of the same entity, kind, season and length (no two episodes of a kind and
    entity share one; null where there is none), and ids."""
    days = stored(day_conditions(panel, kinds, source, least), "days")
    found = stored(windows(days, kinds), "windows")
    plain = days.select("entity", F.col("event_type").alias("variable"), "ts", F.col("ok").alias("observed"))
    named = found.select("entity", F.col("event_type").alias("variable"), F.col("start_date").alias("raw_start"), F.col("window_start").alias("start_date"), F.col("window_end").alias("end_date"))
    around_it = events.context(named, plain, around).select("entity", F.col("variable").alias("event_type"), F.col("raw_start").alias("start_date"), "window_ok", "left_ok", "right_ok", "reasons")
    pool = [*KEYS, "window_length", "season"]
    controls = matched_in_turn(control_candidates(days, found, around), pool, "start_date", "control_start")
    out = found.join(around_it, [*KEYS, "start_date"], "left").join(controls, [*pool, "start_date"], "left")
    out = out.withColumn("eligible", F.col("window_ok") & F.col("left_ok") & F.col("right_ok"))
    out = out.withColumn("control_end", F.expr("date_add(control_start, cast(window_length - 1 as int))"))
    out = out.withColumn("event_id", stable_id("event", *KEYS, "start_date", "end_date", "window_start", "window_end"))
    return out.withColumn("pair_id", F.when(F.col("control_start").isNotNull(), stable_id("pair", "event_id", "control_start", "control_end")))


def audit_catalogue(stored_rows: DataFrame, panel: DataFrame, kinds: tuple[Kind, ...], source: str, around: int = 1, least: int = 30) -> DataFrame:
    """(check, rows): a stored catalogue against one made anew from the panel, row by row, and
    against its own rules: rows that only one of them has, shared or repeated controls, controls
    of another season or length, and controls that meet a window of their kind."""
    fresh = stored(event_catalogue(panel, kinds, source, around, least), "fresh")
    held = stored(stored_rows.select(*fresh.columns), "held")
    c = held.where("control_start is not null")
    center = F.expr("date_add(control_start, cast((window_length - 1) div 2 as int))")
    days = c.select(*KEYS, "start_date", F.explode(F.sequence("control_start", "control_end")).alias("ts")).join(held.select(*KEYS, F.explode(F.sequence("window_start", "window_end")).alias("ts")), [*KEYS, "ts"])
    checks = {
        "only_stored": held.exceptAll(fresh),
        "only_regenerated": fresh.exceptAll(held),
        "repeated_event": held.groupBy("event_id").count().where("count > 1"),
        "shared_control": c.groupBy(*KEYS, "control_start", "control_end").count().where("count > 1"),
        "other_season": c.where(season(center) != F.col("season")),
        "other_length": c.where("datediff(control_end, control_start) + 1 <> window_length"),
        "control_meets_event": days.select(*KEYS, "start_date").distinct(),
    }
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(k).alias("check"), "rows") for k, df in checks.items()]
    return reduce(DataFrame.unionByName, counts)


def overlap_clusters(rows: DataFrame, keys: list[str], item: str, out: str) -> DataFrame:
    """``rows`` with ``out`` and ``out_size``: groups of windows linked by shared days, within keys
    or, without any, over all. Days covered by any window form islands, and two windows are linked,
    directly or through others, just if they lie on one island: nothing is paired. A group is
    named by its keys and first day."""
    covered = rows.select(*keys, F.explode(F.sequence("window_start", "window_end")).alias("ts")).distinct()
    if keys:
        lands = true_runs(covered, keys, "ts", "true")
    else:  # one row a day of the calendar, whatever the number of windows
        lands = true_runs(covered.withColumn("_k", F.lit(1)), ["_k"], "ts", "true").drop("_k")
    days = lands.select(*keys, F.col("start_date").alias("_from"), F.explode(F.sequence("start_date", "end_date")).alias("_day"))
    met = rows.withColumn("_day", F.col("window_start")).join(days, [*keys, "_day"]).drop("_day")
    name = F.concat_ws("|", *keys, F.col("_from").cast("string"))
    size = F.count(F.lit(1)).over(Window.partitionBy(out))
    return met.withColumn(out, name).drop("_from").withColumn(f"{out}_size", size)


def with_clusters(catalogue: DataFrame) -> DataFrame:
    """The catalogue with its overlap clusters at three grains: all, entity, entity and kind."""
    for keys, out in (([], "cluster"), (["entity"], "entity_cluster"), (KEYS, "kind_cluster")):
        catalogue = overlap_clusters(catalogue, keys, "event_id", out)
    return catalogue


def overlap_graph(rows: DataFrame, bin_days: int = 32) -> DataFrame:
    """(left_id, right_id, overlap_days, jaccard, overlap_class) for every two windows that share a
    day; they meet in the bin of days in which the later one starts."""
    w = rows.select("event_id", "entity", "event_type", "window_start", "window_end")
    at = lambda c: F.floor(F.unix_date(c) / bin_days)
    spread = w.select("*", F.explode(F.sequence(at("window_start"), at("window_end"))).alias("bin"))
    a, b = (spread.select("bin", *(F.col(c).alias(f"{s}_{c}") for c in w.columns)) for s in "ab")
    first = F.greatest("a_window_start", "b_window_start")
    met = a.join(b, "bin").where((F.col("a_event_id") < F.col("b_event_id")) & (first <= F.least("a_window_end", "b_window_end")) & (at(first) == F.col("bin")))
    days = lambda x, y: F.datediff(y, x) + 1
    shared = days(first, F.least("a_window_end", "b_window_end"))
    union = days("a_window_start", "a_window_end") + days("b_window_start", "b_window_end") - shared
    kind = overlap_class(F.col("a_entity") == F.col("b_entity"), F.col("a_event_type") == F.col("b_event_type"), F.col("a_event_type"))
    return met.select(F.col("a_event_id").alias("left_id"), F.col("b_event_id").alias("right_id"), shared.cast("long").alias("overlap_days"), (shared / union).alias("jaccard"), kind.alias("overlap_class"))


#: Strata of fewer pairs are described, not tested.
LEAST_PAIRS = 5


def matching_balance(catalogue: DataFrame, panel: DataFrame) -> DataFrame:
    """Events against their controls overall, by entity, kind and season, and by length within that
    (absent keys are null): numbers, whether matched one to one, distances in years and in the time
    of year, controls that abut their event, and the standardised difference of the variable's
    window means."""
    c = catalogue.withColumn("control_center", F.expr("date_add(control_start, cast((window_length - 1) div 2 as int))"))
    gap = F.when(F.col("window_end") < F.col("control_start"), F.datediff("control_start", "window_end") - 1).when(F.col("control_end") < F.col("window_start"), F.datediff("window_start", "control_end") - 1).otherwise(-1)
    c = c.withColumns({"_years": F.abs(F.year("center") - F.year("control_center")), "_days": circular_distance(doy366("center"), doy366("control_center")), "_abut": F.when(F.col("control_start").isNotNull(), gap == 0)})
    values = panel.where("value is not null").select("entity", "variable", "ts", "value")
    spans = c.where("control_start is not null").select("event_id", "entity", "variable", F.explode(F.array(F.struct(F.lit("event").alias("role"), F.col("window_start").alias("a"), F.col("window_end").alias("z")), F.struct(F.lit("control").alias("role"), F.col("control_start").alias("a"), F.col("control_end").alias("z")))).alias("s"))
    mean = lambda role: F.avg(F.when(F.col("role") == role, F.col("value")))
    means = spans.select("event_id", "entity", "variable", "s.role", F.explode(F.sequence("s.a", "s.z")).alias("ts")).join(values, ["entity", "variable", "ts"]).groupBy("event_id").agg(mean("event").alias("_e"), mean("control").alias("_c"))
    c = c.join(means, "event_id", "left").withColumn("_ok", F.col("_e").isNotNull() & F.col("_c").isNotNull())
    e, k = (F.when(F.col("_ok"), F.col(x)) for x in ("_e", "_c"))
    spread = F.sqrt((F.var_samp(e) + F.var_samp(k)) / 2)
    grains = [[], ["entity", "event_type", "season"], ["entity", "event_type", "season", "window_length"]]
    by = grains[-1]
    long = c.select("*", F.explode(F.array(*(F.struct(*(F.col(b).alias(b) if b in g else F.lit(None).cast(dict(c.dtypes)[b]).alias(b) for b in by), F.lit(i).alias("grain")) for i, g in enumerate(grains)))).alias("_g")).drop(*by).select("*", "_g.*")
    g = long.groupBy("grain", *by).agg(
        F.countDistinct("event_id").alias("n_events"), F.countDistinct("pair_id").alias("n_controls"), F.count(F.lit(1)).alias("n_pairs"), F.count_if("eligible").alias("n_eligible"), F.avg("_years").alias("mean_year_distance"), F.avg("_days").alias("mean_day_distance"), F.max("_days").cast("long").alias("max_day_distance"),
        F.count_if("_abut").alias("abutting"), F.when((F.count(e) >= 2) & (spread > 0), (F.avg(e) - F.avg(k)) / spread).alias("smd"),
    )
    one = (F.col("n_events") == F.col("n_pairs")) & (F.col("n_controls") == F.col("n_pairs"))
    return g.withColumns({"matched_one_to_one": one, "status": F.when(F.col("n_eligible") < LEAST_PAIRS, "descriptive_only").otherwise("testable")}).withColumn("grain", F.col("grain").cast("long"))


def effective_sizes(clustered: DataFrame) -> DataFrame:
    """By scope (all, entity, entity and kind; absent keys null): episodes, clusters, which are the
    effective number, clusters of several, the largest, and days covered."""
    out = []
    for i, (keys, c) in enumerate((([], "cluster"), (["entity"], "entity_cluster"), (KEYS, "kind_cluster"))):
        days = clustered.select(*keys, F.explode(F.sequence("window_start", "window_end")).alias("ts")).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("days"))
        each = clustered.groupBy(*keys, c).agg(F.count(F.lit(1)).alias("_n"))
        g = each.groupBy(*keys).agg(F.sum("_n").alias("episodes"), F.count(F.lit(1)).alias("effective_n"), F.count_if(F.col("_n") > 1).alias("several"), F.max("_n").alias("largest"))
        g = g.join(days, keys) if keys else g.crossJoin(F.broadcast(days))  # one row each
        out.append(g.select(F.lit(i).cast("long").alias("scope"), *(F.col(k) if k in keys else F.lit(None).cast("string").alias(k) for k in KEYS), "episodes", "effective_n", "several", "largest", "days"))
    return reduce(DataFrame.unionByName, out)


def strata_coverage(catalogue: DataFrame, kinds: tuple[Kind, ...]) -> DataFrame:
    """Every entity with every kind and season: pairs, eligible ones, and whether the stratum is
    missing, too small to test, or testable."""
    grid = catalogue.select("entity").distinct().withColumn("event_type", F.explode(F.lit([k.name for k in kinds]))).withColumn("season", F.explode(F.lit(["DJF", "MAM", "JJA", "SON"])))
    n = catalogue.groupBy(*KEYS, "season").agg(F.count(F.lit(1)).alias("_n"), F.count_if("eligible").alias("_e"))
    g = grid.join(n, [*KEYS, "season"], "left").withColumns({"n_pairs": F.coalesce("_n", F.lit(0)), "n_eligible": F.coalesce("_e", F.lit(0))}).drop("_n", "_e")
    return g.withColumn("status", F.when(F.col("n_pairs") == 0, "missing").when(F.col("n_eligible") < LEAST_PAIRS, "descriptive_only").otherwise("testable"))
