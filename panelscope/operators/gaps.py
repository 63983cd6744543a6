"""Events, anchors and gap injection: exact counts by hash rank, so every run draws the same cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelscope.functions.sqlfn import SERIES, hash_rank, season, true_runs
from panelscope.operators.explore import block_starts, merge_runs
from panelscope.sources.storage import stored


def season_thresholds(panel: DataFrame, quantile: float, least: int = 30) -> DataFrame:
    """Training quantile by series and season; too few samples give null."""
    t = panel.where("split = 'train' and value is not null").withColumn("season", season("ts"))
    g = t.groupBy(*SERIES, "season").agg(F.count(F.lit(1)).alias("n"), F.percentile("value", quantile).alias("q"))
    return g.select(*SERIES, "season", "n", F.when(F.col("n") >= least, F.col("q")).alias("threshold"))


def episodes(panel: DataFrame, quantile: float, least: int, merge: int) -> DataFrame:
    """Runs of at least ``least`` days above the season's threshold, joined if at most ``merge``
    days apart, with the day and value of the (first) peak."""
    hot = panel.withColumn("season", season("ts")).join(season_thresholds(panel, quantile), [*SERIES, "season"]).where("value > threshold")
    runs = merge_runs(true_runs(hot, SERIES, "ts", "true").where(F.col("n_days") >= least), SERIES, merge)
    days = hot.select(F.col("entity").alias("_e"), F.col("variable").alias("_v"), "ts", "value")
    # a run's days as rows: an equi-join instead of a range join
    spread = runs.withColumn("day", F.explode(F.sequence("start_date", "end_date")))
    met = spread.join(days, (spread["entity"] == days["_e"]) & (spread["variable"] == days["_v"]) & (spread["day"] == days["ts"]))
    first = F.max_by("ts", F.struct("value", -F.unix_date("ts")))
    return met.groupBy(*SERIES, "start_date", "end_date", "n_runs", "n_days").agg(F.max("value").alias("peak"), first.alias("peak_date"))


def point_gaps(panel: DataFrame, rate: float, seed: int) -> DataFrame:
    """Exactly floor(n * rate + 0.5) observed cells of each series, by hash rank."""
    key = hash_rank(F.lit(seed), "entity", "variable", "ts")
    w = Window.partitionBy(*SERIES)
    ranked = panel.where("observed").withColumn("_k", F.row_number().over(w.orderBy(key))).withColumn("_n", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("_k") <= F.floor(F.col("_n") * rate + 0.5)).select(*SERIES, "ts")


def nested_points(panel: DataFrame, rates: list[float], seed: int) -> DataFrame:
    """One ranking for all rates: a higher rate hides a superset. Seasons take turns."""
    key = hash_rank(F.lit(seed), "entity", "variable", "ts")
    w = Window.partitionBy(*SERIES)
    ranked = panel.where("observed").withColumn("season", season("ts")).withColumn("_in", F.row_number().over(Window.partitionBy(*SERIES, "season").orderBy(key)))
    ranked = ranked.withColumn("_k", F.row_number().over(w.orderBy("_in", "season"))).withColumn("_n", F.count(F.lit(1)).over(w))
    return ranked.withColumn("rate", F.explode(F.lit(rates))).where(F.col("_k") <= F.floor(F.col("_n") * F.col("rate") + 0.5)).select(*SERIES, "rate", "ts")


def block_gaps(panel: DataFrame, length: int, seed: int) -> DataFrame:
    """(series, start_date, end_date): one fully observed block each, chosen by hash."""
    starts = block_starts(panel, length)
    w = Window.partitionBy(*SERIES).orderBy(hash_rank(F.lit(seed), "entity", "variable", "ts"))
    one = starts.withColumn("_k", F.row_number().over(w)).where("_k = 1")
    return one.select(*SERIES, F.col("ts").alias("start_date"), F.date_add("ts", length - 1).alias("end_date"))


def outage_gaps(panel: DataFrame, length: int, seed: int) -> DataFrame:
    """One block per entity on which all its variables are observed; hides them all."""
    n = panel.groupBy("entity").agg(F.countDistinct("variable").alias("_all"))
    joint = block_starts(panel, length).groupBy("entity", "ts").agg(F.count(F.lit(1)).alias("_n")).join(n, "entity").where("_n = _all")
    w = Window.partitionBy("entity").orderBy(hash_rank(F.lit(seed), "entity", "ts"))
    one = joint.withColumn("_k", F.row_number().over(w)).where("_k = 1")
    return one.select("entity", F.col("ts").alias("start_date"), F.date_add("ts", length - 1).alias("end_date"))


def block_cells(blocks: DataFrame) -> DataFrame:
    return blocks.select(*[c for c in SERIES if c in blocks.columns], F.explode(F.sequence("start_date", "end_date")).alias("ts"))


def anchors(panel: DataFrame, length: int, k: int, seed: int) -> DataFrame:
    """Up to ``k`` centres per series and season whose whole block is observed, and how many the
    season falls short; a season without any has no row."""
    centre = F.date_add("ts", (length - 1) // 2)
    c = block_starts(panel, length).select(*SERIES, centre.alias("center_date")).withColumn("season", season("center_date"))
    of = Window.partitionBy(*SERIES, "season")
    w = of.orderBy(hash_rank(F.lit(seed), "entity", "variable", "center_date"))
    short = F.greatest(F.lit(k) - F.count(F.lit(1)).over(of), F.lit(0)).cast("long")
    return c.withColumns({"anchor_no": F.row_number().over(w), "shortfall": short}).where(F.col("anchor_no") <= k)


def hide(panel: DataFrame, cells: DataFrame) -> DataFrame:
    """``truth`` keeps the value; ``value`` is null on hidden cells, which ``hidden`` marks."""
    keys = [c for c in (*SERIES, "ts") if c in cells.columns]
    marked = panel.join(cells.select(*keys).distinct().withColumn("_h", F.lit(True)), keys, "left")
    hidden = F.coalesce("_h", F.lit(False))
    return marked.withColumn("hidden", hidden).withColumn("truth", F.col("value")).withColumn("value", F.when(~F.col("hidden"), F.col("value"))).drop("_h")


def mask_metadata(panel: DataFrame) -> DataFrame:
    g = panel.groupBy(*SERIES).agg(F.count_if("observed").alias("eligible_cells"), F.count_if(F.col("hidden") & F.col("observed")).alias("masked_cells"), F.count_if(F.col("hidden") & ~F.col("observed")).alias("outside"))
    return g.withColumn("masked_rate", F.try_divide("masked_cells", "eligible_cells"))


def training_layout(panel: DataFrame, lengths: list[int], seed: int, repeats: int = 1) -> DataFrame:
    """(series, part, length, start_date, end_date): gaps of all lengths, each ``repeats`` times, one
    observed day apart, in an order drawn by hash, end to end from a start drawn by hash among
    those at which the whole span is observed. A series without such a span has its gaps placed
    one by one, the longest first, each at the hash-first start that stays a day off the others;
    one that cannot take them all has none.
    """
    every = sorted([n for n in lengths for _ in range(repeats)], reverse=True)
    span = sum(every) + len(every) - 1
    one = Window.partitionBy(*SERIES)
    start = block_starts(panel, span).withColumn("_k", F.row_number().over(one.orderBy(hash_rank(F.lit(str(seed)), *SERIES, "ts")))).where("_k = 1").select(*SERIES, F.col("ts").alias("_from"))
    parts = start.select(*SERIES, "_from", F.posexplode(F.lit(every)).alias("_i", "length"))
    order = one.orderBy(hash_rank(F.lit(str(seed)), *SERIES, "_i"))
    before = F.coalesce(F.sum(F.col("length") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    laid = parts.withColumns({"part": F.row_number().over(order) - 1, "start_date": F.date_add("_from", before)}).select(*SERIES, F.col("part").cast("long").alias("part"), F.col("length").cast("long").alias("length"), "start_date")

    rest = panel.select(*SERIES).distinct().join(start, SERIES, "left_anti")
    sparse, taken = panel.join(rest, SERIES, "left_semi"), None
    for i, n in enumerate(every):  # as many steps as there are gaps in a layout
        s = block_starts(sparse, n).select(*SERIES, "ts")
        if taken is not None:
            near = taken.select(*SERIES, F.explode(F.sequence(F.date_sub("start_date", n), F.expr("date_add(start_date, cast(length as int))"))).alias("ts"))
            s = s.join(near.distinct(), [*SERIES, "ts"], "left_anti")
        s = s.withColumn("_k", F.row_number().over(one.orderBy(hash_rank(F.lit(str(seed)), *SERIES, F.lit(str(i)), "ts")))).where("_k = 1")
        s = s.select(*SERIES, F.lit(i).cast("long").alias("part"), F.lit(n).cast("long").alias("length"), F.col("ts").alias("start_date"))
        taken = stored(s if taken is None else taken.unionByName(s), "layout")
    whole = taken.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(every)).select(*SERIES)
    out = laid.unionByName(taken.join(whole, SERIES, "left_semi"))
    return out.withColumn("end_date", F.expr("date_add(start_date, cast(length - 1 as int))"))
