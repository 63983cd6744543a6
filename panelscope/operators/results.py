"""Result tables: keys and labels, reconciliation, curves, contrasts, information and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def horizon_label(days) -> Column:
    d = F.col(days) if isinstance(days, str) else days
    w = F.when(d.isNull() | (d < 1), "no_history").when(d == 1, "1").when(d <= 3, "2-3").when(d <= 7, "4-7").when(d <= 30, "8-30").when(d <= 90, "31-90")
    return w.otherwise("91+")


def parse_failed_sites(text: str) -> Column:
    """Sorted distinct sites of a delimited or JSON text; ``none`` and ``full_network`` are empty."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\[\]\"]", "")
    sites = F.filter(F.split(t, r"[,;|+\s]+"), lambda x: (x != "") & ~F.lower(x).isin("none", "full_network"))
    return F.array_sort(F.array_distinct(sites))


def failure_class(sites, total: int) -> Column:
    n = F.size(sites)
    return F.when(n == 0, "none").when(n == total, "full").when(n == 1, "single").when(n == 2, "double").otherwise("multiple")


def family_key(*cols: str) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("default")) for c in cols])


def stable_id(prefix: str, *cols: str) -> Column:
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]), 256), 1, 16))


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose counts differ between two tables, or that one of them lacks."""
    x, y = a.select(*keys, F.col(value).alias("expected")), b.select(*keys, F.col(value).alias("actual"))
    return x.join(y, keys, "full_outer").where(~F.col("expected").eqNullSafe(F.col("actual")))


def with_baseline(df: DataFrame, keys: list[str], model: str, baseline: str, metric: str) -> DataFrame:
    """The baseline model's metric on every other model's row of the same unit."""
    base = df.where(F.col(model) == baseline).groupBy(*keys).agg(F.avg(metric).alias("baseline"))
    return df.where(F.col(model) != baseline).join(base, keys, "left")


def pivot_models(df: DataFrame, keys: list[str], model: str, names: list[str], metric: str) -> DataFrame:
    return df.groupBy(*keys).pivot(model, names).agg(F.avg(metric))


def discretise(df: DataFrame, by: list[str], value: str, bins: int) -> DataFrame:
    """Quantile bin of each value: how many distinct edges strictly inside the range lie at or
    below it. At most ``bins`` distinct values are numbered in their order instead."""
    edges = F.percentile(value, F.array(*[F.lit(i / bins) for i in range(1, bins)]))
    g = df.groupBy(*by).agg(F.array_distinct(edges).alias("_e"), F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.countDistinct(value).alias("_d"))
    met = df.join(g, by).withColumn("_o", F.dense_rank().over(Window.partitionBy(*by).orderBy(value)) - 1)
    inside = F.size(F.filter("_e", lambda x: (x > F.col("_lo")) & (x < F.col("_hi")) & (x <= F.col(value))))
    return met.withColumn("bin", F.when(F.col("_d") <= bins, F.col("_o")).otherwise(inside).cast("long")).drop("_e", "_lo", "_hi", "_d", "_o")


def transfer_entropy(df: DataFrame, by: list[str], x: str, y: str, order: str, lag: int) -> DataFrame:
    """Information of x, ``lag`` rows earlier, about y beyond y's own past, in nats, by counting."""
    w = Window.partitionBy(*by).orderBy(order)
    t = df.select(*by, F.col(y).alias("y"), F.lag(y).over(w).alias("p"), F.lag(x, lag).over(w).alias("s")).where("y is not null and p is not null and s is not null")
    n = lambda *c: F.sum("n").over(Window.partitionBy(*by, *c))
    c = t.groupBy(*by, "y", "p", "s").agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("ps", n("p", "s")).withColumn("yp", n("y", "p")).withColumn("pp", n("p")).withColumn("all", n())
    return c.groupBy(*by).agg(F.sum("n").alias("n"), F.greatest(F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("pp") / (F.col("ps") * F.col("yp")))), F.lit(0.0)).alias("te"))


def mann_kendall(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """S, its tie-corrected variance and z; one point per x, series short enough to pair."""
    o = df.select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    s = df.join(o, by).where(F.col(x) < F.col("_x")).groupBy(*by).agg(F.sum(F.signum(F.col("_y") - F.col(y))).cast("long").alias("s"))
    t = df.groupBy(*by, y).agg(F.count(F.lit(1)).alias("t")).groupBy(*by).agg(F.sum("t").alias("n"), F.sum(F.col("t") * (F.col("t") - 1) * (2 * F.col("t") + 5)).alias("tie"))
    n, v = F.col("n"), F.col("var_s")
    r = s.join(t, by).withColumn("var_s", (n * (n - 1) * (2 * n + 5) - F.col("tie")) / F.lit(18.0))
    return r.select(*by, "n", "s", "var_s", F.when(v > 0, (F.col("s") - F.signum(F.col("s").cast("double"))) / F.sqrt(v)).alias("z"))


def two_line_break(curve: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """The x at which two lines that both hold it (two points each at least) have the least squared
    error, the first of equal ones, with both slopes. One point per x."""
    cand = curve.select(*by, F.col(x).alias("brk")).distinct()
    sides = F.explode(F.array_compact(F.array(F.when(F.col(x) <= F.col("brk"), "left"), F.when(F.col(x) >= F.col("brk"), "right"))))
    m = curve.join(cand, by).withColumn("_side", sides)
    g = m.groupBy(*by, "brk", "_side").agg(F.count(F.lit(1)).alias("n"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("c")).where("n >= 2")
    g = g.withColumns({"sse": F.col("n") * (F.col("vy") - F.try_divide(F.col("c") * F.col("c"), F.col("vx"))), "slope": F.try_divide("c", "vx")})
    slope = lambda s: F.max(F.when(F.col("_side") == s, F.col("slope")))
    both = g.groupBy(*by, "brk").agg(F.count(F.lit(1)).alias("k"), F.round(F.sum("sse"), 9).alias("sse"), slope("left").alias("left_slope"), slope("right").alias("right_slope")).where("k = 2")
    w = Window.partitionBy(*by).orderBy("sse", "brk")
    return both.withColumn("_i", F.row_number().over(w)).where("_i = 1").select(*by, "brk", "sse", "left_slope", "right_slope")


def raw_first_loss(curve: DataFrame, by: list[str], gap: str, skill: str, threshold: float) -> DataFrame:
    """The first gap not above the threshold, and whether a later one is above it again."""
    lost = F.when(F.col(skill) <= threshold, F.col(gap))
    first = F.min(lost).over(Window.partitionBy(*by))
    c = curve.withColumn("_f", first)
    return c.groupBy(*by).agg(F.min("_f").alias("first_loss"), F.coalesce(F.max((F.col(gap) > F.col("_f")) & (F.col(skill) > threshold)), F.lit(False)).alias("reversal"))


def pass_prefix(df: DataFrame, by: list[str], gap: str, ok: str) -> DataFrame:
    """The last gap of the initial stretch that passes everywhere; null if the first fails."""
    w = Window.partitionBy(*by).orderBy(gap).rowsBetween(Window.unboundedPreceding, 0)
    g = df.groupBy(*by, gap).agg(F.bool_and(ok).alias("_ok")).withColumn("_all", F.min(F.col("_ok").cast("int")).over(w))
    return g.groupBy(*by).agg(F.max(F.when(F.col("_all") == 1, F.col(gap))).alias("boundary"), F.min(F.when(F.col("_all") == 0, F.col(gap))).alias("first_fail"))


def coalition_gains(values: DataFrame, by: list[str], mask: str, value: str, players: int) -> DataFrame:
    """Of each player: what it adds alone, and what the full set loses without it."""
    v = values.withColumn("player", F.explode(F.sequence(F.lit(0), F.lit(players - 1)))).withColumn("_bit", F.pow(F.lit(2), F.col("player")).cast("long"))
    at = lambda m: F.max(F.when(m, F.col(value)))
    full = (1 << players) - 1
    g = v.groupBy(*by, "player").agg(at(F.col(mask) == 0).alias("none"), at(F.col(mask) == F.col("_bit")).alias("alone"), at(F.col(mask) == full).alias("all"), at(F.col(mask) == full - F.col("_bit")).alias("without"))
    return g.select(*by, "player", (F.col("alone") - F.col("none")).alias("first_gain"), (F.col("all") - F.col("without")).alias("last_gain"))


def pair_interactions(values: DataFrame, by: list[str], mask: str, value: str, players: int) -> DataFrame:
    """v(ij) - v(i) - v(j) + v(0) of every pair of players."""
    pairs = [(i, j) for i in range(players) for j in range(i + 1, players)]
    at = lambda m: F.max(F.when(F.col(mask) == m, F.col(value)))
    g = values.groupBy(*by).agg(*(at((1 << i) + (1 << j)).alias(f"p{i}{j}") for i, j in pairs), *(at(1 << i).alias(f"s{i}") for i in range(players)), at(0).alias("e"))
    rows = F.array(*[F.struct(F.lit(f"{i}{j}").alias("pair"), (F.col(f"p{i}{j}") - F.col(f"s{i}") - F.col(f"s{j}") + F.col("e")).alias("interaction")) for i, j in pairs])
    return g.select(*by, F.explode(rows).alias("r")).select(*by, "r.pair", "r.interaction")


def node_importance(df: DataFrame, by: list[str], node: str, value: str, none: str) -> DataFrame:
    """What the mean loses when one node fails, against no failure."""
    m = df.groupBy(*by, node).agg(F.avg(value).alias("m"))
    ref = m.where(F.col(node) == none).select(*by, F.col("m").alias("reference"))
    return m.where(F.col(node) != none).join(ref, by).select(*by, node, (F.col("m") - F.col("reference")).alias("importance"))


def date_coverage(iv: DataFrame, width: int = 32) -> DataFrame:
    """Each day that an entity's intervals cover: how many, and which. Intervals are shuffled by bins
    of ``width`` days, and the days of a bin are made after the shuffle."""
    ends = [F.unix_date(c) for c in ("start_date", "end_date")]
    a = iv.where("start_date is not null and end_date is not null").select("entity", F.struct("interval_id", F.least(*ends).alias("s"), F.greatest(*ends).alias("e")).alias("_c"))
    a = a.select("*", F.explode(F.expr(f"sequence(floor(_c.s / {width}), floor(_c.e / {width}))")).alias("_bin"))
    g = a.groupBy("entity", "_bin").agg(F.array_sort(F.collect_list("_c")).alias("_c"), F.min("_c.s").alias("_s"), F.max("_c.e").alias("_e"))
    days = F.expr(f"sequence(cast(greatest(_s, _bin * {width}) as int), cast(least(_e, _bin * {width} + {width - 1}) as int))")
    d = g.select("entity", "_c", F.explode(days).alias("_d"))
    d = d.select("entity", F.date_from_unix_date("_d").alias("day"), F.filter("_c", lambda c: (c["s"] <= F.col("_d")) & (F.col("_d") <= c["e"])).alias("_on")).where("size(_on) > 0")
    ids = F.array_compact(F.array_distinct(F.transform("_on", lambda c: c["interval_id"].cast("string"))))
    return d.select("entity", "day", F.size("_on").cast("long").alias("n"), F.array_join(ids, ",").alias("ids"))


def seed_coverage(df: DataFrame, unit: list[str], seed: str) -> DataFrame:
    """Units that lack one of the seeds seen anywhere, with what they lack."""
    every = df.agg(F.array_sort(F.collect_set(seed)).alias("_all"))
    g = df.groupBy(*unit).agg(F.collect_set(seed).alias("_s")).crossJoin(F.broadcast(every))
    return g.select(*unit, F.array_join(F.array_except("_all", "_s"), ",").alias("missing")).where("missing <> ''")


def effects(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean with a normal 95 % interval from its standard error."""
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_s"))
    se = F.col("_s") / F.sqrt(F.col("n"))
    return g.select(*by, "n", "mean", (F.col("mean") - 1.96 * se).alias("lower"), (F.col("mean") + 1.96 * se).alias("upper"))


def shift_donors(df: DataFrame, keys: list[str], order: str, value: str, k: int) -> DataFrame:
    """Each donor series moved ``k`` rows later (earlier if negative)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("shifted", F.lag(value, k).over(w) if k >= 0 else F.lead(value, -k).over(w))


def permute_blocks(df: DataFrame, keys: list[str], order: str, value: str, size: int, seed: int) -> DataFrame:
    """``permuted``: the mean of the row's day of year plus another row's residual from its own:
    residuals move in whole blocks of ``size`` rows, laid end to end in the order of a hash."""
    w = Window.partitionBy(*keys)
    i = df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_s", F.avg(value).over(Window.partitionBy(*keys, F.dayofyear(order))))
    i = i.withColumn("_b", F.floor(F.col("_i") / size))
    blocks = i.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), *keys, F.col("_b").cast("string")))
    to = blocks.withColumn("_to", F.sum("_n").over(w.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    moved = i.join(to, [*keys, "_b"]).select(*keys, (F.col("_to") + F.pmod("_i", F.lit(size))).alias("_i"), (F.col(value) - F.col("_s")).alias("_r"))
    return i.join(moved, [*keys, "_i"], "left").withColumn("permuted", F.col("_s") + F.col("_r")).drop("_i", "_b", "_s", "_r")
