"""Scenario grids, further gap shapes, local thresholds, regression fillers and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelscope.functions.sqlfn import SERIES, doy366, hash_rank, season
from panelscope.operators.explore import block_starts


def scenario_grid(entities: DataFrame, rates: list[float], lengths: list[int], seeds: list[int]) -> DataFrame:
    """Every entity with every rate, length and seed, and a stable id; parameters are few."""
    g = entities.select("entity").distinct()
    for name, values in (("rate", rates), ("length", lengths), ("mask_seed", seeds)):
        g = g.withColumn(name, F.explode(F.lit(values)))
    return g.withColumn("scenario_id", F.concat_ws("-", "entity", F.format_string("%.1f", "rate"), F.col("length").cast("string"), F.col("mask_seed").cast("string")))


def local_threshold(panel: DataFrame, quantile: float, mean_half: int = 7, half: int = 15, least: int = 30) -> DataFrame:
    """By leap-calendar day: training mean within ``mean_half`` days, and the quantile of the
    anomalies from it within ``half`` days. Days are sent to where they count: equi-joins only."""
    t = panel.where("split = 'train' and value is not null").select(*SERIES, "value", doy366("ts").alias("d"))
    spread = lambda df, h: df.select("*", F.explode(F.sequence(F.lit(-h), F.lit(h))).alias("_o")).withColumn("doy", F.pmod(F.col("d") - 1 + F.col("_o"), F.lit(366)) + 1).drop("_o")
    mean = spread(t, mean_half).groupBy(*SERIES, "doy").agg(F.avg("value").alias("mean"))
    anomaly = t.join(mean.withColumnRenamed("doy", "d"), [*SERIES, "d"]).select(*SERIES, "d", (F.col("value") - F.col("mean")).alias("a"))
    q = spread(anomaly, half).groupBy(*SERIES, "doy").agg(F.count(F.lit(1)).alias("n"), F.percentile("a", quantile).alias("q"))
    return q.where(F.col("n") >= least).join(mean, [*SERIES, "doy"]).select(*SERIES, "doy", "n", "mean", "q", (F.col("mean") + F.col("q")).alias("threshold"))


def code_counts(df: DataFrame, by: list[str], value: str, codes: list[float]) -> DataFrame:
    """How often each special code occurs, zeros included."""
    g = df.groupBy(*by).agg(*(F.count_if(F.abs(F.col(value) - c) <= 1e-9).alias(f"c{i}") for i, c in enumerate(codes)))
    rows = F.array(*[F.struct(F.lit(float(c)).alias("code"), F.col(f"c{i}").alias("n")) for i, c in enumerate(codes)])
    return g.select(*by, F.explode(rows).alias("r")).select(*by, "r.code", "r.n")


def state_labels(panel: DataFrame) -> DataFrame:
    """low, normal or high by training tertiles of the series and season, else of the series."""
    t = panel.where("split = 'train' and value is not null").withColumn("season", season("ts"))
    q = F.percentile("value", F.array(F.lit(1 / 3), F.lit(2 / 3)))
    a = t.groupBy(*SERIES, "season").agg(F.count(F.lit(1)).alias("_n"), q.alias("_s")).where("_n >= 30").drop("_n")
    b = t.groupBy(*SERIES).agg(q.alias("_all"))
    m = panel.withColumn("season", season("ts")).join(a, [*SERIES, "season"], "left").join(b, SERIES, "left").withColumn("_q", F.coalesce("_s", "_all"))
    label = F.when(F.col("value").isNull(), None).when(F.col("value") <= F.col("_q")[0], "low").when(F.col("value") <= F.col("_q")[1], "normal").otherwise("high")
    return m.withColumn("state", label).drop("_s", "_all", "_q")


def network_outage(panel: DataFrame, variable: str, length: int, seed: int) -> DataFrame:
    """One block on which a variable is observed at every entity; hides it everywhere."""
    p = panel.where(F.col("variable") == variable)
    n = p.select(F.countDistinct("entity").alias("_all"))
    joint = block_starts(p, length).groupBy("ts").agg(F.count(F.lit(1)).alias("_n")).crossJoin(F.broadcast(n)).where("_n = _all")
    one = joint.orderBy(hash_rank(F.lit(seed), "ts")).limit(1)
    return one.select(F.lit(variable).alias("variable"), F.col("ts").alias("start_date"), F.date_add("ts", length - 1).alias("end_date"))


def sliding_counts(panel: DataFrame, sizes: list[int]) -> DataFrame:
    """How many windows of each size fit each split of each series."""
    g = panel.groupBy(*SERIES, "split").agg(F.count(F.lit(1)).alias("n_days")).withColumn("size", F.explode(F.lit(sizes)))
    return g.withColumn("windows", F.greatest(F.col("n_days") - F.col("size") + 1, F.lit(0)))


def donor_lags(best: DataFrame) -> DataFrame:
    """Of each target, the donor and lag with the strongest correlation (ties: nearer, later lag, name)."""
    w = Window.partitionBy("target").orderBy(F.abs("r").desc_nulls_last(), F.abs("lag"), F.col("lag").desc(), "source")
    return best.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def simple_regression(df: DataFrame, by: list[str], x: str, y: str, alpha: float) -> DataFrame:
    """Ridge line of standardised ``x`` on ``y`` by key, in closed form from one pass of moments."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(ok, F.col(x)), F.when(ok, F.col(y))
    g = df.groupBy(*by).agg(F.count_if(ok).alias("n"), F.avg(a).alias("mx"), F.avg(b).alias("my"), F.var_pop(a).alias("vx"), F.covar_pop(a, b).alias("c"))
    slope = F.try_divide(F.col("n") * F.col("c"), (F.col("n") + alpha) * F.col("vx"))
    return g.select(*by, "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))


def finalists(ranked: DataFrame, model: str, score: str, margin: float, mandatory: list[str]) -> DataFrame:
    """Models within a margin of the best, and the mandatory ones, with the reason."""
    best = ranked.agg(F.min(score).alias("_best"))  # one row
    near = F.col(score) <= F.col("_best") + margin
    reason = F.when(near, "within_margin").when(F.col(model).isin(*mandatory), "mandatory").otherwise("dropped")
    return ranked.crossJoin(F.broadcast(best)).withColumn("reason", reason).drop("_best")


def pchip(panel: DataFrame) -> DataFrame:
    """Shape-preserving cubic through the observations of a series: Fritsch-Carlson slopes from
    neighbouring secants, three-point ends, no extrapolation."""
    w = Window.partitionBy(*SERIES).orderBy("t")
    k = panel.where("value is not null").select(*SERIES, F.unix_date("ts").alias("t"), F.col("value").alias("v"))
    k = k.withColumn("h", F.lead("t").over(w) - F.col("t")).withColumn("s", (F.lead("v").over(w) - F.col("v")) / F.col("h"))
    k = k.withColumn("h0", F.lag("h").over(w)).withColumn("s0", F.lag("s").over(w)).withColumn("h1", F.lead("h").over(w)).withColumn("s1", F.lead("s").over(w))
    k = k.withColumn("hb", F.lag("h", 2).over(w)).withColumn("sb", F.lag("s", 2).over(w))

    def end(h, s, h2, s2):  # one-sided slope, kept monotone
        d = ((2 * h + h2) * s - h * s2) / (h + h2)
        kept = F.when(F.signum(d) != F.signum(s), 0.0).when((F.signum(s) != F.signum(s2)) & (F.abs(d) > 3 * F.abs(s)), 3 * s).otherwise(d)
        return F.when(s2.isNull(), s).otherwise(kept)

    c = F.col
    w1, w2 = 2 * c("h") + c("h0"), c("h") + 2 * c("h0")
    inner = F.when(c("s0") * c("s") <= 0, 0.0).otherwise((w1 + w2) / (w1 / c("s0") + w2 / c("s")))
    slope = F.when(c("s0").isNull(), end(c("h"), c("s"), c("h1"), c("s1"))).when(c("s").isNull(), end(c("h0"), c("s0"), c("hb"), c("sb"))).otherwise(inner)
    k = k.withColumn("d", slope).withColumn("d1", F.lead("d").over(w)).withColumn("v1", F.lead("v").over(w))
    knots = k.select(*SERIES, c("t").alias("_t"), F.struct("t", "v", "h", "d", "d1", "v1").alias("_k"))
    order = Window.partitionBy(*SERIES).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    p = panel.withColumn("_t", F.unix_date("ts")).join(knots, [*SERIES, "_t"], "left").withColumn("_k", F.last("_k", ignorenulls=True).over(order))
    u = (c("_t") - c("_k.t")) / c("_k.h")
    cubic = c("_k.v") * (1 + 2 * u) * (1 - u) * (1 - u) + c("_k.h") * c("_k.d") * u * (1 - u) * (1 - u) + c("_k.v1") * u * u * (3 - 2 * u) + c("_k.h") * c("_k.d1") * u * u * (u - 1)
    return p.withColumn("pred", F.coalesce("value", cubic)).drop("_t", "_k")
