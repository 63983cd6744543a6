"""Bootstraps of fixed size over clusters within strata, monotone curves, and frontiers of every draw."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelscope.functions.picks import drawn_sums
from panelscope.sources.storage import stored


#: Clusters of a stratum that a task holds at a time, and a row; picks a task makes at least, where the stratum has
#: them; tasks a stratum is cut into at most; tasks that all strata are cut into, about, if they have more picks.
BLOCK, PIECE, WORK, CUTS, TASKS = 2**20, 4096, 2**23, 32, 256


def columns_of(numbers: pa.ChunkedArray, pieces: pa.ChunkedArray, width: int) -> np.ndarray:
    """(width, clusters): the packed pieces in the order of their numbers, each column on its own. The
    pieces are read where they lie, so that nothing but the result is held besides them."""
    found = [piece.values.to_numpy() for chunk in pieces.chunks for piece in chunk]
    out, at = np.empty((width, sum(map(len, found)) // width)), 0
    for k in np.argsort(numbers.to_numpy()):
        end = at + len(found[k]) // width
        out[:, at:end] = found[k].reshape(-1, width).T
        at = end
    return out


def resampled(clusters: DataFrame, by: list[str], strata: list[str], cluster: str, sums: list[str], n: str, draws: int, seed: int) -> DataFrame:
    """(by, draw, means): the mean of each column of ``sums`` over ``n`` when in every draw as many
    clusters are drawn, with replacement, as each stratum has.

    ``clusters``: a row for each cluster of (by, strata), with its sums and its n, none of them null.
    Every cluster stands for one slot of its stratum, and a slot of a draw takes the cluster whose
    number its hash gives. All columns of a cluster go together, so a draw is the same for all of them.

    The draws of a stratum are cut into tasks. Each gets the stratum's sums, packed in pieces, makes
    its draws by numpy and returns their sums: no row is made for a single pick, and the sums travel
    at most ``CUTS`` times, and fewer where many large strata make ``TASKS`` tasks without. Of a stratum
    of more than ``BLOCK`` clusters a task has one block, and hashes all slots to find those that fall
    into it. Strata with a null key are not drawn.
    """
    group = [*by, *strata]
    w = Window.partitionBy(*group)
    known = clusters.where(" and ".join(f"`{g}` is not null" for g in group))
    c = stored(known.select(*group, F.array(*(F.col(x).cast("double") for x in (n, *sums))).alias("_x"), (F.row_number().over(w.orderBy(cluster)) - 1).cast("long").alias("_i"), F.count(F.lit(1)).over(w).alias("_m")), "clusters")
    pieces = c.groupBy(*group, "_m", F.expr(f"_i div {PIECE}").alias("_p")).agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_c"))
    pieces = pieces.select(*group, "_m", F.expr(f"_p * {PIECE} div {BLOCK}").alias("_b"), F.col("_p"), F.flatten(F.transform("_c", lambda r: r["_x"])).alias("_x"))
    firsts = c.where("_i = 0")
    work = max(WORK, (firsts.agg(F.sum("_m")).first()[0] or 0) * draws // TASKS)
    each = F.greatest(F.lit(-(-draws // CUTS)), F.expr(f"cast(least({draws}, {work} div _m) as int)"))  # draws of a task
    cut = pieces.withColumn("_each", each).withColumn("_first", F.explode(F.sequence(F.lit(1), F.lit(draws), F.col("_each"))))
    text = F.concat_ws("|", F.lit(str(seed)), *(F.col(g).cast("string") for g in group))
    task = [*group, "_b", "_first"]
    # more partitions than tasks, for the few bytes of a task stand for much work and two should seldom meet
    tasks = firsts.agg(F.sum(F.ceil(F.lit(draws) / each) * F.ceil(F.col("_m") / BLOCK))).first()[0] or 1
    spread = cut.withColumn("_text", text).repartition(min(4 * int(tasks), 2000), *task)
    kept = [f for f in clusters.schema.fields if f.name in by]
    schema = T.StructType([*kept, T.StructField("draw", T.IntegerType()), T.StructField("_s", T.ArrayType(T.DoubleType()))])
    width = 1 + len(sums)

    def drawn(table: pa.Table) -> pa.Table:
        x = columns_of(table["_p"], table["_x"], width)
        m, first = table["_m"][0].as_py(), table["_first"][0].as_py()
        last = min(draws, first + table["_each"][0].as_py() - 1)
        found = drawn_sums(table["_text"][0].as_py().encode(), first, last, m, table["_b"][0].as_py() * BLOCK, list(x))
        k = last - first + 1
        same = pa.array(np.zeros(k, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * width), pa.array(found.T.ravel()))
        return pa.table([*(table[f.name].take(same) for f in kept), pa.array(np.arange(first, last + 1, dtype=np.int32)), lists], names=[*(f.name for f in kept), "draw", "_s"])

    parts = spread.groupBy(*task).applyInArrow(drawn, schema)
    total = parts.groupBy(*by, "draw").agg(*(F.sum(F.col("_s")[k]).alias(f"_s{k}") for k in range(width)))
    return total.select(*by, "draw", F.array(*(F.round(F.col(f"_s{k}") / F.col("_s0"), 9) for k in range(1, width))).alias("means"))


def interval(draws: DataFrame, by: list[str], value: str, confidence: float = 0.95) -> DataFrame:
    """(by, ci_lower, ci_upper): percentile interval of a column of draws."""
    alpha = (1 - confidence) / 2
    q = F.percentile(value, F.array(F.lit(alpha), F.lit(1 - alpha)))
    return draws.groupBy(*by).agg(q.alias("_q")).select(*by, F.col("_q")[0].alias("ci_lower"), F.col("_q")[1].alias("ci_upper"))


def bootstrap_mean(rows: DataFrame, by: list[str], cluster: str, value: str, draws: int, seed: int, strata: list[str] = ()) -> DataFrame:
    """Mean of a column with the percentile interval over whole clusters drawn within strata:
    (by, n_rows, n_clusters, estimate, ci_lower, ci_upper); no interval for one cluster."""
    strata = [*strata]
    c = stored(rows.where(F.col(value).isNotNull()).groupBy(*by, *strata, cluster).agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_k")), "clusters")
    est = c.groupBy(*by).agg(F.sum("_k").alias("n_rows"), F.count(F.lit(1)).alias("n_clusters"), F.try_divide(F.sum("_s"), F.sum("_k")).alias("estimate"))
    ci = interval(resampled(c, by, strata, cluster, ["_s"], "_k", draws, seed).withColumn("_m", F.col("means")[0]), by, "_m")
    two = F.col("n_clusters") >= 2
    return est.join(ci, by, "left").withColumns({k: F.when(two, F.col(k)) for k in ("ci_lower", "ci_upper")})


def monotone(values: str, weights: str | None = None) -> Column:
    """The weighted non-increasing least-squares fit of an array, as an array of (fit, block): one
    pass that keeps a stack of blocks and joins the last ones while they rise."""
    rows = f"transform({values}, (v, i) -> struct(v AS v, {f'cast({weights}[i] as double)' if weights else '1D'} AS w))"
    block = "named_struct('s', {s}, 'w', {w}, 'n', {n})"
    first = block.format(s="x.v * x.w", w="x.w", n="1")
    joined = block.format(s="b.s + acc.cur.s", w="b.w + acc.cur.w", n="b.n + acc.cur.n")
    rises = "size(acc.kept) = 0 AND b.s / b.w <= acc.cur.s / acc.cur.w"
    empty = "cast(array() AS array<struct<s:double,w:double,n:int>>)"
    back = f"aggregate(reverse(st), named_struct('cur', {first}, 'kept', {empty}), (acc, b) -> IF({rises}, named_struct('cur', {joined}, 'kept', acc.kept), named_struct('cur', acc.cur, 'kept', concat(acc.kept, array(b)))), acc -> reverse(concat(array(acc.cur), acc.kept)))"
    stack = f"aggregate({rows}, {empty}, (st, x) -> {back})"
    return F.expr(f"flatten(transform({stack}, (b, i) -> array_repeat(named_struct('fit', b.s / b.w, 'block', i), b.n)))")


def frontier(values: Column, gaps: list[float], threshold: float = 0.0) -> Column:
    """(frontier, censoring, reversal) of a curve over tested gaps: where it first falls to the
    threshold, by straight line from the gap before; null and 'left' if it does at the smallest,
    the largest gap and 'right' if it never does."""
    x = F.lit([float(g) for g in gaps])
    ok = F.transform(values, lambda v: v > threshold)
    at = F.array_position(ok, False)  # from 1; 0 if never lost
    left, right = F.get(values, (at - 2).cast("int")), F.get(values, (at - 1).cast("int"))
    a, b = F.get(x, (at - 2).cast("int")), F.get(x, (at - 1).cast("int"))
    flat = F.abs(left - right) <= 1e-8 + 1e-5 * F.abs(right)
    cross = F.when(flat, a).otherwise(a + F.try_divide(threshold - left, right - left) * (b - a))
    days = F.when(at == 0, F.lit(float(gaps[-1]))).when(at > 1, cross)
    again = F.exists(F.slice(ok, F.greatest(at, F.lit(1)).cast("int"), F.size(ok)), lambda v: v) & (at > 0)
    return F.struct(days.alias("frontier"), F.when(at == 0, "right").when(at == 1, "left").otherwise("none").alias("censoring"), again.alias("reversal"))


def running_minimum(values: str) -> Column:
    return F.expr(f"transform({values}, (v, i) -> array_min(slice({values}, 1, i + 1)))")


def complete_curves(rows: DataFrame, unit: list[str], gap: str, value: str, gaps: list) -> DataFrame:
    """(unit, g0, g1, ..., complete): the mean of each tested gap side by side."""
    at = [F.avg(F.when(F.col(gap) == g, F.col(value))).alias(f"g{i}") for i, g in enumerate(gaps)]
    c = rows.groupBy(*unit).agg(*at)
    full = F.lit(True)
    for i in range(len(gaps)):
        full &= F.col(f"g{i}").isNotNull()
    return c.withColumn("complete", full)


def frontier_interval(rows: DataFrame, by: list[str], unit: str, gap: str, value: str, gaps: list, draws: int, seed: int, threshold: float = 0.0) -> DataFrame:
    """The first loss of the monotone mean curve over units with whole curves, with the percentile
    interval of the draws' own and how many of them are censored: one left of the smallest gap
    counts as 0, one right of the largest as that."""
    curves = stored(complete_curves(rows, [*by, unit], gap, value, gaps), "curves")
    cols = [f"g{i}" for i in range(len(gaps))]
    whole = curves.where("complete").withColumn("_one", F.lit(1))
    first = lambda df: df.withColumn("_f", frontier(running_minimum("means"), gaps, threshold)).withColumn("frontier", F.when(F.col("_f.censoring") == "left", 0.0).otherwise(F.col("_f.frontier")))
    point = whole.groupBy(*by).agg(F.count(F.lit(1)).alias("n_units"), F.array(*(F.avg(c) for c in cols)).alias("means"))
    point = first(point).select(*by, "n_units", F.col("frontier").alias("frontier_days"), F.col("_f.censoring").alias("censoring"))
    lost = curves.groupBy(*by).agg(F.count_if(~F.col("complete")).alias("n_incomplete"))
    drawn = stored(first(resampled(whole, by, [], unit, cols, "_one", draws, seed)), "draws")
    ends = drawn.groupBy(*by).agg(F.count_if(F.col("_f.censoring") == "left").alias("left_censored"), F.count_if(F.col("_f.censoring") == "right").alias("right_censored"))
    out = lost.join(point, by, "left").join(interval(drawn, by, "frontier"), by, "left").join(ends, by, "left")
    two = F.col("n_units") >= 2
    return out.withColumns({k: F.when(two, F.col(k)) for k in ("ci_lower", "ci_upper", "left_censored", "right_censored")})


def joint_draws(curves: DataFrame, by: list[str], strata: list[str], cluster: str, gaps: list, draws: int, seed: int, threshold: float = 0.0) -> DataFrame:
    """(by, draw, means, fits, raw, smooth): every draw of whole anchor curves within strata, its
    mean at each gap, its monotone fit and both frontiers. One draw of clusters serves all gaps."""
    cols = [f"g{i}" for i in range(len(gaps))]
    whole = curves.where("complete").groupBy(*by, *strata, cluster).agg(F.count(F.lit(1)).alias("_k"), *(F.sum(c).alias(c) for c in cols))
    d = resampled(whole, by, strata, cluster, cols, "_k", draws, seed)
    return with_frontiers(d, gaps, threshold)


def with_frontiers(df: DataFrame, gaps: list, threshold: float) -> DataFrame:
    fits = F.transform(monotone("means"), lambda x: F.round(x["fit"], 9))
    return df.withColumn("fits", fits).withColumn("raw", frontier(F.col("means"), gaps, threshold)).withColumn("smooth", frontier(F.col("fits"), gaps, threshold))


def joint_frontiers(rows: DataFrame, by: list[str], strata: list[str], anchor: str, cluster: str, gap: str, value: str, gaps: list, draws: int, seed: int, threshold: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Joint bootstrap of anchor curves across gaps: (summary by group, curve by group and gap).

    ``rows`` are already averaged over training seeds or are averaged here within anchor and gap.
    Incomplete curves are left out whole. Without two clusters in any stratum there is nothing to
    draw, and intervals are null.
    """
    unit = [*by, *strata, *dict.fromkeys((cluster, anchor))]
    curves = stored(complete_curves(rows, unit, gap, value, gaps), "curves")
    cols = [f"g{i}" for i in range(len(gaps))]
    whole = curves.where("complete")
    point = with_frontiers(whole.groupBy(*by).agg(F.count(F.lit(1)).alias("n_complete"), F.array(*(F.round(F.avg(c), 9) for c in cols)).alias("means")), gaps, threshold)
    sizes = whole.groupBy(*by, *strata).agg(F.countDistinct(cluster).alias("_m")).groupBy(*by).agg(F.sum("_m").alias("n_clusters"), F.count_if(F.col("_m") >= 2).alias("n_resampleable_strata"))
    lost = curves.groupBy(*by).agg(F.count_if(~F.col("complete")).alias("n_incomplete"))
    base = stored(lost.join(point, by, "left").join(sizes, by, "left"), "points")
    drawn = stored(joint_draws(curves, by, strata, cluster, gaps, draws, seed, threshold), "draws")
    can = (F.col("n_complete") >= 2) & (F.col("n_resampleable_strata") > 0)
    raw, smooth = (interval(drawn.withColumn("_x", F.col(f"{k}.frontier")), by, "_x").select(*by, F.col("ci_lower").alias(f"{k}_lower"), F.col("ci_upper").alias(f"{k}_upper")) for k in ("raw", "smooth"))
    ends = drawn.groupBy(*by).agg(*(F.count_if(F.col(f"{k}.censoring") == side).alias(f"{k}_{side}") for k in ("raw", "smooth") for side in ("left", "right")))
    summary = base.join(raw, by, "left").join(smooth, by, "left").join(ends, by, "left").select(
        *by, "n_complete", "n_incomplete", "n_clusters", "n_resampleable_strata", *(F.col(f"{k}.{x}").alias(f"{k}_{x}") for k in ("raw", "smooth") for x in ("frontier", "censoring", "reversal")),
        *(F.when(can, F.col(c)).alias(c) for c in ("raw_lower", "raw_upper", "smooth_lower", "smooth_upper", "raw_left", "raw_right", "smooth_left", "smooth_right")),
    )
    x = F.lit([float(g) for g in gaps])
    at = drawn.select(*by, F.posexplode("means").alias("_i", "_v"))
    ci = interval(at, [*by, "_i"], "_v")
    lines = base.where("n_complete is not null").select(*by, can.alias("_can"), F.posexplode(F.arrays_zip(x.alias("gap"), F.col("means").alias("raw_value"), F.col("fits").alias("monotone_value"))).alias("_i", "c"))
    curve = lines.join(ci, [*by, "_i"], "left").select(*by, "c.gap", "c.raw_value", "c.monotone_value", (F.abs(F.col("c.monotone_value") - F.col("c.raw_value")) > 1e-8).alias("adjusted"), *(F.when(F.col("_can"), F.col(k)).alias(k) for k in ("ci_lower", "ci_upper")))
    return summary, curve
