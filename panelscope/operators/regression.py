"""Fitted fillers: ridge regressions on seasons, covariates and donors, from sums of products.

A model's whole training set becomes k(k+1)/2 sums, added up by Spark before and after the
shuffle; the small system of each key is then solved by Gauss-Jordan steps in an SQL expression.
Sums add, so every hold-out of a pooled model is the total less the entity's own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelscope.sources.storage import stored


@dataclass(frozen=True)
class Design:
    """Sines and cosines of the year, then named features, then products of some with the seasons."""

    features: tuple[str, ...]
    harmonics: int = 3
    interactions: tuple[str, ...] = ()

    @property
    def names(self) -> list[str]:
        seasons = [f"doy_{f}_{k}" for k in range(1, self.harmonics + 1) for f in ("sin", "cos")]
        return [*seasons, *self.features, *(f"{c}_x_{s}" for c in self.interactions if c in self.features for s in seasons)]

    def columns(self, date: str = "ts") -> list:
        leap = F.dayofyear(F.make_date(F.year(date), F.lit(12), F.lit(31)))
        phase = 2 * F.pi() * (F.dayofyear(date) - 1) / leap
        seasons = [f(k * phase) for k in range(1, self.harmonics + 1) for f in (F.sin, F.cos)]
        named = [F.col(c).cast("double") for c in self.features]
        return [*seasons, *named, *(F.col(c).cast("double") * s for c in self.interactions if c in self.features for s in seasons)]

    @property
    def always(self) -> int:
        """So many of the first are never null."""
        return 2 * self.harmonics


def with_design(df: DataFrame, design: Design, date: str = "ts") -> DataFrame:
    return df.withColumn("_x", F.array(*design.columns(date)))


def medians(train: DataFrame, keys: list[str], size: int, always: int) -> DataFrame:
    """(keys, med): the median of each feature that may be absent, 0 for the others or if it always is."""
    zero = F.lit(0.0)
    found = [zero if i < always else F.coalesce(F.percentile(F.col("_x")[i], 0.5), zero) for i in range(size)]
    return train.groupBy(*keys).agg(F.array(*found).alias("med"))


def sums(df: DataFrame, keys: list[str], vector: list) -> DataFrame:
    """(keys, s_i_j): sums of the products of all pairs of the vector's columns, i <= j."""
    rows = df.select(*keys, *(c.alias(f"v{i}") for i, c in enumerate(vector)))
    each = [(i, j) for i in range(len(vector)) for j in range(i, len(vector))]
    return rows.groupBy(*keys).agg(*(F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"s_{i}_{j}") for i, j in each))


class Products:
    """Expressions for sums over features z_i = u_i + med[i] * w_i and the target, from the sums
    of a vector (1, u..., w..., y); ``absent``: which features have a w, in the order of the w's."""

    def __init__(self, size: int, absent: list[int], prefix: str = ""):
        self.size, self.prefix = size, prefix
        self.terms = [[("1.0", 1 + i), *([(f"med[{i}]", 1 + size + absent.index(i))] if i in absent else [])] for i in range(size)]
        self.y = 1 + size + len(absent)

    def _of(self, a: list, b: list) -> str:
        return " + ".join(f"{m} * {n} * {self.prefix}s_{min(i, j)}_{max(i, j)}" for m, i in a for n, j in b)

    @property
    def n(self) -> str:
        return f"{self.prefix}s_0_0"

    def z(self, i: int) -> str:
        return f"({self._of(self.terms[i], [('1.0', 0)])})"

    def zz(self, i: int, j: int) -> str:
        return f"({self._of(self.terms[i], self.terms[j])})"

    def zy(self, i: int) -> str:
        return f"({self._of(self.terms[i], [('1.0', self.y)])})"

    def yy(self, other: int) -> str:
        return f"{self.prefix}s_{min(other, self.y)}_{max(other, self.y)}"


def solved(rows: DataFrame, matrix: str, out: str) -> DataFrame:
    """``out``: the solution of a symmetric positive system, ``matrix`` being its rows, each with its
    right-hand side last. One Gauss-Jordan step for each column; no pivots are needed."""
    step = "transform(m, (r, i) -> IF(i = k, transform(r, v -> v / m[k][k]), zip_with(r, m[k], (a, b) -> a - b * (r[k] / m[k][k]))))"
    done = f"aggregate(sequence(0, size({matrix}) - 1), {matrix}, (m, k) -> {step})"
    return rows.withColumn(out, F.expr(f"transform({done}, r -> element_at(r, -1))"))


def ridge(rows: DataFrame, products: Products, alpha: str) -> DataFrame:
    """Adds mean, sd, coef (of standardised features) and level (the target's mean) to rows of sums
    and medians; ``alpha``: an expression."""
    k, p = range(products.size), products
    out = rows.withColumn("mean", F.expr(f"array({', '.join(f'{p.z(i)} / {p.n}' for i in k)})"))
    var = [f"({p.zz(i, i)} / {p.n} - mean[{i}] * mean[{i}])" for i in k]
    # what rounding leaves of a constant's variance is none
    out = out.withColumn("sd", F.expr(f"array({', '.join(f'IF({v} > 1e-12 * {p.zz(i, i)} / {p.n}, sqrt({v}), 1.0)' for i, v in enumerate(var))})"))
    out = out.withColumn("level", F.expr(f"{p.yy(0)} / {p.n}"))
    cell = lambda i, j: f"({p.zz(i, j)} - {p.n} * mean[{i}] * mean[{j}]) / (sd[{i}] * sd[{j}])" + (f" + {alpha}" if i == j else "")
    right = lambda i: f"({p.zy(i)} - {p.n} * mean[{i}] * level) / sd[{i}]"
    lines = [f"array({', '.join([*(cell(i, j) for j in k), right(i)])})" for i in k]
    return solved(out.withColumn("_m", F.expr(f"array({', '.join(lines)})")), "_m", "coef").drop("_m")


def squared_error(products: Products) -> str:
    """Sum of squared errors of a fitted model on other rows, from their sums of products alone."""
    p, k = products, range(products.size)
    b = [f"(coef[{i}] / sd[{i}])" for i in k]
    a = "(level - (" + " + ".join(f"{x} * mean[{i}]" for i, x in enumerate(b)) + "))"
    cross = " + ".join(f"{'' if i == j else '2 * '}{b[i]} * {b[j]} * {p.zz(i, j)}" for i in k for j in k if i <= j)
    lines = " + ".join(f"{x} * ({a} * {p.z(i)} - {p.zy(i)})" for i, x in enumerate(b))
    return f"{p.yy(p.y)} - 2 * {a} * {p.yy(0)} + {p.n} * {a} * {a} + 2 * ({lines}) + {cross}"


def _shifts(train: DataFrame, target: str, size: int) -> tuple[list[float], float]:
    """Means over the whole training set, taken off before squaring: one row."""
    row = train.agg(F.avg(target), *(F.avg(F.col("_x")[i]) for i in range(size))).first()
    return [float(v or 0) for v in row[1:]], float(row[0] or 0)


def _training(df: DataFrame, target: str, split: str = "train") -> DataFrame:
    return df.where((F.col("split") == split) & F.col(target).isNotNull())


def fit(df: DataFrame, keys: list[str], target: str, design: Design, alpha: float = 1.0) -> DataFrame:
    """One ridge for each key, on the training days with a target: (keys, n, med, mean, sd, coef,
    level). ``df`` has ``_x`` (``with_design``, or any array of the design's features) and split.
    An absent feature counts as its training median. Keys without training days have no model."""
    size = len(design.names)
    train = _training(df, target)
    med = medians(train, keys, size, design.always)
    shift, level = _shifts(train, target, size)
    filled = train.join(med, keys)
    vector = [F.lit(1.0), *(F.coalesce(F.col("_x")[i], F.col("med")[i]) - shift[i] for i in range(size)), F.col(target) - level]
    got = ridge(sums(filled, keys, vector), Products(size, []), str(float(alpha))).join(med, keys)
    return got.select(
        *keys, F.col("s_0_0").cast("long").alias("n"), "med", F.zip_with("mean", F.lit(shift), lambda m, s: m + s).alias("mean"), "sd", "coef", (F.col("level") + level).alias("level")
    )


def predict(df: DataFrame, model: DataFrame, keys: list[str], out: str = "pred") -> DataFrame:
    """``out`` for every row whose key has a model, else null."""
    z = "zip_with(zip_with(_x, _med, (v, m) -> coalesce(v, m)), zip_with(_mean, _sd, (m, s) -> struct(m, s)), (v, p) -> (v - p.m) / p.s)"
    value = F.expr(f"_level + aggregate(zip_with({z}, _coef, (v, c) -> v * c), 0D, (a, b) -> a + b)")
    parts = ["med", "mean", "sd", "coef", "level"]
    own = model.select(*keys, *(F.col(c).alias(f"_{c}") for c in parts))
    return df.join(own, keys, "left").withColumn(out, value).drop(*(f"_{c}" for c in parts))


def seasonal_ridge(wide: DataFrame, target: str, design: Design, forbidden: str | None = None, alpha: float = 1.0) -> DataFrame:
    """``wide`` (entity, ts, split and columns) with ``pred`` by each entity's own model; a forbidden
    column among the features is an error."""
    if forbidden in design.features or target in design.features:
        raise ValueError(f"{forbidden if forbidden in design.features else target} is forbidden in this model")
    rows = with_design(wide, design)
    return predict(rows, fit(rows, ["entity"], target, design, alpha), ["entity"]).drop("_x")


def best_lags(obs: DataFrame, lags: range, least: int = 3) -> DataFrame:
    """(source, target, lag, r): of each pair of entities the lag at which the training days of the
    source, moved by it, correlate most with those of the target; ties go to the shorter, then the
    positive one. Lag 0 where no lag has a correlation. ``obs``: entity, ts, value, split."""
    t = obs.where("split = 'train' and value is not null").select("entity", "ts", "value")
    moved = t.select(F.col("entity").alias("source"), "ts", F.col("value").alias("a"), F.explode(F.lit([*lags])).alias("lag")).withColumn("ts", F.expr("date_add(ts, lag)"))
    met = moved.join(t.select(F.col("entity").alias("target"), "ts", F.col("value").alias("b")), "ts").where("source <> target")
    g = met.groupBy("source", "target", "lag").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"), F.covar_pop("a", "b").alias("c"), F.avg("a").alias("ma"), F.avg("b").alias("mb"))
    ok = (F.col("n") >= least) & (F.col("sa") > 1e-12 * F.abs("ma")) & (F.col("sb") > 1e-12 * F.abs("mb"))
    # rounded, so that the order of a sum does not choose between equals
    g = g.withColumn("r", F.when(ok, F.round(F.col("c") / (F.col("sa") * F.col("sb")), 9)))
    w = Window.partitionBy("source", "target").orderBy(F.abs("r").desc_nulls_last(), F.abs("lag"), F.col("lag").desc())
    one = g.withColumn("_k", F.row_number().over(w)).where("_k = 1")
    return one.select("source", "target", F.when(F.col("r").isNull() & F.lit(0 in lags), 0).otherwise(F.col("lag")).alias("lag"), "r")


def donor_features(obs: DataFrame, lags: DataFrame, donors: list[str]) -> DataFrame:
    """(entity, ts, donors): for each target the others of ``donors`` in their order, each moved by
    its lag; null where a donor has nothing."""
    moved = obs.where("value is not null").join(lags.withColumnRenamed("source", "entity"), "entity").select("entity", "target", F.expr("date_add(ts, lag)").alias("ts"), "value")
    at = F.array_position(F.array_except(F.lit(donors), F.array("target")), F.col("entity"))
    slots = [F.max(F.when(F.col("_at") == i + 1, F.col("value"))) for i in range(len(donors) - 1)]
    return moved.withColumn("_at", at).groupBy(F.col("target").alias("entity"), "ts").agg(F.array(*slots).alias("donors"))


def donor_regression(wide: DataFrame, variable: str, donors: list[str], lags: range, covariates: tuple[str, ...] = (), harmonics: int = 3, alpha: float = 1.0) -> DataFrame:
    """``wide`` with ``pred`` of a variable from the season, the same variable at each other entity of
    ``donors`` moved by its best training lag, and covariates of the entity itself. The donors are
    a stated list, so a model's size is known; targets outside it take all of them but the last."""
    obs = wide.select("entity", "ts", F.col(variable).alias("value"), "split").where(F.col("entity").isin(*donors))
    found = best_lags(obs, lags)
    named = tuple(f"_donor{i}" for i in range(len(donors) - 1))
    rows = wide.join(donor_features(obs, found, donors), ["entity", "ts"], "left")
    rows = rows.withColumns({c: F.get("donors", F.lit(i)) for i, c in enumerate(named)})
    design = Design((*named, *covariates), harmonics)
    rows = with_design(rows, design).drop("donors", *named)
    return predict(rows, fit(rows, ["entity"], variable, design, alpha), ["entity"]).drop("_x")


def pooled_leave_one_out(wide: DataFrame, target: str, design: Design, alphas: tuple[float, ...] = (0.1, 1.0, 10.0)) -> DataFrame:
    """``wide`` with ``pred`` and ``alpha``: each entity by the model of all others, fitted on their
    training days, with the alpha of least error on their validation days (the first on ties).

    One aggregation serves all hold-outs and alphas: sums over all entities less the entity's own.
    A feature that is absent counts as the median over the others' training days, so the sums keep
    present values and absences apart until that is known.
    """
    rows = stored(with_design(wide, design), "design")
    size, absent = len(design.names), [*range(design.always, len(design.names))]
    both = rows.where(F.col("split").isin("train", "validation") & F.col(target).isNotNull())
    train = both.where("split = 'train'")
    shift, level = _shifts(train, target, size)
    x = [F.col("_x")[i] for i in range(size)]
    vector = [F.lit(1.0), *(F.coalesce(c - s, F.lit(0.0)) for c, s in zip(x, shift, strict=True)), *(x[i].isNull().cast("double") for i in absent), F.col(target) - level]
    own = stored(sums(both, ["entity", "split"], vector), "sums")
    cells = [c for c in own.columns if c.startswith("s_")]
    total = own.groupBy("split").agg(*(F.sum(c).alias(f"t_{c}") for c in cells))
    held = wide.select("entity").distinct()
    # every hold-out with both splits' sums of the others; an entity without rows in a split takes nothing off
    base = held.withColumn("split", F.explode(F.lit(["train", "validation"]))).join(total, "split").join(own, ["entity", "split"], "left")
    rest = base.select("entity", "split", *(F.when(F.abs(F.col(f"t_{c}") - F.coalesce(c, F.lit(0.0))) > 1e-12 * F.abs(f"t_{c}"), F.col(f"t_{c}") - F.coalesce(c, F.lit(0.0))).otherwise(0.0).alias(c) for c in cells))
    t = rest.where("split = 'train'").drop("split")
    v = rest.where("split = 'validation'").select("entity", *(F.col(c).alias(f"v_{c}") for c in cells))

    # medians of the others: how often each value occurs, all entities less the held-out one
    parts = train.select("entity", F.posexplode(F.slice("_x", design.always + 1, size - design.always)).alias("i", "value")).where("value is not null")
    often = parts.groupBy("entity", "i", "value").agg(F.count(F.lit(1)).alias("c"))
    every = held.agg(F.collect_set("entity").alias("_all"))  # one row; each count goes to all entities but its own
    others = often.crossJoin(F.broadcast(every)).withColumn("held", F.explode(F.array_except("_all", F.array("entity")))).groupBy("held", "i", "value").agg(F.sum("c").alias("c"))
    each = others.groupBy("held", "i").agg(F.percentile("value", 0.5, F.col("c")).alias("m"))
    slots = [F.lit(0.0)] * design.always + [F.coalesce(F.max(F.when(F.col("i") == i, F.col("m"))) - shift[design.always + i], F.lit(0.0)) for i in range(size - design.always)]
    med = each.groupBy(F.col("held").alias("entity")).agg(F.array(*slots).alias("med"))

    base = t.where("s_0_0 > 0").join(v, "entity", "left").join(med, "entity").withColumn("alpha", F.explode(F.lit([*alphas])))
    fitted = ridge(base, Products(size, absent), "alpha")
    error = F.expr(f"try_divide({squared_error(Products(size, absent, 'v_'))}, v_s_0_0)")
    w = Window.partitionBy("entity").orderBy(error.asc_nulls_last(), (F.col("alpha") != 1.0) & error.isNull(), "alpha")
    best = fitted.withColumn("_k", F.row_number().over(w)).where("_k = 1")
    plus = lambda c: F.zip_with(c, F.lit(shift), lambda m, s: m + s).alias(c)
    model = stored(best.select("entity", "alpha", plus("med"), plus("mean"), "sd", "coef", (F.col("level") + level).alias("level")), "pooled")
    return predict(rows, model, ["entity"]).drop("_x").join(model.select("entity", "alpha"), "entity", "left")
