"""Queries on fitted fillers, each scored by split, with their SQL twins.

The twins take another way: they centre and scale every row, multiply rows out, and solve by a
recursive query.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelscope.functions.sqlfn import SERIES
from panelscope.operators import regression, trees
from panelscope.operators.regression import Design
from panelscope.plans.catalog import SHIP, _add, _ship
from panelscope.sources.storage import stored

#: Covariates are absent on the first days of a month, so that medians have to stand in.
_WIDE = f"""{SHIP.replace('WITH', 'WITH RECURSIVE', 1)}, wide AS (SELECT entity, ts, any_value(split) AS split, max(value) FILTER (variable = 'T') AS "T", max(value) FILTER (variable = 'F' AND day(ts) > 2) AS "F", max(value) FILTER (variable = 'L' AND day(ts) > 3) AS "L" FROM panel GROUP BY entity, ts),
ph AS (SELECT *, 2 * pi() * (dayofyear(ts) - 1) / dayofyear(make_date(year(ts), 12, 31)) AS phase FROM wide)"""
_SEASONS = ", ".join(f"{f}({k} * phase)" for k in (1, 2, 3) for f in ("sin", "cos"))


def _wide(spark, sf_dir):
    of = lambda v, day: F.max(F.when((F.col("variable") == v) & (F.dayofmonth("ts") > day), F.col("value"))).alias(v)
    return stored(_ship(spark, sf_dir).groupBy("entity", "ts", "split").agg(of("T", 0), of("F", 2), of("L", 3)), "wide")


def _ridge(size: int, alpha: str = "1.0") -> str:
    """From feat (k, rid, part, x, y) to fit (k, rid, part, y, pred)."""
    return f"""tr AS (SELECT * FROM feat WHERE part = 'train' AND y IS NOT NULL), med AS (SELECT k, i, coalesce(quantile_cont(x[i], 0.5), 0) AS m FROM tr, range(1, {size + 1}) t(i) GROUP BY k, i),
fl AS (SELECT k, rid, part, i, coalesce(x[i], m) AS v, y FROM feat JOIN med USING (k)), st AS (SELECT k, i, avg(v) AS mu, stddev_pop(v) AS sd FROM fl WHERE part = 'train' AND y IS NOT NULL GROUP BY k, i),
z AS (SELECT k, rid, part, i, (v - mu) / CASE WHEN sd > 1e-9 THEN sd ELSE 1 END AS z, y FROM fl JOIN st USING (k, i)), zt AS (SELECT * FROM z WHERE part = 'train' AND y IS NOT NULL), yb AS (SELECT k, avg(y) AS level FROM tr GROUP BY k),
g AS (SELECT a.k, a.i, b.i AS j, sum(a.z * b.z) + CASE WHEN a.i = b.i THEN {alpha} ELSE 0 END AS s FROM zt a JOIN zt b USING (k, rid) GROUP BY a.k, a.i, b.i), rh AS (SELECT k, i, sum(z * (y - level)) AS s FROM zt JOIN yb USING (k) GROUP BY k, i),
m0 AS (SELECT k, list(list_append(line, s) ORDER BY i) AS m FROM (SELECT k, i, list(s ORDER BY j) AS line FROM g GROUP BY k, i) JOIN rh USING (k, i) GROUP BY k),
gj AS (SELECT k, 1 AS c, m FROM m0 UNION ALL SELECT k, c + 1, list_transform(m, lambda line, i: list_transform(range(1, {size + 2}), lambda j: CASE WHEN i = c THEN line[j] / line[c] ELSE line[j] - m[c][j] * line[c] / m[c][c] END)) FROM gj WHERE c <= {size}),
cf AS (SELECT k, i, m[i][{size + 1}] AS c FROM gj, range(1, {size + 1}) t(i) WHERE gj.c = {size + 1}),
fit AS (SELECT k, rid, any_value(part) AS part, any_value(y) AS y, any_value(level) + sum(z * c) AS pred FROM z JOIN cf USING (k, i) JOIN yb USING (k) GROUP BY k, rid)"""


_SCORES = "SELECT k AS entity, part AS split, count(*) AS days, count(y) AS n, round(sqrt(avg((pred - y) * (pred - y))) + 1e-10, 3) + 0.0 AS rmse, round(avg(pred - y) + 1e-10, 3) + 0.0 AS bias, round(avg(pred) + 1e-10, 3) + 0.0 AS mean_pred FROM fit GROUP BY k, part"


def scores(df, target: str, *more: str):
    e = F.col("pred") - F.col(target)
    return df.where("pred is not null").groupBy("entity", "split", *more).agg(
        F.count(F.lit(1)).alias("days"), F.count(target).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.avg("pred").alias("mean_pred")
    )


def _feat(y: str, *x: str) -> str:
    return f"feat AS (SELECT entity AS k, ts AS rid, split AS part, [{', '.join([_SEASONS, *x])}] AS x, {y} AS y FROM ph)"


@_add("i4_seasonal_ridge", f"""{_WIDE}, {_feat('"T"', '"F"', '"L"')}, {_ridge(8)} {_SCORES}""", 3)
def _(spark, sf_dir):
    return scores(regression.seasonal_ridge(_wide(spark, sf_dir), "T", Design(("F", "L"))), "T")


_TIMES_L = [f'"L" * {f}({k} * phase)' for k in (1, 2, 3) for f in ("sin", "cos")]


@_add("i5_air_only", f"""{_WIDE}, {_feat('"T"', '"L"', *_TIMES_L)}, {_ridge(13)} {_SCORES}""", 3)
def _(spark, sf_dir):
    return scores(regression.seasonal_ridge(_wide(spark, sf_dir), "T", Design(("L",), interactions=("L",))), "T")


@_add("i5_air_hydro", f"""{_WIDE}, {_feat('"T"', '"L"', '"F"', *_TIMES_L)}, {_ridge(14)} {_SCORES}""", 3)
def _(spark, sf_dir):
    return scores(regression.seasonal_ridge(_wide(spark, sf_dir), "T", Design(("L", "F"), interactions=("L",))), "T")


@_add("i10_independent_flow", f"""{_WIDE}, {_feat('"F"', '"T"')}, {_ridge(7)} {_SCORES}""", 3)
def _(spark, sf_dir):
    return scores(regression.seasonal_ridge(_wide(spark, sf_dir), "F", Design(("T",)), forbidden="L"), "F")


_NAMES = ["AF", "AO", "NF", "NO", "RF", "RO"]


def _lagged(half: int) -> str:
    return f"""ob AS (SELECT entity, ts, "T" AS v, split FROM wide WHERE "T" IS NOT NULL), pr AS (SELECT a.entity AS source, b.entity AS target, CAST(l AS BIGINT) AS lag, a.v AS x, b.v AS y FROM ob a, range(-{half}, {half + 1}) t(l), ob b WHERE b.ts = a.ts + CAST(l AS INT) AND a.entity <> b.entity AND a.split = 'train' AND b.split = 'train'),
lc AS (SELECT source, target, lag, CASE WHEN count(*) >= 3 AND stddev_pop(x) > 1e-12 * abs(avg(x)) AND stddev_pop(y) > 1e-12 * abs(avg(y)) THEN round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 9) END AS r FROM pr GROUP BY source, target, lag),
lg AS (SELECT source, target, CASE WHEN r IS NULL THEN 0 ELSE lag END AS lag, r FROM lc QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY abs(r) DESC NULLS LAST, abs(lag), lag DESC) = 1)"""


@_add("i6_selected_lags", f"{_WIDE}, {_lagged(30)} SELECT source, target, CAST(lag AS BIGINT) AS lag, round(r + 1e-10, 6) + 0.0 AS r FROM lg")
def _(spark, sf_dir):
    return regression.best_lags(_wide(spark, sf_dir).select("entity", "ts", F.col("T").alias("value"), "split"), range(-30, 31))


_DONORS = ", ".join(f"max(v) FILTER (nth = {i}) AS d{i}" for i in range(1, 6))


@_add("i6_donor_regression", f"""{_WIDE}, {_lagged(30)}, od AS (SELECT source, target, lag, row_number() OVER (PARTITION BY target ORDER BY source) AS nth FROM (SELECT a.entity AS source, b.entity AS target, lag FROM (SELECT DISTINCT entity FROM ob) a JOIN (SELECT DISTINCT entity FROM ob) b ON a.entity <> b.entity LEFT JOIN lg ON lg.source = a.entity AND lg.target = b.entity)),
dn AS (SELECT target AS entity, ts + CAST(lag AS INT) AS ts, {_DONORS} FROM od JOIN ob ON ob.entity = od.source GROUP BY ALL), feat AS (SELECT p.entity AS k, p.ts AS rid, p.split AS part, [{_SEASONS}, d1, d2, d3, d4, d5, "L"] AS x, "T" AS y FROM ph p LEFT JOIN dn ON dn.entity = p.entity AND dn.ts = p.ts), {_ridge(12)} {_SCORES}""", 3)
def _(spark, sf_dir):
    return scores(regression.donor_regression(_wide(spark, sf_dir), "T", _NAMES, range(-30, 31), ("L",)), "T")


@_add("i11_pooled_leave_one_out", f"""{_WIDE}, al AS (SELECT unnest([0.1, 1.0, 10.0])::DOUBLE AS alpha), hd AS (SELECT DISTINCT entity AS held FROM wide),
feat AS (SELECT held || '|' || alpha AS k, entity || ts AS rid, CASE WHEN entity = held THEN 'held ' || split ELSE split END AS part, [{_SEASONS}, "F", "L"] AS x, "T" AS y, alpha FROM ph, hd, al),
{_ridge(8, "any_value(CAST(split_part(a.k, '|', 2) AS DOUBLE))")}, ms AS (SELECT split_part(k, '|', 1) AS held, CAST(split_part(k, '|', 2) AS DOUBLE) AS alpha, avg((pred - y) * (pred - y)) AS e FROM fit WHERE part = 'validation' GROUP BY k),
best AS (SELECT held, alpha FROM ms QUALIFY row_number() OVER (PARTITION BY held ORDER BY e, alpha) = 1)
SELECT held AS entity, part[6:] AS split, alpha, count(*) AS days, count(y) AS n, round(sqrt(avg((pred - y) * (pred - y))) + 1e-10, 3) + 0.0 AS rmse, round(avg(pred - y) + 1e-10, 3) + 0.0 AS bias, round(avg(pred) + 1e-10, 3) + 0.0 AS mean_pred FROM fit JOIN best ON k = held || '|' || alpha WHERE part LIKE 'held %' GROUP BY held, part, alpha""", 3)
def _(spark, sf_dir):
    got = regression.pooled_leave_one_out(_wide(spark, sf_dir), "T", Design(("F", "L")))
    return scores(got, "T", "alpha")


# Learners with draws of their own have no twin: tests hold them against plainer fillers on held-out days.


@_add("i7_random_forest", None, 3)
def _(spark, sf_dir):
    wide, design = _wide(spark, sf_dir), Design(("F", "L"))
    return scores(trees.predict(wide, trees.fit(wide, "T", design, trees.forest()), design), "T")


@_add("i8_boosted_trees", None, 3)
def _(spark, sf_dir):
    wide, design = _wide(spark, sf_dir), Design(("F", "L"))
    return scores(trees.predict(wide, trees.fit(wide, "T", design, trees.boosting()), design), "T")
