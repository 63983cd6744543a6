"""Exact inner-product search over a pivot-distance index.

Vectors become integers floor(SCALE * x). Each is keyed by its nearest pivot and its distance
from it; a range sort by that key is cut into annuli, blocks of at most BLOCK vectors of one
pivot, each with its inner and outer radius, largest norm and smallest id. For a query q at
distance d from the pivot p, no vector x of an annulus from r to R with norms up to n scores
above either of

    q.p + |q| R    and    (|q|^2 + n^2 - g^2) / 2,  g = max(0, d - R, r - d) <= |q - x|

the second by the triangle inequality. A query takes its annuli in the order of this bound, a
few, then more, then all that are left (WIDTHS), and stops at the first that cannot better its
K-th score, or that could only tie it with larger ids. So the answer is exact, whatever the
pivots; they are fitted on the SAMPLE vectors with the smallest hashes, and every vector is
indexed.

Queries come in blocks of up to QUERIES, the catalogue of annuli in chunks of about CHUNK, and
annuli meet the query blocks that still want them in joins on their numbers; neither the
queries, the catalogue nor the answers of all queries are ever in one task or on the driver.
Copies of one vector fill as many annuli as they need, and an annulus whose ids are all too
large for a tie is not read.

Queries are the rows whose id is divisible by EVERY. Candidates are all rows but the query's
own: another row with the same id is one. Vectors null or holding null or non-finite
components take no part; shorter ones count as zero beyond their end (if all are empty, there
is no result). A null id is no query
and, as a candidate, comes after all others (ids are below 2^63 - 1). Components must be small
enough for exact 64-bit sums, else an error says so. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelscope.llm._common import discard, materialize, table
from panelscope.llm.vector_codes import distances, integers, matrix

SCALE, K, EVERY = 1024, 10, 100
PIVOTS, SAMPLE, FIT_ROUNDS = 64, 4096, 8
BLOCK, QUERIES, CHUNK = 1024, 256, 4096
#: Annuli that each query takes in a round; None: all that its bound still allows.
WIDTHS = (4, 32, None)
_NO_ID = (1 << 63) - 1
_LOW = -(1 << 62)


def fit_pivots(rows: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Whole-number centres of a bounded sample: distinct vectors, then rounds of k-means."""
    picked = rows.select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h", "v").limit(sample).collect()
    x = np.unique(np.array([r["v"] for r in picked], np.int64).reshape(len(picked), -1), axis=0)
    centres = x[np.random.default_rng(7).permutation(len(x))[:pivots]]
    for _ in range(FIT_ROUNDS):
        near = distances(x.astype(float), centres.astype(float)).argmin(1)
        centres = np.array([x[near == i].mean(0).round() if (near == i).any() else c for i, c in enumerate(centres)], np.int64).reshape(centres.shape)
    return np.unique(centres, axis=0)


class Kind:
    """How integers of up to ``most`` in ``width`` components are stored, and multiplied exactly."""

    def __init__(self, width: int, most: int):
        if 4 * width * most * most >= 1 << 62:
            raise ValueError("components are too large for exact sums in 64 bits")
        self.width = width
        self.stored = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
        self.exact = np.float64 if 4 * width * most * most < 1 << 53 else np.int64

    def read(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, self.stored).reshape(-1, max(self.width, 1)).astype(self.exact)


def annuli(rows: DataFrame, pivots: np.ndarray, kind: Kind, size: int = BLOCK) -> DataFrame:
    """The index: block, pivot, inner, outer, norm, least (id), n, ids, v (matrix as bytes)."""

    def keyed(batches):
        centres = pivots.astype(kind.exact)
        for b in batches:
            d = distances(matrix(b.column("v"), kind.width, kind.exact), centres)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near].astype(np.int64))], names=["vec_id", "v", "pivot", "d2"])

    def cut(batches):
        part, made, held = TaskContext.get().partitionId() << 32, 0, None
        for b in batches:
            now = [b.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "pivot", "d2")] + [matrix(b.column("v"), kind.width)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            at, out = 0, []
            while at < len(held[0]):
                to = min(at + size, int(np.searchsorted(held[1], held[1][at], "right")))
                if to == len(held[0]) and to - at < size:
                    break  # the next batch may go on with it
                out.append([x[at:to] for x in held])
                at = to
            held = [x[at:] for x in held]
            for x in out:
                yield block(part + made, *x)
                made += 1
        if held is not None and len(held[0]):
            yield block(part + made, *held)

    def block(number, ids, pivot, d2, v):
        norm = float(np.sqrt((v.astype(float) ** 2).sum(1).max()))
        values = [number, int(pivot[0]), float(np.sqrt(d2[0])), float(np.sqrt(d2[-1])), norm, int(ids.min()), len(ids), ids.tolist(), v.astype(kind.stored).tobytes()]
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, values, strict=True))], schema)

    schema = pa.schema([("block", pa.int64()), ("pivot", pa.int32()), ("inner", pa.float64()), ("outer", pa.float64()), ("norm", pa.float64()), ("least", pa.int64()), ("n", pa.int32()), ("ids", pa.list_(pa.int64())), ("v", pa.binary())])
    near = rows.withColumn("vec_id", F.coalesce(F.col("vec_id").cast("long"), F.lit(_NO_ID))).select("vec_id", "v").mapInArrow(keyed, "vec_id long, v array<long>, pivot int, d2 long")
    order = ["pivot", "d2", "vec_id"]
    return near.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, "block long, pivot int, inner double, outer double, norm double, least long, n int, ids array<long>, v binary")


def query_blocks(index: DataFrame, every: int = EVERY, size: int = QUERIES) -> DataFrame:
    """queries, ids, own (block), at (row of it), v: the rows to search for, neighbours together."""

    def run(batches):
        part, made, held, n = TaskContext.get().partitionId() << 32, 0, [], 0
        for b in batches:
            for block, ids, v in zip(b.column("block").to_pylist(), b.column("ids").to_pylist(), b.column("v").to_pylist(), strict=True):
                step = len(v) // len(ids)
                for at, i in enumerate(ids):
                    if i % every == 0 and i != _NO_ID:
                        held.append((i, block, at, v[at * step : (at + 1) * step]))
                while len(held) >= size:
                    yield out(part + made, held[:size])
                    held, made = held[size:], made + 1
        if held:
            yield out(part + made, held)

    def out(number, rows):
        ids, own, at, v = zip(*rows, strict=True)
        return pa.RecordBatch.from_pylist([{"queries": number, "ids": ids, "own": own, "at": at, "v": b"".join(v)}], schema)

    schema = pa.schema([("queries", pa.int64()), ("ids", pa.list_(pa.int64())), ("own", pa.list_(pa.int64())), ("at", pa.list_(pa.int32())), ("v", pa.binary())])
    return index.select("block", "ids", "v").mapInArrow(run, "queries long, ids array<long>, own array<long>, at array<int>, v binary")


def bounds(q: np.ndarray, pivots: np.ndarray, pivot, inner, outer, norm) -> np.ndarray:
    """No vector of annulus j scores above [i, j] with query i. Whole numbers, with room for rounding."""
    q, pivots = q.astype(float), pivots.astype(float)
    norm2 = (q * q).sum(1)[:, None]
    d = np.sqrt(np.maximum(distances(q, pivots), 0))[:, pivot]
    gap = np.maximum(np.maximum(d - outer, inner - d), 0)
    upper = np.minimum((q @ pivots.T)[:, pivot] + np.sqrt(norm2) * outer, (norm2 + norm * norm - gap * gap) / 2)
    return np.floor(upper + 1e-6 + 1e-12 * (norm2 + norm * norm)).astype(np.int64)


def _wanted(queries: DataFrame, catalogue: DataFrame, chunks: int, pivots: np.ndarray, kind: Kind, width: int | None, k: int) -> DataFrame:
    """The next annuli of each query, by bound, smallest id and number: (queries, which, block,
    bound, least), or without a width (queries, block, which as an array).

    ``queries`` has per query its K-th score and id so far (floor, floor_id), and the key of the
    last annulus it took (last: bound, least, block), as arrays beside ids.
    """

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                c = {x: np.array([y[x] for y in r["blocks"]]) for x in ("block", "pivot", "inner", "outer", "norm", "least", "n")}
                u = bounds(kind.read(r["v"]), pivots, c["pivot"], c["inner"], c["outer"], c["norm"])
                low, low_id, u1, l1, b1 = (np.array(r[x], np.int64)[:, None] for x in ("floor", "floor_id", "last_bound", "last_least", "last_block"))
                on = (u > low) | (u == low) & (c["least"] < low_id)
                on &= (u < u1) | (u == u1) & ((c["least"] > l1) | (c["least"] == l1) & (c["block"] > b1))
                if width is None:
                    at = np.flatnonzero(on.any(0))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), r["queries"])), pa.array(c["block"][at]), pa.array([np.flatnonzero(x) for x in on.T[at]], pa.list_(pa.int64()))], names=["queries", "block", "which"])
                    continue
                took = []
                for i, x in enumerate(on):
                    x = np.flatnonzero(x)
                    x = x[np.lexsort((c["block"][x], c["least"][x], -u[i, x]))]
                    enough = int(np.searchsorted(np.cumsum(c["n"][x]), k + 1)) + 1
                    x = x[: max(width, enough)]
                    took.append(np.stack([np.full(len(x), i), c["block"][x], u[i, x], c["least"][x], c["n"][x]]))
                cols = np.concatenate(took, 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(cols.shape[1], r["queries"])), *map(pa.array, cols)], names=["queries", "which", "block", "bound", "least", "n"])

    # every query block meets every chunk of the catalogue once
    keys = int(catalogue.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64("queries"), F.lit(max(1, keys // chunks))).cast("int")
    asked = queries.drop("ids", "own", "at").withColumn("salt", salt).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    salted = catalogue.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(max(1, keys // chunks) - 1))))
    met = asked.join(salted, ["chunk", "salt"]).drop("chunk", "salt")
    if width is None:
        return met.mapInArrow(run, "queries long, block long, which array<long>")
    found = met.mapInArrow(run, "queries long, which long, block long, bound long, least long, n long")
    order = Window.partitionBy("queries", "which").orderBy(F.desc("bound"), "least", "block")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.withColumns({"nth": F.row_number().over(order), "before": before}).where(f"nth <= {width} or before <= {k}").drop("nth", "before")


def _scores(wanted: DataFrame, queries: DataFrame, index: DataFrame, kind: Kind, k: int) -> DataFrame:
    """(queries, which, score, vec_id): of each annulus the best rows that a query's floor lets in."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                ids, on = np.array(r["b_ids"], np.int64), np.array(r["which"], np.int64)
                s = (kind.read(r["v"])[on] @ kind.read(r["b_v"]).T).astype(np.int64)
                for row, i in enumerate(on):
                    if r["own"][i] == r["block"]:
                        s[row, r["at"][i]] = _LOW - 1
                floor, floor_id = (np.array(r[x], np.int64)[on][:, None] for x in ("floor", "floor_id"))
                row, at = np.nonzero((s > floor) | (s == floor) & (ids < floor_id))
                score, vec = s[row, at], ids[at]
                order = np.lexsort((vec, -score, row))
                row, score, vec = row[order], score[order], vec[order]
                few = np.arange(len(row)) - np.searchsorted(row, row) < k
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(few.sum()), r["queries"])), pa.array(on[row[few]]), pa.array(score[few]), pa.array(vec[few])], names=["queries", "which", "score", "vec_id"])

    if dict(wanted.dtypes)["which"] == "bigint":
        wanted = wanted.groupBy("queries", "block").agg(F.collect_list("which").alias("which"))  # at most QUERIES
    met = wanted.join(queries.select("queries", "own", "at", "v", "floor", "floor_id"), "queries").join(index.select("block", F.col("ids").alias("b_ids"), F.col("v").alias("b_v")), "block")
    return met.mapInArrow(run, "queries long, which long, score long, vec_id long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("queries", "which").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")


def _with_state(queries: DataFrame, best: DataFrame | None, wanted: DataFrame | None, k: int) -> DataFrame:
    """Query blocks with floor, floor_id and last_* as arrays in the order of ids."""
    plain = queries.select("queries", "ids", "own", "at", "v")
    low, top = F.lit(_LOW).cast("long"), F.lit(_NO_ID).cast("long")
    each = F.size("ids")
    if best is None:
        return plain.withColumns({"floor": F.array_repeat(low, each), "floor_id": F.array_repeat(top, each), "last_bound": F.array_repeat(top, each), "last_least": F.array_repeat(low, each), "last_block": F.array_repeat(low, each)})
    floors = best.where(f"rank = {k}").select("queries", "which", F.struct("score", "vec_id").alias("floor"))
    last = wanted.groupBy("queries", "which").agg(F.max(F.struct((-F.col("bound")).alias("down"), "least", "block")).alias("last"))
    known = last.join(floors, ["queries", "which"], "left").groupBy("queries").agg(F.map_from_entries(F.collect_list(F.struct("which", F.struct("floor", "last").alias("state")))).alias("state"))
    at = lambda path, other: F.transform(F.sequence(F.lit(0), each - 1), lambda i: F.coalesce(path(F.col("state")[i.cast("long")]), other))
    return plain.join(known, "queries", "left").select(
        *plain.columns,
        at(lambda s: s["floor"]["score"], low).alias("floor"),
        at(lambda s: s["floor"]["vec_id"], top).alias("floor_id"),
        # a query that wanted nothing has nothing left to want
        at(lambda s: -s["last"]["down"], low).alias("last_bound"),
        at(lambda s: s["last"]["least"], top).alias("last_least"),
        at(lambda s: s["last"]["block"], top).alias("last_block"),
    )


def search(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, block: int = BLOCK, chunk: int = CHUNK, widths: tuple = WIDTHS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest scores of every query row."""
    rows, width, most = integers(vectors, scale, id_col, vector_col)
    kind = Kind(width, most)
    if not width:  # no usable vector has a component
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = materialize(rows.select("vec_id", "v"), "integers")
    centres = fit_pivots(rows, pivots)
    index = materialize(annuli(rows, centres, kind, block), "annuli")
    discard(rows)
    queries = materialize(_with_state(query_blocks(index, every), None, None, k), "queries")
    chunks = max(1, -(-index.count() // chunk))
    entry = F.struct("block", "pivot", "inner", "outer", "norm", "least", "n")
    catalogue = materialize(index.groupBy(F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int").alias("chunk")).agg(F.collect_list(entry).alias("blocks")), "catalogue")
    best = None
    for w in widths:
        wanted = materialize(_wanted(queries, catalogue, chunks, centres, kind, w, k), "wanted")
        found = _scores(wanted, queries, index, kind, k)
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        now = materialize(_best(found, k), "best")
        if w is not widths[-1]:
            then = materialize(_with_state(queries, now, wanted, k), "queries")
            discard(queries)
            queries = then
        discard(best)
        discard(wanted)
        best = now
    asked = queries.select("queries", F.posexplode("ids").alias("which", "query_id"))
    named = F.when(F.col("vec_id") != _NO_ID, F.col("vec_id")).alias("vec_id")
    return best.join(asked.withColumn("which", F.col("which").cast("long")), ["queries", "which"]).select("query_id", F.col("rank").cast("int").alias("rank"), named, "score")


def op13_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM kept q JOIN kept c ON q.vec_id % {EVERY} = 0 AND q.r <> c.r)
SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored
QUALIFY rank <= {K}
"""
