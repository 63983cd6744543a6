"""Vector code compression: product codebooks by active-entry Lloyd.

Each vector becomes integers floor(SCALE * x) and is cut into equal consecutive parts; each
part position has a codebook of its own, which starts as that part of the vectors with the
smallest ids. An assignment gives every part its nearest entry and stores the entry's index
and exact squared distance. After the entries have moved, a part whose own entry stayed where
it was compares that stored distance with the moved entries alone, for the others were no
nearer before; a part whose entry moved looks at all of them. Ties go to the lower index in
both cases, so the codes are those of a complete comparison.

Entries are replaced by componentwise floor(sum / count) of their parts; sums are made by
partition and added by Spark, so that PARTS * ENTRIES rows reach the driver whatever the
table's size, and as many entries go out to the executors. Codes and distances lie in a
written table between the rounds.

Rows whose vector is null or holds null or non-finite components are dropped. Shorter vectors
count as zero beyond their end, up to the longest one's length rounded up to a multiple of
PARTS. Rows with a null id are coded but start no entry; rows that share an id start in the
order of their integers; fewer kept ids give fewer entries, and none at all (no codebook) an
empty result. Repeated rows are coded one by one and weigh as often. Components must be small
enough for exact 64-bit distances, else an error says so. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelscope.llm._common import discard, materialize, table

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
_CODED = "code binary, dist binary, error long"


def usable(vector: str):
    """Whether a vector takes part at all."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))


def integers(df: DataFrame, scale: int, id_col: str = "vec_id", vector_col: str = "embedding", multiple: int = 1) -> tuple[DataFrame, int, int]:
    """Rows with a usable vector, its integers floor(scale * x) as ``v`` (array<long>) padded
    with zeros to one width; that width; and the largest absolute integer."""
    kept = df.where(usable(vector_col)).withColumn("v", F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)))
    most, width = kept.agg(F.max(F.array_max(F.transform("v", F.abs))), F.max(F.size("v"))).first()
    width = -(-(width or 0) // multiple) * multiple
    short = F.size("v") < width
    padded = F.when(short, F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v")))).otherwise(F.col("v"))
    return kept.select(F.col(id_col).alias("vec_id"), *(c for c in ("label",) if c in df.columns), padded.alias("v")), width, int(most or 0)


def matrix(column: pa.Array, width: int, kind=np.int64) -> np.ndarray:
    """The rows of a list column, all of one length, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(kind)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of parts (n, d) from entries (k, d); whole numbers, exact in the given kind."""
    return (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)


def assign(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part, the lower index on ties, and its squared distance."""
    d = distances(x, entries)
    code = d.argmin(1)
    return code, d[np.arange(len(x)), code]


def reassign(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``assign``, from each part's last entry and its distance. ``moved``: which entries did."""
    code, dist, on = code.copy(), dist.copy(), np.flatnonzero(moved)
    if not len(on):
        return code, dist
    lost = moved[code]
    code[lost], dist[lost] = assign(x[lost], entries)
    fixed = np.flatnonzero(~lost)
    d = distances(x[fixed], entries[on])
    best = d.argmin(1)
    near, entry = d[np.arange(len(fixed)), best], on[best]
    wins = (near < dist[fixed]) | (near == dist[fixed]) & (entry < code[fixed])
    code[fixed[wins]], dist[fixed[wins]] = entry[wins], near[wins]
    return code, dist


def _coded(rows: DataFrame, width: int, kind, entries: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """``rows`` with code (one byte a part), dist (a long a part) and error (their sum), anew or from those they have."""
    parts, d = len(entries), width // len(entries)
    made = T._parse_datatype_string(_CODED)
    fields = T.StructType([*(f for f in rows.schema if f.name not in made.names), *made])
    names = fields.names
    held = rows.sparkSession.sparkContext.broadcast((entries.astype(kind), moved))

    def run(batches):
        book, gone = held.value
        for b in batches:
            n = len(b)
            x = matrix(b.column("v"), width, kind).reshape(n, parts, d)
            if gone is not None:
                old, far = (np.frombuffer(b"".join(b.column(c).to_pylist()), k).reshape(n, parts) for c, k in (("code", np.uint8), ("dist", "<i8")))
            code, dist = np.zeros((n, parts), np.int64), np.zeros((n, parts), np.int64)
            for p in range(parts):
                code[:, p], dist[:, p] = assign(x[:, p], book[p]) if gone is None else reassign(x[:, p], book[p], gone[p], old[:, p].astype(np.int64), far[:, p].astype(kind))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:-3]), rows_of(code.astype(np.uint8)), rows_of(dist.astype("<i8")), pa.array(dist.sum(1))], names=names)

    return rows.mapInArrow(run, fields)


def rows_of(values: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    size = values.shape[1] * values.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(values), [None, pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary()) if len(values) else pa.array([], pa.binary())


def _sums(coded: DataFrame, width: int, parts: int, entries: int) -> DataFrame:
    """(part, entry, n, sums) over all rows: a row for each entry and task before the shuffle."""
    d = width // parts

    def run(batches):
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, d), np.int64)
        for b in batches:
            x = matrix(b.column("v"), width).reshape(len(b), parts, d)
            code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(b), parts)
            for p in range(parts):
                n[p] += np.bincount(code[:, p], minlength=entries)
                np.add.at(total[p], code[:, p], x[:, p])
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(n[part, entry]), pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    made = coded.select("v", "code").mapInArrow(run, "part long, entry long, n long, sums array<long>")
    return made.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(d))).alias("sums"))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, label if there is one, code, dist, error) and the final codebooks (part, entry, component)."""
    if entries > 256:
        raise ValueError("a code is one byte a part")
    rows, width, most = integers(vectors, scale, id_col, vector_col, parts)
    if width * (2 * most) ** 2 >= 1 << 63:
        raise ValueError("components are too large for exact distances in 64 bits")
    kind = np.float64 if width * (2 * most) ** 2 < 1 << 53 else np.int64  # both exact; products of doubles are faster
    rows = materialize(rows, "integers")
    first = rows.where("vec_id is not null").orderBy("vec_id", "v").select("v").limit(entries).collect()
    book = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2)
    if not len(first):
        return rows.where("false").select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(_CODED))).drop("v"), book
    now, moved = materialize(_coded(rows, width, kind, book, None), "codes"), None
    discard(rows)
    for _ in range(rounds):
        then = book.copy()
        for r in _sums(now, width, parts, len(first)).collect():  # at most parts * entries
            then[r["part"], r["entry"]] = [s // r["n"] for s in r["sums"]]
        moved, book, old = (then != book).any(2), then, now
        now = materialize(_coded(old, width, kind, book, moved), "codes")
        discard(old)
    return now.drop("v"), book


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, book = compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    coded = coded.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_ps_label")
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    found = coded.join(by_label, F.col("label").eqNullSafe(F.col("_ps_label")))
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


_START = f"""
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT r, p, v[p * len(v) // {PARTS} + 1:(p + 1) * len(v) // {PARTS}] AS x FROM kept, range({PARTS}) AS t(p)),
book0 AS MATERIALIZED (
  SELECT p, e, x FROM parts JOIN (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM kept WHERE vec_id IS NOT NULL QUALIFY e < {ENTRIES}) USING (r))"""


def _assigned(k: int) -> str:
    return f"""
near{k} AS MATERIALIZED (
  SELECT r, p, arg_min(e, d * {ENTRIES} + e) AS e, min(d) AS d FROM (
    SELECT r, p, e, list_sum(list_transform(range(1, len(a.x) + 1), lambda i: (a.x[i] - b.x[i]) * (a.x[i] - b.x[i])))::BIGINT AS d
    FROM parts a JOIN book{k} b USING (p)) GROUP BY r, p)"""


def _moved(k: int) -> str:
    return f"""
mean{k} AS MATERIALIZED (
  SELECT p, e, list(m ORDER BY i) AS x FROM (
    SELECT p, e, i, floor(sum(x[i]) / count(*))::BIGINT AS m FROM near{k} JOIN parts USING (r, p), range(1, (SELECT max(len(x)) FROM parts) + 1) AS t(i) GROUP BY p, e, i) GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN mean{k} m USING (p, e))"""


SQL = f"""
WITH {_START}, {",".join(f"{_assigned(k)}, {_moved(k)}" for k in range(ROUNDS))}, {_assigned(ROUNDS)},
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} JOIN kept USING (r) GROUP BY r, vec_id, label),
digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, digest
"""
