"""What the corpus operators share: the shared folder, written tables, folds, global offsets."""

from __future__ import annotations

import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text is split on these six characters wherever a contract says ``[^\x20\x09-\x0D]+``;
#: ``bytes.split()`` splits on exactly them.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def words_of(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words of a text as UTF-8 bytes; null has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a purely local session (``local[n]``: one process) may fall back to a
    temporary folder of its own; a cluster without the setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir().rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES`` in this session, unless it has a bound of its own:
    ten thousand long texts at once would not fit beside each other in a task's memory."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def new_path(spark: SparkSession, what: str) -> str:
    bound_batches(spark)
    return f"{shared_dir(spark)}/panelscope-{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage so that the loss of an executor never recomputes more than
    one step, and so that no later job repeats the work.
    """
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._ps_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table that ``materialize`` wrote and that nothing reads any more."""
    path = getattr(df, "_ps_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, modulus: int):
    """crc32 of the id as text (null: empty), modulo ``modulus``."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def global_offsets(df: DataFrame, order: list[str], size: str, out: str, what: str) -> tuple[DataFrame, int]:
    """Add ``out``: the sum of ``size`` over all rows before this one in ``order``.

    One range shuffle of the given (narrow) rows, a running sum inside each range,
    and one total per range; no task ever sees more than one range. ``order`` should
    end in columns that split ties, so that no value fills a range by itself.
    Returns the written table and the grand total.
    """
    fields = df.schema.fields + [T.StructField("_range", T.IntegerType()), T.StructField("_before", T.LongType())]
    at = df.columns.index(size)

    def running(batches):
        rng, before = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = before + np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(len(n), rng, np.int32)), pa.array(ends - n)],
                names=[*b.schema.names, "_range", "_before"],
            )
            before = int(ends[-1]) if len(n) else before

    local = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(running, T.StructType(fields)), what)
    totals = sorted((r["_range"], int(r["n"])) for r in local.groupBy("_range").agg(F.sum(size).alias("n")).collect())
    base, total = [], 0
    for rng, n in totals:
        base.append((rng, total))
        total += n
    spark = df.sparkSession
    starts = spark.createDataFrame(base, "_range int, _base long")  # one row per range
    out_df = local.join(F.broadcast(starts), "_range").withColumn(out, F.col("_before") + F.col("_base")).drop("_range", "_before", "_base")
    return out_df, total


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
