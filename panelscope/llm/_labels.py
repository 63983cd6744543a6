"""Labelled rows to learn from: a bounded, hash-chosen sample of the training fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.llm._common import fold

#: Rows whose crc32(doc_id) mod FOLDS is HELD_OUT are never learnt from.
FOLDS, HELD_OUT = 4, 2
#: The most labelled rows a classifier is fitted on (in expectation; chosen by a hash of the id).
MAX_TRAIN_ROWS = 6000


def held_out(doc_id: str = "doc_id"):
    return fold(doc_id, FOLDS) == HELD_OUT


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_TRAIN_ROWS, shards: int = 8) -> DataFrame:
    """(text, y, shard) of labelled rows outside the held-out fold, about ``max_rows`` at most.

    Ids whose labels contradict each other, and null labels, teach nothing. Whole texts
    are kept. ``shard`` depends on the id alone.
    """
    usable = labels.where(~held_out()).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("_hi")).where("y = _hi and doc_id is not null").drop("_hi")
    n = usable.count()
    if n > max_rows:
        usable = usable.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) < int((1 << 20) * max_rows / n))
    usable = usable.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(shards)).cast("int"))
    # at most max_rows narrow rows: the documents need no shuffle to meet them
    return docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id").select("text", F.col("y").cast("int").alias("y"), "shard")
