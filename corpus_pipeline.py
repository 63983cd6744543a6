"""The corpus pipeline: documents in, packed training sequences out.

STAGES run in order; each works on all that its predecessor kept, and its result is
written as Parquet and read again as the next one's documents. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelscope.llm import decontamination, near_copies, packing, quality_cnn, quality_rules
from panelscope.llm._common import new_path, table
from panelscope.llm.records import vocabulary_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the convolutional classifier scores below its threshold go."""
    model = quality_cnn.fit(docs, table(spark, sf_dir, "labels"))
    return quality_cnn.with_score(docs, model, out="_ps_score").where(f"_ps_score >= {quality_cnn.THRESHOLD}").drop("_ps_score")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a risk-controlled rule rejects go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles are alike to 0.8 or more, the one with the smallest id stays."""
    return near_copies.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least a twentieth lies in benchmark windows go."""
    found = decontamination.with_contamination(docs, table(spark, sf_dir, "benchmark"), out="_ps_hit")
    return found.where(~decontamination.contaminated("_ps_hit")).drop("_ps_hit")


def curve_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, packed along the Hilbert curve."""
    return packing.pack(docs, vocabulary_path(packing.VOCABULARY), with_ids=False)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_decontamination),
    ("packing", curve_packing),
]
#: Learnt weights, SimHash and tokenisers have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
