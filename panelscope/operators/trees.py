"""Forest and boosted-tree fillers: Spark's own learners on the features of the ridge models."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.operators.regression import Design

SEED = 0


def forest(trees: int = 200, leaf: int = 2, depth: int = 10) -> RandomForestRegressor:
    """Trees are grown level by level over all rows, to ``depth`` levels."""
    return RandomForestRegressor(numTrees=trees, minInstancesPerNode=leaf, maxDepth=depth, seed=SEED)


def boosting(rounds: int = 300, depth: int = 4, step: float = 0.05, sample: float = 0.9) -> GBTRegressor:
    return GBTRegressor(maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=sample, seed=SEED)


def _numbered(df: DataFrame, design: Design) -> DataFrame:
    return df.withColumns({f"_x{i}": c for i, c in enumerate(design.columns())})


def fit(df: DataFrame, target: str, design: Design, learner, keys: tuple[str, ...] = ("entity",)) -> PipelineModel:
    """One model of a target for all entities, which are features too; ``df`` has ts, split, the
    design's columns and ``keys``. Learns from training days with a target; absent features
    count as their training median. The target must not be among the features."""
    if target in design.features:
        raise ValueError(f"{target} is forbidden in this model")
    names = [f"_x{i}" for i in range(len(design.names))]
    indexed = [f"_k{i}" for i in range(len(keys))]
    stages = [
        StringIndexer(inputCols=[*keys], outputCols=indexed, stringOrderType="alphabetAsc", handleInvalid="keep"),
        Imputer(inputCols=names, outputCols=names, strategy="median", relativeError=0.0),
        VectorAssembler(inputCols=[*indexed, *names], outputCol="_features"),
        learner.copy().setLabelCol(target).setFeaturesCol("_features").setPredictionCol("pred"),
    ]
    train = _numbered(df, design).where((F.col("split") == "train") & F.col(target).isNotNull())
    # which rows a tree draws depends on how they are dealt: by day, not by where they were read
    return Pipeline(stages=stages).fit(train.repartition("ts").sortWithinPartitions("ts", *keys))


def predict(df: DataFrame, model: PipelineModel, design: Design) -> DataFrame:
    """``df`` with ``pred`` for every row."""
    return model.transform(_numbered(df, design)).select(*df.columns, "pred")
