"""Distributed random forests on the RFM features."""

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame

from farebox.functions.fixed_values import SEED
from farebox.models.features import FEATURES
from farebox.operators.cycle import KEY

MAX_BINS = 128
MEMORY_MB = 512
SMALL_TASK_ROWS = 50_000
LARGE_TASK_ROWS = 250_000
MANY_TASKS = 1_000


def with_vector(profiles: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(profiles)


def training_tasks(n: int) -> int:
    """Partitions for n training rows: small ones up to a thousand, then larger ones."""
    return max(1, min(-(-n // SMALL_TASK_ROWS), MANY_TASKS), -(-n // LARGE_TASK_ROWS))


def training_layout(rows: DataFrame, n: int) -> DataFrame:
    """The n rows in a layout that depends on nothing but the rows.

    Bagging draws from one random stream per partition, so equal partitions in equal
    order give equal forests, on any cluster and however the rows were read.
    """
    partitions = training_tasks(n)
    order = [KEY, *[name for name in rows.columns if name not in (KEY, "features")]]
    return rows.repartition(partitions, KEY).sortWithinPartitions(*order)


def fit_forest(
    train: DataFrame,
    label: str,
    weight: str | None,
    trees: int,
    depth: int,
    min_leaf: int,
    seed: int = SEED,
) -> RandomForestClassificationModel:
    forest = RandomForestClassifier(
        featuresCol="features",
        labelCol=label,
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=min_leaf,
        featureSubsetStrategy="sqrt",
        maxBins=MAX_BINS,
        maxMemoryInMB=MEMORY_MB,
        seed=seed,
    )
    if weight is not None:
        forest = forest.setWeightCol(weight)
    return forest.fit(train)


def importances(model: RandomForestClassificationModel | None) -> list[tuple[str, float]]:
    """(feature, importance), most important first; nothing for a model without data."""
    if model is None:
        return []
    pairs = zip(FEATURES, model.featureImportances.toArray().tolist())
    return sorted(pairs, key=lambda pair: (-pair[1], pair[0]))


def size_of(model: RandomForestClassificationModel | None) -> tuple[int | None, ...]:
    """Trees, deepest tree, nodes in all, classes; nulls for a model that had no data."""
    if model is None:
        return None, None, None, None
    return model.getNumTrees, max(tree.depth for tree in model.trees), model.totalNumNodes, model.numClasses
