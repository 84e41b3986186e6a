"""Will a customer buy again within 7, 15 or 30 days?"""

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.functions.fixed_values import HORIZONS, MIN_LABELLED_ROWS, REPURCHASE_FOREST
from farebox.functions.measures import literal_rows
from farebox.models.features import FEATURES, LABELS, in_training
from farebox.models.forest import (
    fit_forest,
    importances,
    size_of,
    training_layout,
    with_vector,
)
from farebox.models.metrics import binary_metrics
from farebox.operators.cycle import KEY


@dataclass
class RepurchaseModels:
    """One fitted forest per horizon (None without training rows) and the sizes they were
    fitted on."""

    forests: dict[int, RandomForestClassificationModel | None]
    labelled_rows: int
    train_rows: int
    test_rows: int

    def score(self, profiles: DataFrame) -> DataFrame:
        """``prob_<horizon>`` for any frame with recency, frequency and monetary; null where
        there was nothing to learn from."""
        scored = with_vector(profiles)
        for horizon, forest in self.forests.items():
            if forest is None:
                scored = scored.withColumn(f"prob_{horizon}", F.lit(None).cast("double"))
                continue
            named = forest.copy()
            named.setRawPredictionCol(f"raw_{horizon}")
            named.setProbabilityCol(f"both_{horizon}")
            named.setPredictionCol("")
            scored = named.transform(scored).withColumn(
                f"prob_{horizon}", _of_class_one(f"both_{horizon}")
            )
        return scored.select(*profiles.columns, *[f"prob_{h}" for h in self.forests])


def _of_class_one(probability: str):
    # A forest that saw one class only has a one-element probability.
    return F.coalesce(F.get(vector_to_array(probability), F.lit(1)), F.lit(0.0))


def fit_repurchase(
    features: DataFrame,
    horizons: list[int] = HORIZONS,
    forest: dict = REPURCHASE_FOREST,
    side: Column | None = None,
) -> RepurchaseModels:
    """Fit one forest per horizon on the training side, or on the rows ``side`` names. Pass
    staged features.

    The forests share one cached training set and are fitted side by side.
    """
    side = in_training(F.col(KEY)) if side is None else side
    sizes = features.agg(
        F.coalesce(F.sum("purchases"), F.lit(0)).alias("all"),
        F.coalesce(F.sum(F.when(side, F.col("purchases"))), F.lit(0)).alias("train"),
        F.count_if(side).alias("train_lines"),
    ).first()
    if not sizes["train"]:
        return RepurchaseModels(dict.fromkeys(horizons), sizes["all"], 0, sizes["all"])
    train = training_layout(
        with_vector(features.where(side)).select(KEY, "features", *LABELS, "purchases"),
        sizes["train_lines"],
    ).persist()
    try:
        with ThreadPool(len(horizons)) as pool:
            fitted = pool.map(
                lambda h: fit_forest(train, f"will_buy_next_{h}_days", "purchases", **forest),
                horizons,
            )
    finally:
        train.unpersist()
    return RepurchaseModels(
        dict(zip(horizons, fitted)), sizes["all"], sizes["train"], sizes["all"] - sizes["train"]
    )


def repurchase_model(spark: SparkSession, models: RepurchaseModels) -> DataFrame:
    rows = [
        (horizon, *size_of(forest), models.train_rows, models.test_rows)
        for horizon, forest in models.forests.items()
    ]
    return literal_rows(
        spark,
        rows,
        {
            "horizon_days": "int",
            "trees": "int",
            "depth": "int",
            "nodes": "int",
            "classes": "int",
            "train_rows": "bigint",
            "test_rows": "bigint",
        },
    )


def repurchase_importance(spark: SparkSession, models: RepurchaseModels) -> DataFrame:
    rows = [
        (horizon, position, feature, value)
        for horizon, forest in models.forests.items()
        for position, (feature, value) in enumerate(importances(forest), start=1)
    ]
    return literal_rows(
        spark,
        rows,
        {"horizon_days": "int", "position": "int", "feature": "string", "importance": "double"},
    )


def repurchase_scores(models: RepurchaseModels, features: DataFrame) -> DataFrame:
    """Every labelled customer with actual labels and predicted probabilities."""
    return models.score(features)


def repurchase_metrics(models: RepurchaseModels, scores: DataFrame) -> DataFrame:
    """AUC, F1 of "buys" at 0.5 and AUC of the yes/no answers on the test side.

    AUC is null where the test side has one class only, and all three are null where there
    is no model or no test row.
    """
    test = scores.where(~in_training(F.col(KEY)))
    rows = [
        (
            horizon,
            models.labelled_rows,
            models.train_rows,
            models.test_rows,
            models.labelled_rows >= MIN_LABELLED_ROWS,
        )
        for horizon in models.forests
    ]
    sizes = literal_rows(
        scores.sparkSession,
        rows,
        {
            "horizon_days": "int",
            "labelled_rows": "bigint",
            "train_rows": "bigint",
            "test_rows": "bigint",
            "enough_data": "boolean",
        },
    )
    # At most one row per horizon on either side.
    measured = F.broadcast(binary_metrics(test, list(models.forests)))
    return sizes.join(measured, "horizon_days", "left").select(
        "horizon_days", "auc", "f1", "auc_of_answers", *sizes.columns[1:]
    )


def top_repurchase_customers(
    scores: DataFrame, segments: DataFrame, horizon: int = 15, k: int = 10
) -> DataFrame:
    """The k labelled customers most likely to buy within the horizon, with segment.
    Only the k rows found meet the segments."""
    probability = f"prob_{horizon}"
    best = (
        scores.orderBy(F.desc(probability), KEY, "days_until_next_purchase")
        .limit(k)
        .select(KEY, probability)
    )
    return F.broadcast(best).join(segments.select(KEY, "Segment", *FEATURES), KEY)
