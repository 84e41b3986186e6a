"""How many days until a customer buys again: boosted regression trees and its metrics."""

from dataclasses import dataclass

from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.functions.fixed_values import SEED
from farebox.models.features import in_training
from farebox.models.forest import MAX_BINS, MEMORY_MB, training_layout, with_vector
from farebox.operators.cycle import KEY, NEXT_GAP

ROUNDS, DEPTH, STEP = 20, 4, 0.2


@dataclass
class DaysModel:
    """The fitted trees (None without training rows) and the mean of the training side."""

    trees: GBTRegressionModel | None
    mean_days: float | None

    def score(self, profiles: DataFrame) -> DataFrame:
        """``predicted_days`` for any frame with recency, frequency and monetary, never below
        0; null where there was nothing to learn from."""
        if self.trees is None:
            return profiles.withColumn("predicted_days", F.lit(None).cast("double"))
        found = self.trees.transform(with_vector(profiles))
        return found.select(*profiles.columns, F.greatest("prediction", F.lit(0.0)).alias("predicted_days"))


def fit_days(features: DataFrame, rounds: int = ROUNDS, depth: int = DEPTH) -> DaysModel:
    """Fit on the training side of staged features, each line as often as it stands for."""
    train = features.where(in_training(F.col(KEY)))
    sizes = train.agg(
        F.count(F.lit(1)).alias("lines"),
        (F.sum(F.col(NEXT_GAP) * F.col("purchases")) / F.sum("purchases")).alias("mean"),
    ).first()
    if not sizes["lines"]:
        return DaysModel(None, None)
    rows = with_vector(train).select(KEY, "features", F.col(NEXT_GAP).cast("double").alias("label"), "purchases")
    trees = GBTRegressor(
        featuresCol="features", labelCol="label", weightCol="purchases", maxIter=rounds, maxDepth=depth,
        stepSize=STEP, maxBins=MAX_BINS, maxMemoryInMB=MEMORY_MB, seed=SEED,
    )
    return DaysModel(trees.fit(training_layout(rows, sizes["lines"])), sizes["mean"])


def days_metrics(scores: DataFrame) -> DataFrame:
    """RMSE and MAE of ``predicted_days`` on the test side, beside those of always naming the
    mean of the training side; one row. Lines count as often as they stand for. Null where a
    side has no rows or no predictions."""
    side, n, days = in_training(F.col(KEY)), F.col("purchases"), F.col(NEXT_GAP)
    mean = scores.where(side).agg((F.sum(days * n) / F.sum(n)).alias("x")).scalar()
    test = scores.where(~side).withColumn("mean_days", mean)

    def rmse(guess: str):
        return F.round(F.sqrt(F.sum(n * (F.col(guess) - days) * (F.col(guess) - days)) / F.sum(n)), 6)

    def mae(guess: str):
        return F.round(F.sum(n * F.abs(F.col(guess) - days)) / F.sum(n), 6)

    return test.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("test_rows"),
        rmse("predicted_days").alias("rmse"), mae("predicted_days").alias("mae"),
        rmse("mean_days").alias("rmse_of_mean"), mae("mean_days").alias("mae_of_mean"),
    )
