"""Cross-validation: folds by digest of the customer, metrics of each fold and their spread."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox.functions.fixed_values import HORIZONS, REPURCHASE_FOREST
from farebox.models.metrics import binary_metrics
from farebox.models.repurchase import fit_repurchase
from farebox.operators.cycle import KEY
from farebox.staging import stage

FOLDS = 3
METRICS = ["auc", "f1", "rmse"]


def fold_of(key: Column, k: int = FOLDS) -> Column:
    """0 to k - 1 from the key's digest, so all rows of a customer are in one fold. The digest
    is not that of the train / test split."""
    digest = F.md5(F.concat_ws(":", key, F.lit("fold")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % k).cast("int")


def fold_sizes(features: DataFrame, k: int = FOLDS) -> DataFrame:
    """Customers, lines and purchases of every fold that has rows. Counted by customer first,
    so a customer with many lines is combined before the shuffle."""
    own = features.groupBy(KEY).agg(F.count(F.lit(1)).alias("lines"), F.sum("purchases").alias("purchases"))
    return own.groupBy(fold_of(F.col(KEY), k).alias("fold")).agg(
        F.count(F.lit(1)).alias("customers"), F.sum("lines").alias("lines"), F.sum("purchases").alias("purchases")
    )


def squared_errors(scores: DataFrame, horizons: list[int] = HORIZONS) -> DataFrame:
    """``rmse`` of the probability against the label for each horizon, rows weighted by purchases."""
    cases = F.array(*[
        F.struct(
            F.lit(h).alias("horizon_days"), F.col(f"prob_{h}").alias("score"),
            F.col(f"will_buy_next_{h}_days").alias("label"), F.col("purchases").alias("n"),
        )
        for h in horizons
    ])
    miss = F.col("score") - F.col("label")
    rows = scores.select(F.inline(cases)).where("score IS NOT NULL")
    return rows.groupBy("horizon_days").agg(
        F.round(F.sqrt(F.sum(F.col("n") * miss * miss) / F.sum("n")), 9).alias("rmse")
    )


def fold_metrics(scores: DataFrame, k: int = FOLDS, horizons: list[int] = HORIZONS) -> DataFrame:
    """AUC, F1 and RMSE of every fold and horizon with rows; pass staged ``scores``."""
    parts = []
    for fold in range(k):
        own = scores.where(fold_of(F.col(KEY), k) == fold)
        found = binary_metrics(own, horizons).join(squared_errors(own, horizons), "horizon_days")
        parts.append(found.select(F.lit(fold).alias("fold"), "horizon_days", *METRICS))
    return reduce(DataFrame.unionByName, parts)


def fold_summary(metrics: DataFrame) -> DataFrame:
    """Mean and sample deviation of each metric over the folds, by horizon."""
    return metrics.groupBy("horizon_days").agg(
        F.count(F.lit(1)).alias("folds"),
        *[F.round(F.avg(m), 9).alias(f"mean_{m}") for m in METRICS],
        *[F.round(F.stddev_samp(m), 9).alias(f"deviation_{m}") for m in METRICS],
    )


def cross_validated_scores(features: DataFrame, k: int = FOLDS, forest: dict = REPURCHASE_FOREST) -> DataFrame:
    """Staged features with ``prob_<horizon>`` by forests that never saw the row's customer."""
    fold = fold_of(F.col(KEY), k)
    parts = [
        fit_repurchase(features, forest=forest, side=fold != i).score(features.where(fold == i)) for i in range(k)
    ]
    return stage(reduce(DataFrame.unionByName, parts), "fold-scores")
