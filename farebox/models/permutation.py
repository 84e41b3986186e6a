"""Permutation importance: how much worse a score gets when one feature is mixed among rows.

Any score will do, with or without a model. A feature is mixed by a true permutation of all
rows: every row has a place in the order of one digest and takes the value of the row that
has the same place in the order of another. Places come from range blocks, so no task sorts
all rows, and they depend on the rows alone.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farebox.functions.fixed_values import HORIZONS
from farebox.models.features import FEATURES
from farebox.models.folds import squared_errors
from farebox.models.metrics import binary_metrics
from farebox.operators.cycle import KEY
from farebox.staging import stage

DAYS = "days_until_next_purchase"


def with_place(rows: DataFrame, salt: str) -> DataFrame:
    """``rows`` with their ``place``, from 0, in the order of a digest of customer and days.

    A customer's rows have different days, so a customer with many rows is spread as well.
    """
    order = ["_digest", KEY, DAYS, *[c for c in rows.columns if c not in (KEY, DAYS)]]
    digest = F.md5(F.concat_ws(":", KEY, DAYS, F.lit(salt)))
    blocks = rows.withColumn("_digest", digest).repartitionByRange(*order)
    blocks = stage(blocks.withColumn("_block", F.spark_partition_id()), f"places-{salt}")
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    starts = blocks.groupBy("_block").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy("_block").orderBy(*order)) - 1
    placed = blocks.join(F.broadcast(starts), "_block").withColumn("place", F.col("_start") + nth)
    return placed.select(*rows.columns, "place")


def with_mixed_features(rows: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """``rows`` with ``mixed_<feature>``, the feature of some row; every row gives it once."""
    out = with_place(rows, "rows")
    for feature in features:
        givers = with_place(rows.select(KEY, DAYS, feature), feature)
        out = out.join(givers.select("place", F.col(feature).alias(f"mixed_{feature}")), "place")
    return out.drop("place")


def permutation_importance(
    rows: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    features: list[str] = FEATURES,
    horizons: list[int] = HORIZONS,
) -> DataFrame:
    """What AUC and F1 lose, and RMSE gains, by mixing each feature; for every horizon.

    ``score`` adds ``prob_<horizon>`` to a frame with the features and must keep the other
    columns. Pass labelled rows the score has not seen, staged. Drops below zero mean that
    the feature did harm. Without rows, or with null scores only, the result is empty.
    """
    mixed = stage(with_mixed_features(rows, features), "mixed-features")

    def measured(frame: DataFrame) -> DataFrame:
        scores = score(frame)
        return binary_metrics(scores, horizons).join(squared_errors(scores, horizons), "horizon_days")

    whole = stage(measured(mixed), "unmixed-metrics").select(  # a row a horizon
        "horizon_days", *[F.col(c).alias(f"whole_{c}") for c in ("auc", "f1", "rmse")]
    )
    parts = [
        measured(mixed.withColumn(feature, F.col(f"mixed_{feature}")))
        .join(F.broadcast(whole), "horizon_days")
        .select(
            "horizon_days", F.lit(feature).alias("feature"), "auc",
            (F.col("whole_auc") - F.col("auc")).alias("auc_drop"),
            (F.col("whole_f1") - F.col("f1")).alias("f1_drop"),
            F.round(F.col("rmse") - F.col("whole_rmse"), 9).alias("rmse_rise"),
        )
        for feature in features
    ]
    return reduce(DataFrame.unionByName, parts)
