"""Model inputs: repurchase features, route features and the train/test split."""

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farebox.functions.fixed_values import HORIZONS, TRAIN_PERCENT
from farebox.functions.measures import MONEY, money, money_sum
from farebox.operators.cycle import DAY, KEY, timeline
from farebox.operators.rankings import purchases_on_routes

FEATURES = ["recency", "frequency", "monetary"]
LABELS = [f"will_buy_next_{horizon}_days" for horizon in HORIZONS]


def split_bucket(key: Column) -> Column:
    """0..99 from the key's digest: the same on every run, cluster and partitioning."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % 100).cast("int")


def in_training(key: Column) -> Column:
    return split_bucket(key) < TRAIN_PERCENT


def train_test_split(features: DataFrame) -> DataFrame:
    """Which side of the split every customer is on."""
    key = F.col(KEY)
    return features.select(
        KEY, split_bucket(key).alias("bucket"), in_training(key).alias("in_training")
    ).distinct()


def repurchase_features(labels: DataFrame, rfm: DataFrame) -> DataFrame:
    """RFM of the customer beside each labelled row (RFM over the whole history)."""
    return labels.join(rfm.select(KEY, *FEATURES), KEY).select(
        KEY, *FEATURES, "days_until_next_purchase", *LABELS, "purchases"
    )


def point_in_time_features(labels: DataFrame, purchases: DataFrame) -> DataFrame:
    """RFM beside each labelled row from the days before the purchase to predict: days
    since the customer's previous purchase day, purchases and GMV so far."""
    days = (
        purchases.where(F.col(KEY).isNotNull() & F.col(DAY).isNotNull())
        .groupBy(KEY, DAY)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum(money(F.col("gmv_success"))), F.lit(0).cast(MONEY)).alias("gmv"),
        )
    )
    before = timeline().rowsBetween(Window.unboundedPreceding, -1)
    so_far = days.select(
        KEY,
        DAY,
        F.datediff(DAY, F.lag(DAY).over(timeline())).alias("since_previous"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("gmv").over(before), F.lit(0)).alias("gmv_before"),
        "n",
        "gmv",
    )
    # The labelled day itself counts only when the next purchase is on a later day.
    later = F.col("next_purchase") > F.col(DAY)
    return labels.join(so_far, [KEY, DAY]).select(
        KEY,
        F.coalesce("since_previous", F.lit(0)).alias("recency"),
        (F.col("n_before") + F.when(later, F.col("n")).otherwise(0)).alias("frequency"),
        (F.col("gmv_before") + F.when(later, F.col("gmv")).otherwise(0))
        .cast("double")
        .alias("monetary"),
        "days_until_next_purchase",
        *LABELS,
        "purchases",
    )


def route_features(
    purchases: DataFrame, routes: DataFrame, as_of: datetime.date | None = None
) -> DataFrame:
    """RFM over purchases on the given routes, with each customer's last route and its
    alphabetical code. One aggregate per customer; the last route is the maximum of
    (date, second of the day, purchase id); a purchase without a clock time comes before
    the others of its day."""
    today = F.current_date() if as_of is None else F.lit(as_of)
    codes = _route_codes(routes)
    columns = purchases.columns
    second = F.col("time_purchase_second") if "time_purchase_second" in columns else F.lit(None)
    second = F.coalesce(second.cast("int"), F.lit(-1)).alias("second")
    last = F.struct("date_purchase", second, "nk_ota_localizer_id", "route")
    return (
        purchases_on_routes(purchases, routes)
        .where(F.col(KEY).isNotNull() & F.col("date_purchase").isNotNull())
        .groupBy(KEY)
        .agg(
            F.datediff(today, F.max("date_purchase")).alias("recency"),
            F.count("nk_ota_localizer_id").alias("frequency"),
            money_sum(F.col("gmv_success")).alias("monetary"),
            F.max(last)["route"].alias("route"),
        )
        .join(F.broadcast(codes), "route")
        .select(KEY, *FEATURES, "route", "route_encoded")
    )


def _route_codes(routes: DataFrame) -> DataFrame:
    """0-based alphabetical code per route (at most ``TOP_ROUTES`` rows)."""
    return routes.select(
        "route", (F.dense_rank().over(Window.orderBy("route")) - 1).alias("route_encoded")
    )


def route_baseline(features: DataFrame) -> DataFrame:
    """Number of route classes and the accuracy of guessing uniformly; one row."""
    classes = F.count_distinct("route_encoded")
    return features.agg(
        classes.alias("classes"),
        F.when(classes > 0, 1.0 / classes).otherwise(0.0).alias("baseline"),
        F.count(F.lit(1)).alias("customers"),
    )
