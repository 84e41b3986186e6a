"""Results that hold month by month, so that a new month leaves those of the others alone."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.functions.calendar import weekday_number
from farebox.functions.measures import money_sum

MONTH, DAY, GMV = "purchase_year_month", "date_purchase", "gmv_success"


def _dated(purchases: DataFrame) -> DataFrame:
    return purchases.where(F.col(MONTH).isNotNull())


def monthly_kpis(purchases: DataFrame) -> DataFrame:
    """Purchases, customers, days with purchases and GMV of every month."""
    return _dated(purchases).groupBy(MONTH, DAY, "fk_contact").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(GMV).try_cast("decimal(28,8)")).alias("gmv")
    ).groupBy(MONTH).agg(
        F.sum("n").alias("purchases"),
        F.count_distinct("fk_contact").alias("customers"),
        F.size(F.collect_set(F.dayofmonth(DAY))).alias("days"),  # 31 at most
        F.coalesce(F.sum("gmv").cast("double"), F.lit(0.0)).alias("gmv"),
    )


def monthly_weekday_hours(purchases: DataFrame) -> DataFrame:
    """Purchases and GMV by month, weekday (0 is Monday) and hour; rows without a clock time
    are left out."""
    timed = _dated(purchases).where(F.col("time_purchase_hour").isNotNull())
    return timed.groupBy(MONTH, weekday_number(F.col(DAY)).alias("dow"), F.col("time_purchase_hour").alias("hour")).agg(
        F.count(F.lit(1)).alias("purchases"), money_sum(F.col(GMV)).alias("gmv")
    )


def monthly_routes(purchases: DataFrame) -> DataFrame:
    """Purchases and GMV by month and route."""
    return _dated(purchases).where(F.col("route").isNotNull()).groupBy(MONTH, "route").agg(
        F.count(F.lit(1)).alias("purchases"), money_sum(F.col(GMV)).alias("gmv")
    )
