"""Weekday and month dimensions (7 and 12 rows)."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.functions.fixed_values import MONTHS_EN, MONTHS_PT, WEEKDAYS_EN, WEEKDAYS_PT


def name_of(names: list[str], index: Column) -> Column:
    """Name at a 0-based index; null for a null index."""
    return F.get(F.array(*[F.lit(name) for name in names]), index)


def weekday_number(day: Column) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(day)


def weekdays(spark: SparkSession) -> DataFrame:
    index = F.col("id").cast("int")
    return spark.range(7).select(
        index.alias("dow"),
        name_of(WEEKDAYS_EN, index).alias("day_en"),
        name_of(WEEKDAYS_PT, index).alias("day_pt"),
    )


def months(spark: SparkSession) -> DataFrame:
    index = F.col("id").cast("int")
    return spark.range(12).select(
        (index + 1).alias("month_no"),
        name_of(MONTHS_EN, index).alias("month_en"),
        name_of(MONTHS_PT, index).alias("month_pt"),
    )
