"""Histograms with a fixed number of equal bins, and a smoothed price density.

Bins are counted before anything is shuffled; what follows works on one row per bin.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox.functions.measures import scalar_struct
from farebox.operators.cycle import GAP

DENSITY_POINTS = 200
# Width of the fine bins under the density curve, as a fraction of the bandwidth.
FINE = 16


def bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based bin of a value; the last bin includes its upper edge."""
    span = high - low
    raw = F.floor((value - low) / F.nullif(span, F.lit(0.0)) * bins)
    return F.least(F.coalesce(raw, F.lit(0)), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, column: str, bins: int, weight: str | None = None) -> DataFrame:
    """(bin, bin_start, bin_end, n) of the non-empty bins between minimum and maximum."""
    values = df.where(F.col(column).isNotNull()).select(
        F.col(column).cast("double").alias("value"),
        (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("weight"),
    )
    ends = scalar_struct(values.agg(F.min("value").alias("low"), F.max("value").alias("high")))
    low, high = F.col("ends.low"), F.col("ends.high")
    width = (high - low) / bins
    return (
        values.withColumn("ends", ends)
        .groupBy(bin_of(F.col("value"), low, high, bins).alias("bin"))
        .agg(F.sum("weight").alias("n"))
        .withColumn("ends", ends)
        .select(
            "bin",
            F.round(low + F.col("bin") * width, 6).alias("bin_start"),
            F.round(low + (F.col("bin") + 1) * width, 6).alias("bin_end"),
            "n",
        )
    )


def significant(value: float, digits: int = 6) -> float:
    """``value`` rounded to significant digits."""
    return float(f"{value:.{digits - 1}e}")


def _named(frame: DataFrame, name: str) -> DataFrame:
    return frame.select(F.lit(name).alias("measure"), *frame.columns)


def rfm_histograms(rfm: DataFrame) -> DataFrame:
    """Recency in 30 bins, frequency and monetary in 20. Pass a staged table."""
    return (
        _named(histogram(rfm, "recency", 30), "recency")
        .unionByName(_named(histogram(rfm, "frequency", 20), "frequency"))
        .unionByName(_named(histogram(rfm, "monetary", 20), "monetary"))
    )


def interval_histogram(lengths: DataFrame) -> DataFrame:
    """Positive intervals up to their 99th percentile in 50 bins, and intervals of at
    most 180 days in 30. ``lengths`` has one row per interval length."""
    positive = lengths.where(F.col(GAP) > 0)
    p99 = positive.agg(F.percentile(F.col(GAP), 0.99, F.col("n"))).scalar()
    trimmed = histogram(positive.where(F.col(GAP) <= p99), GAP, 50, "n")
    short = histogram(lengths.where(F.col(GAP) <= 180), GAP, 30, "n")
    return _named(trimmed, "up_to_p99").unionByName(_named(short, "up_to_180"))


def purchases_per_customer(purchases: DataFrame) -> DataFrame:
    return (
        purchases.where(F.col("fk_contact").isNotNull())
        .groupBy("fk_contact")
        .agg(F.count(F.lit(1)).alias("purchases"))
    )


def purchase_count_histogram(purchases: DataFrame) -> DataFrame:
    """Purchases per customer in 20 bins."""
    return histogram(_value_counts(purchases_per_customer(purchases)), "purchases", 20, "customers")


def _value_counts(per_customer: DataFrame) -> DataFrame:
    return per_customer.groupBy("purchases").agg(F.count(F.lit(1)).alias("customers"))


def ticket_price_histogram(prices: DataFrame) -> DataFrame:
    """Ticket prices in 30 bins."""
    return histogram(prices, "price", 30)


def ticket_price_density(prices: DataFrame, points: int = DENSITY_POINTS) -> DataFrame:
    """Gaussian density of ticket prices at ``points`` grid points from minimum to
    maximum, scaled to the counts of the 30-bin histogram.

    The bandwidth is Scott's, ``std * n ** -0.2``, to six significant digits. Prices are
    first counted in bins a sixteenth of the bandwidth wide, which moves no price by more
    than a thirty-second of it; the curve is then a sum over bins, not over rows. A bin
    meets the grid points near enough to show in the sixth decimal, so a far price adds no
    work. Prices are read twice: for their moments and for the bins. Prices that are all
    equal have no density: a point each, with nulls.
    """
    price = F.col("price")
    moments = prices.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(price).alias("low"),
        F.max(price).alias("high"),
        F.stddev_samp(price).alias("std"),
    )
    one = moments.first()
    low, high, n = one["low"], one["high"], one["n"]
    # Rounding the bandwidth keeps the last bits of the deviation, which depend on
    # the order of summing, from moving a price into the next bin.
    h = significant((one["std"] or 0.0) * n**-0.2 if n else 0.0)
    grid = prices.sparkSession.range(points).select(F.col("id").cast("int").alias("point"))
    if not h:
        start = F.lit(low).cast("double")
        return grid.select("point", F.round(start, 6).alias("price"), F.lit(None).cast("double").alias("density"))
    step = (high - low) / (points - 1)
    scale = (high - low) / 30 / (h * math.sqrt(2 * math.pi))
    # Beyond this distance even all rows together stay under a tenth of the sixth decimal.
    reach = h * math.sqrt(2 * math.log(max(n * scale * 1e8, math.e)))
    fine = (
        prices.groupBy(F.floor((price - low) / (h / FINE)).alias("cell"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select((low + (F.col("cell") + 0.5) * (h / FINE)).alias("centre"), "n")
    )
    first = F.greatest(F.ceil((F.col("centre") - reach - low) / step), F.lit(0)).cast("int")
    last = F.least(F.floor((F.col("centre") + reach - low) / step), F.lit(points - 1)).cast("int")
    distance = (low + F.col("point") * F.lit(step) - F.col("centre")) / h
    mass = (
        fine.withColumns({"first": first, "last": last}).where("first <= last")
        .select("centre", "n", F.explode(F.sequence("first", "last")).alias("point"))
        .groupBy("point").agg(F.sum(F.col("n") * F.exp(-distance * distance / 2)).alias("mass"))
    )
    return grid.join(F.broadcast(mass), "point", "left").select(
        "point",
        F.round(F.lit(low) + F.col("point") * F.lit(step), 6).alias("price"),
        F.round(F.coalesce("mass", F.lit(0.0)) * F.lit(scale), 6).alias("density"),
    )
