"""Purchase intervals and next-purchase labels.

Both are worked out on one row per customer and day. Within a day the order of
purchases is not defined, but what follows from it is: with ``c`` purchases on a day,
``c - 1`` of them have another purchase 0 days away and one has the gap to the
neighbouring day. Rows therefore carry a count, and a customer with any number of
purchases takes part with at most one row per calendar day.
"""

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from farebox.functions.fixed_values import HORIZONS
from farebox.functions.measures import labelled

KEY = "fk_contact"
DAY = "date_purchase"
GAP = "days_since_prev_purchase"
NEXT_GAP = "days_until_next_purchase"


def timeline() -> WindowSpec:
    """A customer's purchase days in order."""
    return Window.partitionBy(KEY).orderBy(DAY)


def purchase_days(purchases: DataFrame) -> DataFrame:
    """Purchases per customer and day."""
    return (
        purchases.where(F.col(KEY).isNotNull() & F.col(DAY).isNotNull())
        .groupBy(KEY, DAY)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _neighbours(days: DataFrame, name: str, gap: str) -> DataFrame:
    """Rows (same day, 0, n - 1) and (``neighbour`` day, gap, 1) for every day."""
    same = F.struct(F.col(DAY).alias(name), F.lit(0).alias(gap), (F.col("n") - 1).alias("purchases"))
    other = F.struct(
        F.col("neighbour").alias(name),
        F.abs(F.datediff(DAY, "neighbour")).alias(gap),
        F.lit(1).cast("bigint").alias("purchases"),
    )
    return (
        days.select(KEY, DAY, F.inline(F.array(same, other)))
        .where(F.col(name).isNotNull() & (F.col("purchases") > 0))
    )


def purchase_intervals(purchases: DataFrame) -> DataFrame:
    """Previous purchase of the same customer and the days since, with the number of
    purchases it holds for. First purchases have no interval and no row."""
    days = purchase_days(purchases).withColumn("neighbour", F.lag(DAY).over(timeline()))
    return _neighbours(days, "prev_purchase", GAP)


def interval_lengths(intervals: DataFrame) -> DataFrame:
    """How often each interval length occurs; one row per length in days."""
    return intervals.groupBy(GAP).agg(F.sum("purchases").alias("n"))


def interval_stats(lengths: DataFrame) -> DataFrame:
    """Statistics of positive intervals from their length table; one row."""
    return _stats(lengths.where(F.col(GAP) > 0))


def interval_stats_180(lengths: DataFrame) -> DataFrame:
    """The same for intervals of 0 to 180 days."""
    return _stats(lengths.where(F.col(GAP) <= 180))


def _stats(lengths: DataFrame) -> DataFrame:
    days, n = F.col(GAP), F.col("n")
    every = Window.partitionBy()
    total = F.sum(n).over(every)
    mean = F.sum(days * n).over(every) / total
    return (
        lengths.select(days, n, mean.alias("mean"))
        .agg(
            F.coalesce(F.sum(n), F.lit(0)).alias("intervals"),
            F.round(F.max("mean"), 6).alias("mean_days"),
            F.round(F.percentile(days, 0.5, n), 6).alias("median_days"),
            F.min(days).alias("min_days"),
            F.max(days).alias("max_days"),
            F.round(
                F.sqrt(
                    F.sum(n * (days - F.col("mean")) * (days - F.col("mean")))
                    / F.nullif(F.sum(n) - 1, F.lit(0))
                ),
                6,
            ).alias("std_days"),
            F.round(F.percentile(days, 0.99, n), 6).alias("p99_days"),
        )
    )


def interval_by_segment(intervals: DataFrame, segments: DataFrame) -> DataFrame:
    """Mean, median and number of positive intervals per segment, shortest mean first."""
    days, n = F.col(GAP), F.col("n")
    return (
        intervals.where(days > 0)
        .join(segments.select(KEY, "Segment"), KEY)
        .groupBy("Segment", GAP)
        .agg(F.sum("purchases").alias("n"))
        .groupBy("Segment")
        .agg(
            F.round(F.sum(days * n) / F.sum(n), 6).alias("mean_days"),
            F.round(F.percentile(days, 0.5, n), 6).alias("median_days"),
            F.sum(n).alias("intervals"),
        )
        .orderBy("mean_days", "Segment")
    )


def next_purchase_labels(purchases: DataFrame, one_per_customer: bool = False) -> DataFrame:
    """For each customer's last date that has a later (or same-day) purchase: the next
    purchase, the days until it, and whether it falls within each horizon.

    Several purchases on that date give a row with a count above one, or two rows.
    ``one_per_customer`` keeps the one with the largest gap, counted once.
    """
    days = purchase_days(purchases).withColumns(
        {
            "neighbour": F.lead(DAY).over(timeline()),
            "neighbour_n": F.lead("n").over(timeline()),
            "day_after": F.lead(DAY, 2).over(timeline()),
        }
    )
    # The last day itself when it has several purchases, otherwise the day before it.
    ends_here = F.col("neighbour").isNull() & (F.col("n") > 1)
    one_follows = F.col("day_after").isNull() & (F.col("neighbour_n") == 1)
    last = days.where(ends_here | one_follows)
    if one_per_customer:
        # Without its same-day neighbours, or reduced to one of them on the last day.
        last = last.withColumn("n", F.when(ends_here, 2).otherwise(1).cast("bigint"))
    return _neighbours(last, "next_purchase", NEXT_GAP).select(
        KEY,
        DAY,
        "next_purchase",
        NEXT_GAP,
        *[
            labelled(F.col(NEXT_GAP) <= horizon).alias(f"will_buy_next_{horizon}_days")
            for horizon in HORIZONS
        ],
        "purchases",
    )


def conversion_by_segment(labels: DataFrame, segments: DataFrame) -> DataFrame:
    """Share of labelled purchases followed by another within each horizon, highest
    share within 15 days first."""
    n = F.sum("purchases")
    return (
        labels.join(segments.select(KEY, "Segment"), KEY)
        .groupBy("Segment")
        .agg(
            *[
                (F.sum(F.col(f"will_buy_next_{h}_days") * F.col("purchases")) / n * 100).alias(
                    f"conversion_{h}_days"
                )
                for h in HORIZONS
            ],
            n.alias("labelled"),
        )
        .orderBy(F.desc("conversion_15_days"), "Segment")
    )
