"""Days to the next purchase, with the customers who have not bought again yet.

A customer's last purchase has waited from its day to the day of the report without a
successor. Leaving these out would make every wait look short; the product-limit estimate
(Kaplan-Meier) keeps them as censored waits. Everything is worked out on one row per
segment and number of days, which the calendar bounds.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farebox.functions.fixed_values import HORIZONS
from farebox.operators.cycle import GAP, KEY

HALF = 0.5 + 1e-9  # a product of ratios is not exact to the last bit


def waits(intervals: DataFrame, rfm: DataFrame, segments: DataFrame) -> DataFrame:
    """``Segment``, ``days``, ``bought`` and ``waiting``: purchases followed after so many days,
    and customers whose last purchase has waited so long (0 for a day still to come)."""
    none = F.lit(0).cast("bigint")
    bought = intervals.groupBy(KEY, F.col(GAP).alias("days")).agg(F.sum("purchases").alias("bought"))
    waiting = rfm.select(KEY, F.greatest("recency", F.lit(0)).alias("days"), F.lit(1).cast("bigint").alias("waiting"))
    both = bought.withColumn("waiting", none).unionByName(waiting.withColumn("bought", none))
    return (
        both.join(segments.select(KEY, "Segment"), KEY)
        .groupBy("Segment", "days").agg(F.sum("bought").alias("bought"), F.sum("waiting").alias("waiting"))
    )


def survival(waits: DataFrame) -> DataFrame:
    """Adds ``at_risk``, who had waited that long, and ``survival``, the share that waits longer."""
    later = Window.partitionBy("Segment").orderBy(F.desc("days"))
    earlier = Window.partitionBy("Segment").orderBy("days")
    rows = waits.withColumn("at_risk", F.sum(F.col("bought") + F.col("waiting")).over(later))
    all_gone = F.col("bought") == F.col("at_risk")  # on the last day only
    stay = F.when(~all_gone, F.ln(1 - F.col("bought") / F.col("at_risk"))).otherwise(0.0)
    product = F.exp(F.sum(stay).over(earlier))
    return rows.withColumn("survival", F.when(all_gone, 0.0).otherwise(product))


def days_to_next_baseline(table: DataFrame) -> DataFrame:
    """Per segment the median days to the next purchase (null where more than half never
    came back) and the chance of one within each horizon."""

    def chance(horizon: int) -> Column:
        longest = F.min(F.when(F.col("days") <= horizon, F.col("survival")))
        return F.round(1 - F.coalesce(longest, F.lit(1.0)), 6).alias(f"chance_{horizon}_days")

    return table.groupBy("Segment").agg(
        F.sum("bought").alias("bought"), F.sum("waiting").alias("waiting"),
        F.min(F.when(F.col("survival") <= HALF, F.col("days"))).alias("median_days"),
        *[chance(h) for h in HORIZONS],
    )


def naive_median(waits: DataFrame) -> DataFrame:
    """The median of finished waits alone, for comparison: too short wherever customers wait."""
    return waits.where("bought > 0").groupBy("Segment").agg(
        F.percentile("days", 0.5, F.col("bought")).alias("median_days")
    )
