"""Contact timing, segment profiles and business highlights."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farebox.functions.calendar import name_of, weekday_number
from farebox.functions.fixed_values import (
    BAND_ABOVE_030,
    BAND_ABOVE_060,
    BAND_OTHERWISE,
    BLUE_SEGMENTS,
    FALLBACK_HOUR,
    FALLBACK_WEEKDAY_PT,
    HORIZONS,
    SEGMENT_STRATEGIES,
    STRATEGY_ABOVE_040,
    STRATEGY_ABOVE_070,
    STRATEGY_OTHERWISE,
    WEEKDAYS_PT,
)
from farebox.functions.measures import literal_rows, money_sum, round2, scalar_struct
from farebox.operators.rankings import top


def best_contact_slot(purchases: DataFrame) -> DataFrame:
    """Busiest weekday, busiest hour and busiest weekday-hour pair; one row.

    One scan: everything is read off the counts per weekday and hour (at most 8 x 25
    rows). Equal counts go to the earlier weekday, then the earlier hour.
    """
    counts = purchases.groupBy(
        weekday_number(F.col("date_purchase")).alias("dow"),
        F.col("time_purchase_hour").alias("hour"),
    ).agg(F.count(F.lit(1)).alias("n"))
    dow, hour, n = F.col("dow"), F.col("hour"), F.col("n")
    # One row per weekday and hour is left, so these windows are small.
    totals = counts.withColumns(
        {
            "of_day": F.sum("n").over(Window.partitionBy("dow")),
            "of_hour": F.sum("n").over(Window.partitionBy("hour")),
        }
    )
    best = totals.agg(
        F.max_by(
            dow,
            F.when(dow.isNotNull(), F.struct(F.col("of_day"), -dow)),
        ).alias("day"),
        F.max_by(
            hour,
            F.when(hour.isNotNull(), F.struct(F.col("of_hour"), -hour)),
        ).alias("hour"),
        F.max_by(
            F.struct("dow", "hour", "n"),
            F.when(dow.isNotNull() & hour.isNotNull(), F.struct(n, -dow, -hour)),
        ).alias("slot"),
    )
    return best.select(
        F.coalesce(name_of(WEEKDAYS_PT, F.col("day")), F.lit(FALLBACK_WEEKDAY_PT)).alias("best_day"),
        F.coalesce("hour", F.lit(FALLBACK_HOUR)).alias("best_hour"),
        name_of(WEEKDAYS_PT, F.col("slot.dow")).alias("slot_day"),
        F.col("slot.hour").alias("slot_hour"),
        F.col("slot.n").alias("slot_purchases"),
    )


def probability_band(probability: Column) -> Column:
    """Band of a probability; an unknown one has none."""
    return (
        F.when(probability.isNull(), F.lit(None).cast("string"))
        .when(probability > 0.6, BAND_ABOVE_060)
        .when(probability > 0.3, BAND_ABOVE_030)
        .otherwise(BAND_OTHERWISE)
    )


def contact_strategy(probability: Column) -> Column:
    return (
        F.when(probability.isNull(), F.lit(None).cast("string"))
        .when(probability > 0.7, STRATEGY_ABOVE_070)
        .when(probability > 0.4, STRATEGY_ABOVE_040)
        .otherwise(STRATEGY_OTHERWISE)
    )


def contact_plan(scores: DataFrame, slot: DataFrame) -> DataFrame:
    """When and how to contact every scored customer.

    ``scores`` has ``prob_7``, ``prob_15``, ``prob_30``; ``slot`` is the one row of
    ``best_contact_slot``. Equal probabilities go to the shorter horizon.
    """
    probability = {horizon: F.col(f"prob_{horizon}") for horizon in HORIZONS}
    best = F.greatest(*probability.values())
    window = F.coalesce(*[F.when(p == best, F.lit(h)) for h, p in probability.items()])
    when = scalar_struct(slot.select("slot_day", "slot_hour"))
    return scores.withColumn("slot", when).withColumns(
        {
            **{f"band_{h}": probability_band(p) for h, p in probability.items()},
            "best_window_days": window,
            "best_probability": best,
            "contact_day": F.col("slot.slot_day"),
            "contact_hour": F.col("slot.slot_hour"),
            "strategy": contact_strategy(best),
        }
    ).drop("slot")


def segment_dimension(spark: SparkSession) -> DataFrame:
    """Description, priority group and strategies of the eight named segments."""
    rows = [
        (name, description, "blue" if name in BLUE_SEGMENTS else "orange", "; ".join(strategies))
        for name, (description, strategies) in SEGMENT_STRATEGIES.items()
    ]
    names = ["Segment", "description", "priority", "strategies"]
    return literal_rows(spark, rows, dict.fromkeys(names, "string"))


def segment_profiles(segments: DataFrame, personas: DataFrame | None = None) -> DataFrame:
    """Size, value and mean RFM of every segment, best mean score first. Named segments
    have their text, and zeros when they have no customers; "Outros" has no text.
    ``personas`` adds the descriptions of a personas file."""
    n = F.count(F.lit(1))

    def mean(column):
        return round2(F.sum(column).cast("double") / n)

    sums = segments.groupBy("Segment").agg(
        n.alias("customers"),
        money_sum(F.col("monetary")).alias("total_value"),
        mean("recency").alias("mean_recency"),
        mean("frequency").alias("mean_frequency"),
        round2(money_sum(F.col("monetary")) / n).alias("mean_monetary"),
        mean("RFM_score").alias("mean_score"),
    )
    # At most nine rows on each side.
    profiles = (
        segment_dimension(segments.sparkSession)
        .join(sums, "Segment", "full")
        .withColumns(
            {
                "customers": F.coalesce("customers", F.lit(0)),
                "total_value": F.coalesce("total_value", F.lit(0.0)),
                "mean_value": F.coalesce(F.col("total_value") / F.col("customers"), F.lit(0.0)),
            }
        )
    )
    if personas is not None:
        profiles = profiles.join(personas.select("Segment", "persona"), "Segment", "left")
    return profiles.orderBy(F.desc_nulls_last("mean_score"), "Segment")


def business_highlights(purchases: DataFrame) -> DataFrame:
    """The three busiest origin-destination pairs, the busiest weekday and hour."""
    origin, destination = F.col("place_origin_departure"), F.col("place_destination_departure")
    pairs = (
        purchases.where(origin.isNotNull() & destination.isNotNull())
        .groupBy(F.concat(origin, F.lit(" → "), destination).alias("pair"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    routes = top(pairs, "n", "pair", 3).select(
        F.lit("route").alias("highlight"), "position", F.col("pair").alias("value")
    )
    slot = best_contact_slot(purchases)
    moments = slot.select(
        F.inline(
            F.array(
                F.struct(
                    F.lit("weekday").alias("highlight"),
                    F.lit(1).alias("position"),
                    F.col("best_day").alias("value"),
                ),
                F.struct(
                    F.lit("hour").alias("highlight"),
                    F.lit(1).alias("position"),
                    F.col("best_hour").cast("string").alias("value"),
                ),
            )
        )
    )
    return routes.unionByName(moments)
