"""Business KPIs, monthly / weekday / hour totals and the weekday-hour grid."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farebox.functions.cleaning import clean_purchases
from farebox.functions.calendar import months, weekday_number, weekdays
from farebox.functions.fixed_values import PURCHASE_COLUMNS
from farebox.functions.measures import money_sum, ratio

GMV = "gmv_success"
DAY = "date_purchase"
HOUR = "time_purchase_hour"
TICKETS = "total_tickets_quantity_success"


def kpi_overview(purchases: DataFrame, tickets: DataFrame | None = None) -> DataFrame:
    """Totals, distinct purchases and customers, and their guarded ratios; one row.

    ``tickets`` may give the tickets from a narrower table than ``purchases``. Each
    distinct count is an aggregate of its own: together they would multiply every row.
    """

    def distinct(column: str) -> DataFrame:
        return purchases.select(column).distinct().agg(F.count(column).alias("x"))

    parts = {
        "total_gmv": purchases.agg(money_sum(F.col(GMV)).alias("x")),
        "total_tickets": (purchases if tickets is None else tickets).agg(
            F.coalesce(F.sum(TICKETS), F.lit(0)).alias("x")
        ),
        "transactions": distinct("nk_ota_localizer_id"),
        "customers": distinct("fk_contact"),
    }
    one = purchases.sparkSession.range(1)
    totals = one.select(*[part.scalar().alias(name) for name, part in parts.items()])
    gmv, sold, transactions, customers = map(F.col, totals.columns)
    return totals.withColumns(
        {
            "gmv_per_transaction": ratio(gmv, transactions),
            "tickets_per_transaction": ratio(sold, transactions),
            "gmv_per_ticket": ratio(gmv, sold),
            "gmv_per_customer": ratio(gmv, customers),
        }
    )


def ingest_profile(raw: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """Row and column counts, nulls per input column, rejected values and the covered
    period, as (metric, value) text rows. Rejected numbers are values that are there but
    are no number, not finite or too large; ``rejected`` are lines that were no rows, of
    which the number is given, and the number for each fault."""
    types = {field.name: field.dataType for field in raw.schema.fields}
    numbers = [name for name in (GMV, TICKETS) if name in types]
    # Raw and cleaned values side by side, in one pass.
    purchases = clean_purchases(raw.withColumns({f"given:{name}": F.col(name) for name in numbers}))
    inputs = [name for name in PURCHASE_COLUMNS if name in raw.columns]
    # Cleaning replaces three columns in place; their null counts after coercion are
    # what the load step reports, so one pass over the cleaned rows is enough.
    one_row = purchases.agg(
        F.count(F.lit(1)).cast("string").alias("rows"),
        F.lit(len(inputs)).cast("string").alias("columns"),
        F.count_if(F.col(DAY).isNull()).cast("string").alias("invalid_dates"),
        *[
            F.count_if(F.col(HOUR).isNull()).cast("string").alias("invalid_hours")
            for _ in [HOUR] if HOUR in purchases.columns
        ],
        F.min(DAY).cast("string").alias("first_date"),
        F.max(DAY).cast("string").alias("last_date"),
        *[
            F.count_distinct(name).cast("string").alias("outbound_companies")
            for name in ["fk_departure_ota_bus_company"] if name in types
        ],
        *[
            F.count_if(F.col(f"given:{name}").isNotNull() & F.col(name).isNull())
            .cast("string").alias(f"rejected:{name}")
            for name in numbers
        ],
        *[F.count_if(F.col(name).isNull()).cast("string").alias(f"nulls:{name}") for name in inputs],
    )
    profile = one_row.unpivot([], one_row.columns, "metric", "value")
    if rejected is None:
        return profile
    faults = rejected.groupBy("fault").agg(F.count(F.lit(1)).alias("n"))
    lines = faults.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).withColumn("metric", F.lit("rejected:lines"))
    each = faults.withColumn("metric", F.concat(F.lit("rejected:lines:"), "fault"))
    return profile.unionByName(
        lines.unionByName(each.drop("fault")).select("metric", F.col("n").cast("string").alias("value"))
    )


def gmv_by_month(purchases: DataFrame) -> DataFrame:
    """GMV per year-month with the mean of three consecutive rows.

    The trailing mean runs over one row per month, so its single window is small.
    """
    monthly = (
        purchases.where(F.col(DAY).isNotNull())
        .groupBy(F.trunc(DAY, "MM").alias("month"))
        .agg(money_sum(F.col(GMV)).alias("gmv"))
    )
    # Its window also leaves the months in order.
    three = Window.orderBy("month").rowsBetween(-2, 0)
    return monthly.select(
        F.date_format("month", "yyyy-MM").alias("year_month"),
        "gmv",
        F.when(F.count("gmv").over(three) == 3, F.avg("gmv").over(three)).alias("moving_avg"),
    )


def gmv_by_weekday(purchases: DataFrame) -> DataFrame:
    """GMV per weekday, all seven days; null for a day without purchases."""
    return _on_weekdays(purchases, money_sum(F.col(GMV)).alias("gmv"))


def purchases_by_weekday(purchases: DataFrame) -> DataFrame:
    """Purchases per weekday, all seven days; null for a day without purchases."""
    return _on_weekdays(purchases, F.count(F.lit(1)).alias("purchases"))


def _on_weekdays(purchases: DataFrame, measure) -> DataFrame:
    totals = (
        purchases.where(F.col(DAY).isNotNull()).groupBy(weekday_number(F.col(DAY)).alias("dow")).agg(measure)
    )
    return weekdays(purchases.sparkSession).join(F.broadcast(totals), "dow", "left")


def gmv_by_hour(purchases: DataFrame) -> DataFrame:
    return purchases.where(F.col(HOUR).isNotNull()).groupBy(F.col(HOUR).alias("hour")).agg(
        money_sum(F.col(GMV)).alias("gmv")
    )


def purchases_by_hour(purchases: DataFrame) -> DataFrame:
    return purchases.where(F.col(HOUR).isNotNull()).groupBy(F.col(HOUR).alias("hour")).agg(
        F.count(F.lit(1)).alias("purchases")
    )


def gmv_by_calendar_month(purchases: DataFrame) -> DataFrame:
    """GMV per month of the year, all years pooled; only months with purchases."""
    totals = (
        purchases.where(F.col(DAY).isNotNull())
        .groupBy(F.month(DAY).alias("month_no"))
        .agg(money_sum(F.col(GMV)).alias("gmv"))
    )
    return months(purchases.sparkSession).join(F.broadcast(totals), "month_no")


def weekday_hour_counts(purchases: DataFrame) -> DataFrame:
    return (
        purchases.where(F.col(DAY).isNotNull() & F.col(HOUR).isNotNull())
        .groupBy(weekday_number(F.col(DAY)).alias("dow"), F.col(HOUR).alias("hour"))
        .agg(F.count(F.lit(1)).alias("purchases"))
    )


def weekday_hour_grid(purchases: DataFrame) -> DataFrame:
    """Weekday rows, one column ``h0`` .. ``h23`` per hour; null where there is none."""
    hours = list(range(24))
    grid = (
        weekday_hour_counts(purchases)
        .groupBy("dow")
        .pivot("hour", hours)
        .agg(F.sum("purchases"))
        .withColumnsRenamed({str(hour): f"h{hour}" for hour in hours})
    )
    return weekdays(purchases.sparkSession).join(F.broadcast(grid), "dow", "left")
