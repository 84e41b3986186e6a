"""Monthly cohorts by first purchase, and their retention."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farebox.functions.measures import month_offset
from farebox.operators.skew import join_per_key
from farebox.staging import stage

KEY = "fk_contact"


def cohort_counts(purchases: DataFrame, unit: str = "purchases") -> DataFrame:
    """Distinct purchases (or customers) per first month and months since.

    ``purchases``: every purchase meets its customer's first month in a join that keeps
    very large customers out of the shuffle; distinct ids are then counted in two steps
    keyed by id first. ``customers``: one row per customer and month.
    """
    rows = purchases.where(F.col(KEY).isNotNull() & F.col("date_purchase").isNotNull()).select(
        KEY, F.trunc("date_purchase", "MM").alias("month"), "nk_ota_localizer_id"
    )
    if unit == "customers":
        customer = Window.partitionBy(KEY)
        dated = (
            rows.select(KEY, "month")
            .distinct()
            .withColumn("primeira_compra", F.min("month").over(customer))
        )
        counted = F.count(F.lit(1))
    elif unit == "purchases":
        firsts = rows.groupBy(KEY).agg(
            F.min("month").alias("primeira_compra"), F.count(F.lit(1)).alias("n")
        )
        dated = join_per_key(rows, stage(firsts, "first-months"), KEY, "n")
        counted = F.count_distinct("nk_ota_localizer_id")
    else:
        raise ValueError("unit is 'purchases' or 'customers'")
    return (
        dated.withColumn("periods", month_offset(F.col("month"), F.col("primeira_compra")))
        .groupBy("primeira_compra", "periods")
        .agg(counted.alias(unit))
    )


def cohort_retention(counts: DataFrame) -> DataFrame:
    """Each cell as a percentage of its cohort's first month (one row per cell)."""
    unit = counts.columns[-1]
    cohort = Window.partitionBy("primeira_compra")
    first = F.max(F.when(F.col("periods") == 0, F.col(unit))).over(cohort)
    return counts.select("primeira_compra", "periods", (F.col(unit) / first * 100).alias("retention"))


def retention_curve(retention: DataFrame) -> DataFrame:
    """Unweighted mean over the cohorts that have the period."""
    return retention.groupBy("periods").agg(
        F.round(F.avg("retention"), 6).alias("mean_retention"),
        F.count(F.lit(1)).alias("cohorts"),
    )


def cohort_grid(retention: DataFrame, last_period: int | None = None) -> DataFrame:
    """Cohort rows with a column ``p0`` .. for each period up to ``last_period``, by default
    for each period that some cohort has. A mistyped year adds the few columns of its own
    cells and not the thousands of months before them."""
    if last_period is None:
        periods = [row["periods"] for row in retention.select("periods").distinct().sort("periods").collect()]
    else:
        periods = list(range(last_period + 1))
    return (
        retention.groupBy("primeira_compra")
        .pivot("periods", periods)
        .agg(F.max("retention"))
        .withColumnsRenamed({str(period): f"p{period}" for period in periods})
    )


def cohort_cells(retention: DataFrame) -> DataFrame:
    """Every cohort with every period that some cohort has; absent cells are null.

    The long form of the grid without the grid: a cohort is a map of its cells, and the
    periods are one array for all.
    """
    periods = retention.agg(F.sort_array(F.collect_set("periods")).alias("x")).scalar()
    cells = F.map_from_entries(F.collect_list(F.struct("periods", "retention")))
    cohorts = retention.groupBy("primeira_compra").agg(cells.alias("cells"))
    return cohorts.select("primeira_compra", "cells", F.explode(periods).alias("periods")).select(
        "primeira_compra", "periods", F.try_element_at("cells", "periods").alias("retention")
    )


def grid_to_rows(grid: DataFrame) -> DataFrame:
    """A cohort grid back to (cohort, period, retention), absent cells included as null."""
    periods = [column for column in grid.columns if column != "primeira_compra"]
    rows = grid.unpivot("primeira_compra", periods, "period", "retention")
    return rows.select(
        "primeira_compra", F.substring("period", 2, 9).cast("int").alias("periods"), "retention"
    )
