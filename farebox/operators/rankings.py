"""Most frequent routes and places, best companies and customers.

Every top-k has a unique second sort key, so equal counts always rank the same way.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farebox.functions.fixed_values import TOP_ROUTES
from farebox.functions.measures import money_sum


def top(df: DataFrame, measure: str, key: str, k: int) -> DataFrame:
    """The k rows with the largest measure, numbered from 1."""
    order = [F.desc(measure), F.asc(key)]
    # The window sees the k rows that are left.
    return df.orderBy(*order).limit(k).withColumn("position", F.row_number().over(Window.orderBy(*order)))


def counts_of(purchases: DataFrame, column: str) -> DataFrame:
    return (
        purchases.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("purchases"))
    )


def route_ranking(purchases: DataFrame, k: int = TOP_ROUTES) -> DataFrame:
    return top(counts_of(purchases, "route"), "purchases", "route", k)


def origin_ranking(purchases: DataFrame, k: int = 10) -> DataFrame:
    return top(
        counts_of(purchases, "place_origin_departure"), "purchases", "place_origin_departure", k
    )


def destination_ranking(purchases: DataFrame, k: int = 10) -> DataFrame:
    column = "place_destination_departure"
    return top(counts_of(purchases, column), "purchases", column, k)


def company_ranking(purchases: DataFrame, k: int = 10) -> DataFrame:
    """Outbound companies by GMV."""
    key = "fk_departure_ota_bus_company"
    totals = (
        purchases.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(money_sum(F.col("gmv_success")).alias("gmv"))
    )
    return top(totals, "gmv", key, k)


def customer_totals(purchases: DataFrame) -> DataFrame:
    """Distinct purchases and GMV per customer."""
    return (
        purchases.where(F.col("fk_contact").isNotNull())
        .groupBy("fk_contact")
        .agg(
            F.count_distinct("nk_ota_localizer_id").alias("purchases"),
            money_sum(F.col("gmv_success")).alias("gmv"),
        )
    )


def customer_ranking(totals: DataFrame, k: int = 10) -> DataFrame:
    """Top customers by purchases and by GMV, with the mean purchases per customer.
    Pass staged ``customer_totals``; it is read three times."""
    mean = totals.agg(F.sum("purchases") / F.count(F.lit(1))).scalar()

    def ranked(measure: str) -> DataFrame:
        return top(totals, measure, "fk_contact", k).withColumn("ranking", F.lit(measure))

    return (
        ranked("purchases")
        .unionByName(ranked("gmv"))
        .select("ranking", "position", "fk_contact", "purchases", "gmv")
        .withColumn("mean_purchases", mean)
    )


def purchases_on_routes(purchases: DataFrame, routes: DataFrame) -> DataFrame:
    """Purchases whose route is among ``routes`` (at most ``TOP_ROUTES`` rows, hence
    the broadcast)."""
    return purchases.join(F.broadcast(routes.select("route")), "route", "left_semi")
