"""Tickets per purchase, ticket prices, round trips and return companies."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.functions.fixed_values import NO_RETURN_COMPANY
from farebox.functions.measures import money as as_money
from farebox.functions.measures import percent_above, ratio

TICKETS = "total_tickets_quantity_success"
GMV = "gmv_success"


def tickets_distribution(purchases: DataFrame) -> DataFrame:
    return (
        purchases.where(F.col(TICKETS).isNotNull())
        .groupBy(F.col(TICKETS).alias("tickets"))
        .agg(F.count(F.lit(1)).alias("purchases"))
    )


def ticket_prices(purchases: DataFrame) -> DataFrame:
    """Price per ticket of every purchase with tickets and a value."""
    price = F.col(GMV) / F.col(TICKETS)
    return (
        purchases.where(F.col(TICKETS) > 0).select(price.alias("price")).where("price is not null")
    )


def avg_ticket_price(purchases: DataFrame) -> DataFrame:
    """Mean of the purchases' own ticket prices (not the ratio of the totals)."""
    exact = as_money(F.col("price"))
    return ticket_prices(purchases).agg(
        F.round(F.sum(exact).cast("double") / F.count(F.lit(1)), 4).alias("avg_ticket_price"),
        F.count(F.lit(1)).alias("purchases"),
    )


def same_company_share(purchases: DataFrame) -> DataFrame:
    """Percentage of purchases that return with the outbound company: over all rows
    with both companies, and over those that do have a return."""
    out, back = F.col("fk_departure_ota_bus_company"), F.col("fk_return_ota_bus_company")
    both = out.isNotNull() & back.isNotNull()
    returning = both & (back != NO_RETURN_COMPANY)
    return purchases.agg(
        F.count_if(both).alias("purchases"),
        F.count_if(returning).alias("round_trips"),
        (F.count_if(both & (out == back)) / F.nullif(F.count_if(both), F.lit(0)) * 100).alias(
            "pct_same_company"
        ),
        (
            F.count_if(returning & (out == back)) / F.nullif(F.count_if(returning), F.lit(0)) * 100
        ).alias("pct_same_company_round_trips"),
    )


def round_trip_comparison(purchases: DataFrame) -> DataFrame:
    """Share and mean GMV of one-way purchases and round trips, two rows."""
    back = F.col("has_return")
    money = as_money(F.col(GMV))

    def mean(of):
        return F.sum(F.when(of, money)).cast("double") / F.nullif(
            F.count(F.when(of, money)), F.lit(0)
        )

    sums = purchases.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(back).alias("with_return"),
        mean(back).alias("mean_with"),
        mean(~back).alias("mean_without"),
    )
    share = ratio(F.col("with_return"), F.col("n")) * 100

    def row(kind, gmv, pct):
        return F.struct(
            F.lit(kind).alias("kind"), gmv.alias("mean_gmv"), pct.alias("pct_purchases")
        )

    return sums.select(
        F.inline(
            F.array(
                row("Somente Ida", F.col("mean_without"), 100 - share),
                row("Ida e Volta", F.col("mean_with"), share),
            )
        ),
        percent_above(F.col("mean_with"), F.col("mean_without")).alias("pct_round_trip_above"),
    )
