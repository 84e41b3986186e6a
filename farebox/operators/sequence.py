"""Purchases in each customer's order, and the next route by Markov transitions.

A customer may hold a third of all rows, so no window takes a customer whole. Purchases are
range-partitioned by customer and time, which cuts a large customer into blocks; windows
look back within a block, and only the last two purchases of a block are handed on to the
next one. A boundary between blocks cuts at most one customer, so there are fewer such
hand-overs than blocks.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farebox.functions.measures import ratio
from farebox.staging import stage

KEY, DAY, ID = "fk_contact", "date_purchase", "nk_ota_localizer_id"
MIN_SUPPORT = 5  # a context with fewer transitions gives way to a shorter one


def route_chain(purchases: DataFrame) -> DataFrame:
    """Every purchase that has a customer, a date and a route, with the two routes before.

    The order is date, second of the day (without one first), id, route. Columns: customer,
    ``date_purchase``, ``second``, id, ``route``, ``previous_route``, ``route_before``.
    """
    second = F.col("time_purchase_second") if "time_purchase_second" in purchases.columns else F.lit(None)
    order = [DAY, "second", ID, "route"]
    rows = purchases.where(F.col(KEY).isNotNull() & F.col(DAY).isNotNull() & F.col("route").isNotNull())
    rows = rows.select(KEY, DAY, F.coalesce(second.cast("int"), F.lit(-1)).alias("second"), ID, "route")
    placed = stage(
        rows.repartitionByRange(KEY, *order).withColumn("block", F.spark_partition_id()), "chain-blocks"
    )
    here = Window.partitionBy(KEY, "block").orderBy(*order)
    linked = placed.withColumns(
        {
            "nth": F.row_number().over(here),
            "back_1": F.lag("route").over(here),
            "back_2": F.lag("route", 2).over(here),
            "last": F.lead("route").over(here).isNull(),
        }
    )
    linked = stage(linked, "chain-links")
    blocks = Window.partitionBy(KEY).orderBy("block")
    handed = (
        linked.where("last").select(KEY, "block", F.col("route").alias("tail_1"), F.col("back_1").alias("tail_2"))
        .withColumn("before_1", F.lag("tail_1").over(blocks))
        .withColumn("before_2", F.coalesce(F.lag("tail_2").over(blocks), F.lag("tail_1", 2).over(blocks)))
        .where(F.col("before_1").isNotNull()).select(KEY, "block", "before_1", "before_2")
    )
    nth = F.col("nth")
    return linked.join(F.broadcast(handed), [KEY, "block"], "left").select(
        KEY, DAY, "second", ID, "route",
        F.coalesce("back_1", "before_1").alias("previous_route"),
        F.coalesce("back_2", F.when(nth == 2, F.col("before_1")).when(nth == 1, F.col("before_2"))).alias("route_before"),
    )


def route_transitions(chain: DataFrame) -> DataFrame:
    """How often a route follows another, and its share of what follows that one."""
    counted = chain.where(F.col("previous_route").isNotNull()).groupBy("previous_route", "route").agg(
        F.count(F.lit(1)).alias("transitions")
    )
    following = Window.partitionBy("previous_route")  # routes after a route, not purchases
    return counted.withColumn("share", F.col("transitions") / F.sum("transitions").over(following))


def _best(chain: DataFrame, context: list[str], min_support: int, order: int) -> DataFrame:
    """The most frequent route after each context, and its share; equal counts by name."""
    counted = chain.groupBy(*context, "route").agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by("route", F.struct(-F.col("n"), "route"))
    return counted.groupBy(*context).agg(
        best.alias(f"route_{order}"), ratio(F.max("n"), F.sum("n")).alias(f"share_{order}"),
        F.sum("n").alias("total"),
    ).where(F.col("total") >= min_support).drop("total")


def markov_contexts(chain: DataFrame, min_support: int = MIN_SUPPORT) -> list[DataFrame]:
    """Best next route after two routes, after one, and of all; staged."""
    two = chain.where(F.col("route_before").isNotNull())
    one = chain.where(F.col("previous_route").isNotNull())
    return [
        stage(_best(two, ["route_before", "previous_route"], min_support, 2), "contexts-2"),
        stage(_best(one, ["previous_route"], min_support, 1), "contexts-1"),
        stage(_best(chain, [], 1, 0), "contexts-0"),
    ]


def predict_next(states: DataFrame, contexts: list[DataFrame]) -> DataFrame:
    """Rows with ``previous_route`` and ``route_before`` plus the best next route, by the
    longest context that has enough transitions (``context_length`` 2, 1 or 0)."""
    two, one, none = contexts
    found = states.join(two, ["route_before", "previous_route"], "left").join(one, ["previous_route"], "left")
    # one row at most
    found = found.join(F.broadcast(none), F.lit(True), "left")
    used = F.when(F.col("route_2").isNotNull(), 2).when(F.col("route_1").isNotNull(), 1).otherwise(0)
    return found.select(
        *states.columns, used.alias("context_length"),
        F.coalesce("route_2", "route_1", "route_0").alias("next_route"),
        F.coalesce("share_2", "share_1", "share_0").alias("probability"),
    )


def _latest(chain: DataFrame, *values: Column | str) -> DataFrame:
    """``values`` of each customer's last purchase; combined before the shuffle."""
    last = F.max(F.struct(DAY, "second", ID, "route", F.struct(*values).alias("values")))
    return chain.groupBy(KEY).agg(last.alias("last")).select(KEY, "last.values.*")


def next_route_markov(chain: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """For every customer the route most likely to come next after the last two."""
    states = _latest(chain, F.col("route").alias("previous_route"), F.col("previous_route").alias("route_before"))
    found = predict_next(states, markov_contexts(chain, min_support))
    return found.withColumnsRenamed({"previous_route": "last_route", "route_before": "route_before_last"})


def markov_metrics(chain: DataFrame, in_training: Column, min_support: int = MIN_SUPPORT) -> DataFrame:
    """How often the last route of customers left out of the counts is foretold; one row.

    ``popular_accuracy`` is that of always naming the most frequent route. Customers with
    one purchase have nothing before it and are named the most frequent route.
    """
    contexts = markov_contexts(chain.where(in_training), min_support)
    held_out = _latest(chain.where(~in_training), "route", "previous_route", "route_before")
    hit = (F.col("route") == F.col("next_route")).cast("int")
    popular = (F.col("route") == F.col("route_0")).cast("int")
    found = predict_next(held_out, contexts).join(F.broadcast(contexts[2]), F.lit(True), "left")
    n = F.count(F.lit(1))
    return found.agg(
        n.alias("customers"), ratio(F.coalesce(F.sum(hit), F.lit(0)), n).alias("accuracy"),
        ratio(F.coalesce(F.sum(popular), F.lit(0)), n).alias("popular_accuracy"),
        F.coalesce(F.sum((F.col("context_length") == 2).cast("long")), F.lit(0)).alias("by_two_routes"),
        F.coalesce(F.sum((F.col("context_length") == 1).cast("long")), F.lit(0)).alias("by_one_route"),
    )
