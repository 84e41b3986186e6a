"""Routes by collaborative filtering: implicit-feedback factors, and how well a ranking does.

The last purchase of every held-out customer is taken away; a ranking is made from the rest
and judged by the place it gives the route taken away. Everything is counts by (customer,
route) and joins on them, so a customer or route with a third of all rows is combined
before the shuffle.
"""

import uuid
from dataclasses import dataclass

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farebox.functions.fixed_values import SEED
from farebox.functions.measures import ratio
from farebox.models.forest import LARGE_TASK_ROWS, training_tasks
from farebox.operators.cycle import KEY
from farebox.staging import stage, staging_folder

RANK, ROUNDS, PENALTY, TRUST = 8, 10, 0.05, 10.0
ORDER = ["date_purchase", "second", "nk_ota_localizer_id", "route"]
MAX_BLOCKS = 200


def held_out_routes(chain: DataFrame, held_out: Column) -> DataFrame:
    """Last route of every customer that ``held_out`` names and that bought before."""
    last = chain.where(held_out).groupBy(KEY).agg(
        F.max(F.struct(*ORDER))["route"].alias("route"), F.count(F.lit(1)).alias("n")
    )
    return last.where("n > 1").select(KEY, "route")


def route_history(chain: DataFrame, held_out: DataFrame) -> DataFrame:
    """Purchases of each customer on each route, without the one purchase held out."""
    counts = chain.groupBy(KEY, "route").agg(F.count(F.lit(1)).alias("purchases"))
    away = F.when(F.col("away"), 1).otherwise(0)
    left = counts.join(held_out.select(KEY, "route", F.lit(True).alias("away")), [KEY, "route"], "left")
    return left.select(KEY, "route", (F.col("purchases") - away).alias("purchases")).where("purchases > 0")


def popular_routes(history: DataFrame, k: int = 3) -> DataFrame:
    """The k routes that most customers took, with their place; equal counts by name."""
    counts = history.groupBy("route").agg(F.count(F.lit(1)).alias("customers"))
    best = counts.orderBy(F.desc("customers"), "route").limit(k)
    return best.select("route", F.row_number().over(Window.orderBy(F.desc("customers"), "route")).alias("position"))


def numbered(keys: DataFrame, key: str, name: str) -> DataFrame:
    """Every different ``key`` with its place in the order of keys, from 0.

    Keys are range-partitioned; a block's numbers start where those before it end. The
    number depends on the keys alone, not on the blocks.
    """
    blocks = keys.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(key)
    placed = stage(blocks.withColumn("block", F.spark_partition_id()), f"numbered-{name}")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    starts = placed.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("block").orderBy(key)) - 1
    return placed.join(F.broadcast(starts), "block").select(key, (F.col("start") + nth).cast("int").alias(name))


@dataclass
class RouteFactors:
    """Fitted factors with the numbers of customers and routes; None without history."""

    model: ALSModel | None
    customers: DataFrame
    routes: DataFrame

    def recommend(self, customers: DataFrame, k: int = 3) -> DataFrame:
        """The k best routes for each of the given customers that has a history.

        Factors are multiplied in blocks of customers and routes, and only k of a block's
        scores are kept for a customer.
        """
        if self.model is None:
            nothing = [F.lit(None).cast(kind).alias(name) for name, kind in
                       (("position", "int"), ("route", "string"), ("score", "double"))]
            return customers.select(KEY, *nothing).where("false")
        asked = self.customers.join(customers.select(KEY).distinct(), KEY)
        best = self.model.recommendForUserSubset(asked.select("customer"), k)
        rows = best.select("customer", F.posexplode("recommendations").alias("place", "option")).select(
            "customer", (F.col("place") + 1).alias("position"), F.col("option.item").alias("item"),
            F.col("option.rating").cast("double").alias("score"),
        )
        return rows.join(asked, "customer").join(self.routes, "item").select(KEY, "position", "route", "score")


def fit_factors(history: DataFrame, rank: int = RANK) -> RouteFactors:
    """Alternating least squares on how often customers took routes; pass staged ``history``."""
    customers = stage(numbered(history, KEY, "customer"), "factor-customers")
    routes = stage(numbered(history, "route", "item"), "factor-routes")
    n = history.count()
    if not n:
        return RouteFactors(None, customers, routes)
    ratings = history.join(customers, KEY).join(routes, "route").select(
        "customer", "item", F.col("purchases").cast("float").alias("rating")
    )
    blocks = min(training_tasks(n), MAX_BLOCKS)
    als = ALS(
        userCol="customer", itemCol="item", ratingCol="rating", implicitPrefs=True, rank=rank, maxIter=ROUNDS,
        regParam=PENALTY, alpha=TRUST, numUserBlocks=blocks, numItemBlocks=blocks, seed=SEED,
    )
    return RouteFactors(staged_factors(als.fit(stage(ratings, "factor-ratings")), routes), customers, routes)


def staged_factors(model: ALSModel, routes: DataFrame) -> ALSModel:
    """The same model with its factors read from the checkpoint folder.

    The fit has a block of routes for so and so many purchases, however few the routes are.
    Recommending pairs all blocks of customers with all blocks of routes and keeps k rows of
    each pair for a customer, so there the routes get blocks by their own number.
    """
    path = f"{staging_folder(routes.sparkSession)}/factor-model-{uuid.uuid4().hex}"
    model.save(path)
    blocks = -(-routes.count() // LARGE_TASK_ROWS)
    model.itemFactors.coalesce(blocks).write.mode("overwrite").parquet(f"{path}/itemFactors")
    return ALSModel.load(path)


def ranking_metrics(held_out: DataFrame, ranked: DataFrame) -> DataFrame:
    """Hit rate, NDCG and mean reciprocal rank of ``ranked`` (by position from 1); one row.

    A customer's held-out route counts at its best position; unranked routes count 0.
    ``ranked`` holds places of routes for each customer, or the same ones for all.
    """
    keys = [c for c in (KEY, "route") if c in ranked.columns]
    places = ranked.groupBy(*keys).agg(F.min("position").alias("position"))
    found = held_out.join(places, keys, "left")
    place = F.col("position")
    n = F.count(F.lit(1))

    def mean(value: Column) -> Column:
        return F.round(ratio(F.coalesce(F.sum(value), F.lit(0.0)), n), 9)

    return found.agg(
        n.alias("customers"),
        mean(F.when(place.isNotNull(), 1.0)).alias("hit_rate"),
        mean(1 / F.log2(place + 1)).alias("ndcg"),
        mean(1 / place).alias("reciprocal_rank"),
    )


def collaborative_metrics(held_out: DataFrame, factors: RouteFactors, popular: DataFrame, k: int = 3) -> DataFrame:
    """Metrics of the factors beside those of naming the most popular routes."""
    by_factors = ranking_metrics(held_out, factors.recommend(held_out, k))
    by_place = ranking_metrics(held_out, popular)
    return by_factors.select(F.lit("factors").alias("ranking"), "*").unionByName(
        by_place.select(F.lit("popular").alias("ranking"), "*")
    )
