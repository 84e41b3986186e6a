"""Which of the most popular routes will a customer take?"""

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.feature import StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.functions.fixed_values import ROUTE_FOREST
from farebox.functions.measures import literal_rows
from farebox.models.features import FEATURES, in_training
from farebox.models.forest import (
    fit_forest,
    importances,
    size_of,
    training_layout,
    with_vector,
)
from farebox.models.metrics import class_metrics, top_options
from farebox.operators.cycle import KEY


@dataclass
class RouteModel:
    """The fitted forest (None without training rows) and its route names in class order."""

    forest: RandomForestClassificationModel | None
    routes: list[str]
    customers: int
    train_rows: int

    def recommend(self, profiles: DataFrame, k: int = 3) -> DataFrame:
        """The k most likely routes of every profile, best first. Ranked inside each
        row, so nothing is shuffled. No rows without a forest."""
        if self.forest is None:
            nothing = {"position": "int", "route": "string", "probability": "double"}
            return profiles.where("false").select(
                KEY, *[F.lit(None).cast(kind).alias(name) for name, kind in nothing.items()]
            )
        names = F.array(*[F.lit(route) for route in self.routes])
        best = top_options(vector_to_array("probability"), names, k)
        return ranked_options(self.forest.transform(with_vector(profiles)), best)


def ranked_options(profiles: DataFrame, best: Column) -> DataFrame:
    """One row per customer and place from an array of (route, probability)."""
    return profiles.select(KEY, F.posexplode(best).alias("place", "option")).select(
        KEY,
        (F.col("place") + 1).alias("position"),
        F.col("option.route").alias("route"),
        F.col("option.probability").alias("probability"),
    )


def _with_label(features: DataFrame, routes: list[str]) -> DataFrame:
    indexer = StringIndexerModel.from_labels(routes, inputCol="route", outputCol="label")
    return indexer.transform(features)


def fit_routes(
    features: DataFrame, forest: dict = ROUTE_FOREST, max_customers: int | None = None
) -> RouteModel:
    """Fit the route forest on the training side. Pass staged ``route_features``.

    The classes are all routes in the features, in alphabetical order, whether or not
    the training side has them, so a class number always means the same route.
    ``max_customers`` fits on a repeatable sample; by default all customers are used.
    """
    if max_customers is not None:
        features = features.orderBy(F.md5(KEY), KEY).limit(max_customers)
    side = in_training(F.col(KEY))
    sizes = features.agg(
        F.count(F.lit(1)).alias("all"),
        F.count_if(side).alias("train"),
        # At most TOP_ROUTES names.
        F.array_sort(F.collect_set("route")).alias("routes"),
    ).first()
    if not sizes["train"]:
        return RouteModel(None, list(sizes["routes"]), sizes["all"], 0)
    routes = list(sizes["routes"])
    train = training_layout(
        with_vector(_with_label(features.where(side), routes)).select(KEY, "features", "label"),
        sizes["train"],
    ).persist()
    try:
        fitted = fit_forest(train, "label", None, **forest)
    finally:
        train.unpersist()
    return RouteModel(fitted, routes, sizes["all"], sizes["train"])


def route_model(spark: SparkSession, model: RouteModel) -> DataFrame:
    row = (
        *size_of(model.forest),
        model.train_rows,
        model.customers - model.train_rows,
    )
    return literal_rows(
        spark,
        [row],
        {
            "trees": "int",
            "depth": "int",
            "nodes": "int",
            "classes": "int",
            "train_rows": "bigint",
            "test_rows": "bigint",
        },
    )


def route_metrics(model: RouteModel, features: DataFrame) -> DataFrame:
    """Accuracy on the test side against guessing uniformly; one row."""
    if model.forest is None:
        nothing = F.lit(None).cast("double")
        predicted = features.withColumns({"prediction": nothing, "label": nothing})
    else:
        predicted = model.forest.transform(with_vector(_with_label(features, model.routes)))
    return class_metrics(predicted, ~in_training(F.col(KEY)))


def route_importance(spark: SparkSession, model: RouteModel) -> DataFrame:
    rows = [
        (position, feature, value)
        for position, (feature, value) in enumerate(importances(model.forest), start=1)
    ]
    return literal_rows(
        spark, rows, {"position": "int", "feature": "string", "importance": "double"}
    )


def profiles_of(rfm: DataFrame) -> DataFrame:
    return rfm.select(KEY, *FEATURES)
