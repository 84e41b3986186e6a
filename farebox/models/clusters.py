"""Customer clusters by k-means on scaled RFM, with their silhouette in one pass."""

from dataclasses import dataclass

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox.functions.fixed_values import SEED
from farebox.functions.measures import scalar_struct
from farebox.models.features import FEATURES
from farebox.models.forest import training_layout
from farebox.operators.cycle import KEY

CLUSTERS, ROUNDS = 4, 30
SCALED = [f"scaled_{name}" for name in FEATURES]


def scaled(rfm: DataFrame) -> DataFrame:
    """``rfm`` with its features as logarithms (negative values as 0), each with mean 0 and
    deviation 1; 0 where all customers are alike. Rows with a null feature are left out."""
    logs = {f"log_{name}": F.log1p(F.greatest(F.col(name), F.lit(0))) for name in FEATURES}
    rows = rfm.dropna(subset=FEATURES).withColumns(logs)
    facts = rows.agg(
        *[F.avg(log).alias(f"mean_{log}") for log in logs], *[F.stddev_pop(log).alias(f"dev_{log}") for log in logs]
    )
    rows = rows.withColumn("facts", scalar_struct(facts))

    def scale(log: str) -> Column:
        dev = F.round(F.col(f"facts.dev_{log}"), 9)  # the last bits depend on the order of rows
        away = F.col(log) - F.round(F.col(f"facts.mean_{log}"), 9)
        return F.when(dev > 0, away / dev).otherwise(0.0)

    return rows.withColumns({f"scaled_{name}": scale(f"log_{name}") for name in FEATURES}).drop("facts", *logs)


@dataclass
class Clusters:
    """The fitted centres, numbered from the most valuable down. Without a model all rows are
    one cluster, or there were none."""

    model: KMeansModel | None
    order: dict[int, int]

    def assign(self, rows: DataFrame) -> DataFrame:
        """``cluster`` for scaled rows."""
        if self.model is None:
            return rows.withColumn("cluster", F.lit(0))
        found = self.model.transform(_with_points(rows))
        pairs = [F.lit(x) for pair in self.order.items() for x in pair]
        return found.select(*rows.columns, F.create_map(*pairs)[F.col("prediction")].alias("cluster"))


def _with_points(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=SCALED, outputCol="point").transform(rows)


def fit_clusters(rows: DataFrame, k: int = CLUSTERS) -> Clusters:
    """Fit on staged scaled rows from a k-means|| start.

    The rows are laid out by themselves first, so the draws of the start, and with them the
    clusters, do not depend on how the rows were read. There are no more clusters than
    different rows.
    """
    n = rows.count()
    k = min(k, rows.select(*SCALED).distinct().limit(k).count())
    if k < 2:
        return Clusters(None, {})
    points = training_layout(_with_points(rows).select(KEY, *SCALED, "point"), n).persist()
    try:
        kmeans = KMeans(
            featuresCol="point", predictionCol="prediction", k=k, initMode="k-means||", initSteps=4,
            maxIter=ROUNDS, seed=SEED,
        )
        model = kmeans.fit(points)
    finally:
        points.unpersist()
    value = SCALED.index("scaled_monetary")
    centres = sorted(enumerate(model.clusterCenters()), key=lambda c: (-c[1][value], c[0]))
    return Clusters(model, {old: new for new, (old, _) in enumerate(centres)})


def silhouettes(rows: DataFrame) -> DataFrame:
    """Rows with ``cluster`` and scaled features, plus ``silhouette`` by squared distances.

    The mean squared distance to all members of a cluster follows from its size, its mean
    and its mean square, so one row per cluster stands for all pairs. 0 for the only member
    of a cluster, null where there is one cluster.
    """
    square = sum((F.col(x) * F.col(x) for x in SCALED), F.lit(0.0))
    stats = rows.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(x) for x in SCALED], F.avg(square).alias("square")
    )
    every = stats.agg(F.sort_array(F.collect_list(F.struct(*stats.columns))).alias("x")).scalar()

    def distance(c: Column) -> Column:
        product = sum((F.col(x) * c[x] for x in SCALED), F.lit(0.0))
        return F.greatest(square - 2 * product + c["square"], F.lit(0.0))

    own = F.filter("clusters", lambda c: c["cluster"] == F.col("cluster"))[0]
    others = F.filter("clusters", lambda c: c["cluster"] != F.col("cluster"))
    near = F.array_min(F.transform(others, distance))
    inside = distance(own) * own["n"] / (own["n"] - 1)
    most = F.greatest("inside", "near")
    value = F.when(F.col("near").isNull(), None).when(F.col("alone"), 0.0).when(most == 0, 0.0)
    value = value.otherwise((F.col("near") - F.col("inside")) / most)
    return (
        rows.withColumn("clusters", every)
        .withColumns({"near": near, "alone": own["n"] == 1, "inside": F.when(own["n"] > 1, inside)})
        .withColumn("silhouette", value).drop("clusters", "near", "alone", "inside")
    )


def cluster_profile(assigned: DataFrame) -> DataFrame:
    """Size, mean RFM and mean silhouette of every cluster."""
    return silhouettes(assigned).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("customers"),
        *[F.round(F.avg(name), 6).alias(f"mean_{name}") for name in FEATURES],
        F.round(F.avg("silhouette"), 6).alias("silhouette"),
    )
