"""Metrics of any score column, and scores that need no model."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farebox.functions.fixed_values import HORIZONS, MIN_ROUTE_CUSTOMERS
from farebox.operators.cycle import KEY

SCORE_BUCKETS = 1024


def digest_score(key: Column, salt: str) -> Column:
    """0.00 to 0.99 from the key's digest: a stand-in for a probability, with many ties."""
    digest = F.md5(F.concat_ws(":", key, F.lit(salt)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 100 / 100


def with_digest_scores(profiles: DataFrame) -> DataFrame:
    """``prob_<horizon>`` by digest."""
    scores = {f"prob_{h}": digest_score(F.col(KEY), str(h)) for h in HORIZONS}
    return profiles.withColumns(scores)


def with_linear_scores(profiles: DataFrame) -> DataFrame:
    """``prob_<horizon>`` in steps of 0.001 from recency, frequency and value by fixed weights:
    a score that follows the features and needs no model."""
    seen, often, value = F.greatest("recency", F.lit(0)), F.col("frequency"), F.greatest("monetary", F.lit(0.0))
    scores = {
        f"prob_{h}": F.floor(
            (0.5 * (h / (seen + h)) + 0.3 * (often / (often + 10)) + 0.2 * (value / (value + 1_000_000))) * 1000
        ) / 1000
        for h in HORIZONS
    }
    return profiles.withColumns(scores)


def binary_metrics(scores: DataFrame, horizons: list[int]) -> DataFrame:
    """``auc`` (ties count half), ``f1`` and ``auc_of_answers`` of "above one half" for each
    horizon with rows. AUC is null where one class is missing.

    Rows are first counted by score. Scores then fall into ranges; what lies below a range
    comes from its total, what lies below a score inside the range from a window there.
    """
    cases = [
        F.struct(
            F.lit(h).alias("horizon_days"),
            F.col(f"prob_{h}").alias("score"),
            F.when(F.col(f"will_buy_next_{h}_days") == 1, F.col("purchases")).otherwise(0).alias("pos"),
            F.when(F.col(f"will_buy_next_{h}_days") == 0, F.col("purchases")).otherwise(0).alias("neg"),
        )
        for h in horizons
    ]
    counts = (
        scores.select(F.inline(F.array(*cases)))
        .where("score IS NOT NULL")
        .groupBy("horizon_days", "score")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .withColumn("range", F.floor(F.col("score") * SCORE_BUCKETS))
    )
    ranges = counts.groupBy("horizon_days", "range").agg(F.sum("neg").alias("neg"))
    lower = Window.partitionBy("horizon_days").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        "horizon_days", "range", F.coalesce(F.sum("neg").over(lower), F.lit(0)).alias("below_range")
    )
    inside = Window.partitionBy("horizon_days", "range").orderBy("score")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("below_range") + F.coalesce(F.sum("neg").over(inside), F.lit(0))
    ranked = counts.join(ranges, ["horizon_days", "range"]).withColumn("below", below)
    wide = "decimal(19,0)"
    won = F.sum(F.col("pos").cast(wide) * (2 * F.col("below") + F.col("neg")).cast(wide))
    said = F.col("score") > 0.5
    sums = ranked.groupBy("horizon_days").agg(
        won.cast("double").alias("won"),
        *[F.sum(c).cast("double").alias(c) for c in ("pos", "neg")],
        F.coalesce(F.sum(F.when(said, F.col("pos"))), F.lit(0)).cast("double").alias("tp"),
        F.coalesce(F.sum(F.when(said, F.col("neg"))), F.lit(0)).cast("double").alias("fp"),
    )
    pos, neg, tp, fp = map(F.col, ("pos", "neg", "tp", "fp"))
    both = (pos > 0) & (neg > 0)
    return sums.select(
        "horizon_days",
        F.when(both, F.col("won") / (2 * pos * neg)).alias("auc"),
        F.when(pos + fp > 0, 2 * tp / (tp + fp + pos)).otherwise(0.0).alias("f1"),
        F.when(both, (tp / pos + (neg - fp) / neg) / 2).alias("auc_of_answers"),
    )


def class_metrics(predicted: DataFrame, test: Column) -> DataFrame:
    """Accuracy of ``prediction`` against ``label`` where ``test`` holds, and against guessing
    uniformly among the routes there are; one row."""
    right = F.col("prediction") == F.col("label")
    judged = test & F.col("prediction").isNotNull()
    sums = predicted.agg(
        (F.count_if(test & right) / F.nullif(F.count_if(judged), F.lit(0))).alias("accuracy"),
        F.count_distinct("route").alias("classes"),
        F.count(F.lit(1)).alias("customers"),
        F.count_if(test).alias("test_rows"),
    )
    baseline = 1.0 / F.nullif(F.col("classes"), F.lit(0))
    return sums.withColumns(
        {
            "baseline": baseline,
            "lift": F.col("accuracy") / baseline,
            "points_above": (F.col("accuracy") - baseline) * 100,
            "enough_data": F.col("customers") >= MIN_ROUTE_CUSTOMERS,
        }
    )


def top_options(probabilities: Column, names: Column, k: int) -> Column:
    """The k best (probability, name) of two parallel arrays, best first; ties in array order."""
    options = F.transform(
        probabilities, lambda p, i: F.struct(p.alias("probability"), (-i).alias("order"))
    )
    best = F.slice(F.sort_array(options, asc=False), 1, k)
    return F.transform(
        best, lambda o: F.struct(F.get(names, -o["order"]).alias("route"), o["probability"])
    )
