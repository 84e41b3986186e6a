"""Folds keep customers whole; metrics of planted scores; models never see their fold."""

import statistics

import pytest
from pyspark.sql import functions as F

from farebox.models import folds

SCHEMA = (
    "fk_contact string, recency int, frequency long, monetary double, days_until_next_purchase int, "
    "will_buy_next_7_days int, will_buy_next_15_days int, will_buy_next_30_days int, purchases long"
)
FOREST = {"trees": 5, "depth": 3, "min_leaf": 1}


@pytest.fixture(scope="module")
def planted(spark):
    """Frequent customers come back within the week; one has a third of all lines."""
    rows = []
    for i in range(600):
        who = "hot" if i % 3 == 0 else f"c{i}"
        soon = int(i % 3 == 0 or i % 2)
        rows.append((who, 5, 20 if soon else 1, 10.0, 3 if soon else 90, soon, soon, soon, 1 + i % 2))
    return spark.createDataFrame(rows, SCHEMA).cache()


def test_no_customer_in_two_folds(planted):
    sizes = folds.fold_sizes(planted).collect()
    assert sum(r.customers for r in sizes) == planted.select("fk_contact").distinct().count() == 401
    assert sum(r.lines for r in sizes) == 600 and {r.fold for r in sizes} == {0, 1, 2}
    assert min(r.customers for r in sizes) > 90
    both = planted.groupBy("fk_contact").agg(F.count_distinct(folds.fold_of(F.col("fk_contact"))).alias("n"))
    assert both.where("n > 1").isEmpty()


def test_cross_validation_of_planted_customers(planted):
    scores = folds.cross_validated_scores(planted, forest=FOREST)
    assert scores.count() == 600
    metrics = folds.fold_metrics(scores).collect()
    assert len(metrics) == 9 and all(r.auc == 1 and r.f1 == 1 for r in metrics)
    guess = {r.fold: r.d for r in planted.groupBy(folds.fold_of(F.col("fk_contact")).alias("fold")).agg(
        F.sqrt(F.sum(F.col("purchases") * F.pow(F.col("will_buy_next_7_days") - 5 / 6, 2)) / F.sum("purchases")).alias("d")
    ).collect()}
    assert all(r.rmse < 0.75 * guess[r.fold] for r in metrics)


def test_summary_by_hand(spark, planted):
    scored = planted.withColumns({f"prob_{h}": F.when(F.col("frequency") > 1, 0.75).otherwise(0.5) for h in (7, 15, 30)})
    metrics = folds.fold_metrics(scored)
    rows = [r for r in metrics.collect() if r.horizon_days == 7]
    found = folds.fold_summary(metrics).where("horizon_days = 7").first()
    assert found.folds == 3 and found.mean_auc == 1.0 and found.deviation_f1 == 0.0
    assert found.mean_rmse == pytest.approx(statistics.mean(r.rmse for r in rows), abs=1e-8)
    assert found.deviation_rmse == pytest.approx(statistics.stdev(r.rmse for r in rows), abs=1e-8)


def test_empty_features(planted):
    nothing = planted.where("false")
    assert folds.fold_sizes(nothing).count() == 0
    assert folds.fold_metrics(folds.cross_validated_scores(nothing, forest=FOREST)).count() == 0
