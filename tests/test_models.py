"""Forests: bounds, repeatability, and the settings they are fitted with."""

import pytest
from conftest import SF, SF_SMALL
from pyspark.sql import functions as F

from farebox.functions.fixed_values import EARLY_REPURCHASE_FOREST
from farebox.models.features import FEATURES, LABELS, in_training
from farebox.models.forest import training_tasks
from farebox.models.repurchase import (
    fit_repurchase,
    repurchase_importance,
    repurchase_metrics,
    repurchase_model,
)
from farebox.models.routes import (
    fit_routes,
    profiles_of,
    route_importance,
    route_metrics,
    route_model,
)
from farebox.operators.decisions import contact_strategy, probability_band
from farebox.plans.queries import QUERIES, workspace
from farebox.staging import stage


def test_model_queries(spark):
    models = {r.horizon_days: r for r in QUERIES["repurchase_model"](spark, SF).collect()}
    assert set(models) == {7, 15, 30}
    for row in models.values():
        assert row.trees == 50 and row.depth <= 5 and row.classes == 2
        assert row.train_rows + row.test_rows == 1501
    route = QUERIES["route_model"](spark, SF).first()
    assert route.trees == 50 and route.depth <= 10 and route.classes == 10


def test_metrics_are_in_bounds(spark):
    for row in QUERIES["repurchase_metrics"](spark, SF).collect():
        assert 0 <= row.auc <= 1 and 0 <= row.f1 <= 1 and 0 <= row.auc_of_answers <= 1
        assert row.enough_data and row.labelled_rows == 1501
    route = QUERIES["route_metrics"](spark, SF).first()
    assert 0 <= route.accuracy <= 1 and route.baseline == pytest.approx(0.1)
    assert route.lift == pytest.approx(route.accuracy * 10)


def test_importances_sum_to_one(spark):
    rows = QUERIES["repurchase_importance"](spark, SF).collect()
    for horizon in (7, 15, 30):
        own = [r.importance for r in rows if r.horizon_days == horizon]
        assert sum(own) == pytest.approx(1) and own == sorted(own, reverse=True)
    assert sum(r.importance for r in QUERIES["route_importance"](spark, SF).collect()) == pytest.approx(1)


def test_everyone_is_scored(spark):
    scores = QUERIES["timing_scores"](spark, SF)
    assert scores.count() == 1500
    assert scores.where("prob_7 < 0 or prob_7 > 1 or prob_30 < 0 or prob_30 > 1").count() == 0
    assert QUERIES["repurchase_scores"](spark, SF).count() == 1501


def test_three_routes_per_customer_in_order(spark):
    rows = QUERIES["route_recommendations"](spark, SF)
    assert rows.count() == 4500 and rows.select("fk_contact").distinct().count() == 1500
    pairs = rows.alias("a").join(rows.alias("b"), "fk_contact").where("a.position < b.position")
    assert pairs.where("a.probability < b.probability").count() == 0


def test_top_customers_have_the_highest_probabilities(spark):
    best = QUERIES["repurchase_scores"](spark, SF).orderBy(F.desc("prob_15")).limit(10)
    top = QUERIES["top_repurchase_customers"](spark, SF).collect()
    assert sorted(r.prob_15 for r in top) == sorted(r.prob_15 for r in best.collect())
    assert len(top) == 10 and all(r.Segment for r in top)


def test_refitting_on_other_partitions_gives_the_same_forests(spark):
    features = workspace(spark, SF_SMALL).repurchase_features
    again = stage(features.repartition(5, "monetary"), "spread-features")
    scores = [
        sorted(fit_repurchase(table).score(features).collect()) for table in (features, again)
    ]
    assert scores[0] == scores[1]
    routes = workspace(spark, SF_SMALL).route_features
    spread = stage(routes.repartition(3, "route"), "spread-routes")
    models = [fit_routes(table) for table in (routes, spread)]
    assert models[0].forest.toDebugString.split("\n")[1:] == models[1].forest.toDebugString.split("\n")[1:]


def test_early_settings(spark):
    features = workspace(spark, SF_SMALL).repurchase_features
    models = fit_repurchase(features, [7], EARLY_REPURCHASE_FOREST)
    row = repurchase_model(spark, models).first()
    assert row.trees == 100 and models.forests[7].getMaxDepth() == 30
    assert repurchase_metrics(models, models.score(features)).count() == 1


def test_no_training_rows(spark):
    w = workspace(spark, SF_SMALL)
    models = fit_repurchase(w.repurchase_features.where("false"))
    scores = models.score(w.repurchase_features.where("false"))
    for row in repurchase_metrics(models, scores).collect():
        assert (row.auc, row.f1, row.labelled_rows, row.enough_data) == (None, None, 0, False)
    assert [r.trees for r in repurchase_model(spark, models).collect()] == [None] * 3
    assert repurchase_importance(spark, models).count() == 0
    model = fit_routes(w.route_features.where("false"))
    row = route_metrics(model, w.route_features.where("false")).first()
    assert (row.accuracy, row.customers, row.enough_data) == (None, 0, False)
    assert route_model(spark, model).count() == 1 and route_importance(spark, model).count() == 0
    assert model.recommend(profiles_of(w.rfm)).count() == 0


def test_forests_learn_a_planted_signal(spark):
    rows = [(f"c{i}", i % 40, 1 + i % 3, float(i % 7), 9, int(i % 40 < 10), int(i % 40 < 20), 1, 1)
            for i in range(2000)]
    names = ["fk_contact", *FEATURES, "days_until_next_purchase", *LABELS, "purchases"]
    features = stage(spark.createDataFrame(rows, names), "planted")
    models = fit_repurchase(features)
    found = {r.horizon_days: r for r in repurchase_metrics(models, models.score(features)).collect()}
    assert found[7].auc > 0.95 and found[15].auc > 0.95 and found[7].f1 > 0.9
    assert found[30].auc is None and found[30].f1 == 1.0
    routed = features.select("fk_contact", *FEATURES, F.concat(F.lit("r"), F.floor(F.col("recency") / 20)).alias("route"))
    row = route_metrics(fit_routes(stage(routed, "planted-routes")), routed).first()
    assert row.classes == 2 and row.accuracy > 0.95 and row.lift > 1.9


def test_tasks_grow_with_the_rows():
    assert [training_tasks(n) for n in (0, 1_500, 50_001, 5_000_000)] == [1, 1, 2, 100]
    assert training_tasks(10**8) == 1_000 and training_tasks(10**9) == 4_000


def test_route_sample_is_optional(spark):
    features = workspace(spark, SF).route_features
    assert fit_routes(features, max_customers=120).customers == 120
    assert fit_routes(features).customers == features.count()


def test_split_share(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    share = keys.agg(F.avg(in_training(F.col("k")).cast("double"))).first()[0]
    assert share == pytest.approx(0.8, abs=0.01)


def test_contact_plan(spark):
    plan = QUERIES["contact_plan"](spark, SF)
    assert plan.count() == 1500
    best = F.greatest("prob_7", "prob_15", "prob_30")
    assert plan.where(F.col("best_probability") != best).count() == 0
    chosen = F.expr("case best_window_days when 7 then prob_7 when 15 then prob_15 else prob_30 end")
    assert plan.where(F.col("best_probability") != chosen).count() == 0
    assert plan.select("contact_day", "contact_hour").distinct().count() == 1


def test_bands(spark):
    frame = spark.createDataFrame([(0.3,), (0.31,), (0.41,), (0.61,), (0.71,)], "p double")
    p = F.col("p")
    rows = frame.select(probability_band(p), contact_strategy(p)).collect()
    assert [r[0] for r in rows] == ["red", "orange", "orange", "green", "green"]
    assert len({r[1] for r in rows}) == 3 and rows[0][1] == rows[1][1] and rows[2][1] == rows[3][1]
