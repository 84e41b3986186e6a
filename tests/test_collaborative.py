"""Route factors find planted groups; history, numbers and ranking metrics by hand."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from farebox.models import collaborative as c

SCHEMA = "fk_contact string, date_purchase date, second int, nk_ota_localizer_id string, route string"


def chain_of(spark, rows):
    return spark.createDataFrame(rows, "fk_contact string, day int, route string").select(
        "fk_contact", F.date_add(F.lit("2024-01-01"), F.col("day")).alias("date_purchase"),
        F.lit(-1).alias("second"), F.concat("fk_contact", F.lit("-"), "day").alias("nk_ota_localizer_id"), "route",
    )


@pytest.fixture(scope="module")
def planted(spark):
    """Five groups of customers, each with eight routes of its own; one customer has a third of
    all rows. Nobody takes a route twice, so only others of the group tell the last one."""
    r = random.Random(4)
    rows = []
    for i in range(500):
        own = r.sample(range(8), 6)
        rows += [(f"c{i}", day, f"g{i % 5}-{route}") for day, route in enumerate(own)]
    rows += [("hot", day, f"g{r.randrange(5)}-{r.randrange(8)}") for day in range(1500)]
    return chain_of(spark, rows).cache()


def test_factors_beat_popularity(spark, planted):
    held = c.held_out_routes(planted, F.col("fk_contact").like("c%0") | (F.col("fk_contact") == "hot")).cache()
    history = c.route_history(planted, held).cache()
    assert held.count() == 51
    assert history.agg(F.sum("purchases")).first()[0] == planted.count() - 51
    found = {r.ranking: r for r in c.collaborative_metrics(
        held, c.fit_factors(history), c.popular_routes(history)
    ).collect()}
    assert found["factors"].customers == found["popular"].customers == 51
    assert found["factors"].ndcg > found["popular"].ndcg

    # every one of the best six routes is of the customer's own group
    best = c.fit_factors(history).recommend(history.where("fk_contact <> 'hot'"), 6)
    rows = best.collect()
    assert len(rows) == 500 * 6
    assert all(int(r.fk_contact[1:]) % 5 == int(r.route[1]) for r in rows)
    assert Counter(r.position for r in rows) == {p: 500 for p in range(1, 7)}


def test_history_takes_one_purchase_away(spark):
    chain = chain_of(spark, [("a", 1, "X"), ("a", 2, "X"), ("a", 3, "X"), ("b", 1, "X"), ("c", 1, "X"), ("c", 2, "Y")])
    held = c.held_out_routes(chain, F.col("fk_contact") != "b")
    assert {tuple(r) for r in held.collect()} == {("a", "X"), ("c", "Y")}
    assert {tuple(r) for r in c.route_history(chain, held).collect()} == {("a", "X", 2), ("b", "X", 1), ("c", "X", 1)}


@pytest.mark.parametrize("parts", [1, 7])
def test_numbers_follow_the_keys(spark, parts):
    keys = spark.createDataFrame([(f"k{i % 300:03d}",) for i in range(900)] + [(None,)], "k string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = c.numbered(keys.repartition(parts), "k", "n").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.k, r.n) for r in found) == [(f"k{i:03d}", i) for i in range(300)]


def test_ranking_metrics_by_hand(spark):
    held = spark.createDataFrame([("a", "X"), ("b", "X"), ("c", "Y"), ("d", "Z")], "fk_contact string, route string")
    ranked = spark.createDataFrame(
        [("a", 1, "X"), ("b", 1, "Y"), ("b", 3, "X"), ("b", 2, "X"), ("c", 3, "Y"), ("e", 1, "Z")],
        "fk_contact string, position int, route string",
    )
    row = c.ranking_metrics(held, ranked).first()
    assert row.customers == 4 and row.hit_rate == 0.75
    assert row.ndcg == pytest.approx((1 + 1 / math.log2(3) + 1 / math.log2(4)) / 4, abs=1e-9)
    assert row.reciprocal_rank == pytest.approx((1 + 1 / 2 + 1 / 3) / 4, abs=1e-9)
    nobody = c.ranking_metrics(held.where("false"), ranked).first()
    assert tuple(nobody) == (0, 0.0, 0.0, 0.0)


def test_no_history(spark, planted):
    nothing = planted.where("false")
    history = c.route_history(nothing, c.held_out_routes(nothing, F.lit(True)))
    factors = c.fit_factors(history)
    assert factors.recommend(planted).count() == 0
    assert c.popular_routes(history).count() == 0


def test_route_blocks_follow_the_routes(spark, planted, monkeypatch):
    """However many blocks the fit has, recommending pairs few with those of the customers."""
    history = c.route_history(planted, c.held_out_routes(planted, F.lit(False))).cache()
    fitted = []
    staged = c.staged_factors
    monkeypatch.setattr(c, "training_tasks", lambda n: 12)
    monkeypatch.setattr(c, "staged_factors", lambda m, routes: fitted.append(m) or staged(m, routes))
    factors = c.fit_factors(history)
    assert fitted[0].itemFactors.rdd.getNumPartitions() == 12
    assert factors.model.itemFactors.rdd.getNumPartitions() == 1
    assert sorted(factors.model.itemFactors.collect()) == sorted(fitted[0].itemFactors.collect())

    found = {(r.fk_contact, r.position): r for r in factors.recommend(history).collect()}
    whole = c.RouteFactors(fitted[0], factors.customers, factors.routes).recommend(history).collect()
    assert len(found) == len(whole) == 501 * 3
    for r in whole:
        assert found[r.fk_contact, r.position].score == pytest.approx(r.score, abs=1e-6)


def test_metrics_take_few_tasks(spark, planted, monkeypatch):
    """Every task reports to the driver: there are not as many as pairs of fit blocks."""
    held = c.held_out_routes(planted, F.col("fk_contact").like("c%0")).cache()
    history = c.route_history(planted, held).cache()
    monkeypatch.setattr(c, "training_tasks", lambda n: 12)
    factors, popular = c.fit_factors(history), c.popular_routes(history)
    spark.sparkContext.setJobGroup("metrics", "metrics")
    try:
        assert len(c.collaborative_metrics(held, factors, popular).collect()) == 2
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    status = spark.sparkContext.statusTracker()
    stages = [s for j in status.getJobIdsForGroup("metrics") for s in status.getJobInfo(j).stageIds]
    assert stages and max(status.getStageInfo(s).numTasks for s in stages) < 12 * 12
