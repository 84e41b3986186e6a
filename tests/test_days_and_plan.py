"""Days to the next purchase as a number, and the joint plan for a list of customers."""

import math
import random

import pytest

from farebox.models import days_to_next
from farebox.models.features import FEATURES
from farebox.models.joint import joint_plan

SCHEMA = "fk_contact string, recency int, frequency long, monetary double, days_until_next_purchase int, purchases long"


@pytest.fixture(scope="module")
def planted(spark):
    """Frequent customers come back after some 10 days, others after some 60."""
    r = random.Random(11)
    rows = []
    for i in range(3000):
        often = i % 2
        days = max(0, round(r.gauss(10 if often else 60, 4)))
        rows.append((f"c{i}", r.randrange(90), 12 + r.randrange(9) if often else 1 + r.randrange(5), r.random() * 100, days, 1 + i % 3))
    return spark.createDataFrame(rows, SCHEMA).cache()


def test_trees_beat_the_mean(planted):
    model = days_to_next.fit_days(planted)
    row = days_to_next.days_metrics(model.score(planted)).first()
    assert row.rmse < 6 < 20 < row.rmse_of_mean and row.mae < row.mae_of_mean
    again = days_to_next.fit_days(planted.repartition(7))
    one, two = (m.score(planted).select("fk_contact", "predicted_days") for m in (model, again))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert model.score(planted.select("fk_contact", *FEATURES)).where("predicted_days < 0").count() == 0


def test_metrics_by_hand(spark, planted):
    scores = planted.selectExpr("*", "cast(recency as double) as predicted_days").cache()
    row = days_to_next.days_metrics(scores).first()
    import hashlib

    side = lambda who: int(hashlib.md5(who.encode()).hexdigest()[:8], 16) % 100 < 80
    rows = scores.collect()
    train, test = [r for r in rows if side(r.fk_contact)], [r for r in rows if not side(r.fk_contact)]
    mean = sum(r.purchases * r.days_until_next_purchase for r in train) / sum(r.purchases for r in train)
    n = sum(r.purchases for r in test)
    assert row.test_rows == n
    for guess, got in ((lambda r: r.recency, row.rmse), (lambda r: mean, row.rmse_of_mean)):
        exact = math.sqrt(sum(r.purchases * (guess(r) - r.days_until_next_purchase) ** 2 for r in test) / n)
        assert got == pytest.approx(exact, abs=1e-5)


def test_no_data(spark):
    empty = spark.createDataFrame([], SCHEMA)
    model = days_to_next.fit_days(empty)
    assert model.trees is None
    row = days_to_next.days_metrics(model.score(empty)).first()
    assert row.test_rows == 0 and row.rmse is None
    one = spark.createDataFrame([("x", 1, 1, 1.0, 5, 1)], SCHEMA)
    assert model.score(one).first().predicted_days is None


def test_joint_plan(spark):
    timing = spark.createDataFrame(
        [("a", 0.2, 0.5, 0.5), ("b", 0.9, 0.1, 0.2), ("c", None, None, None)],
        "fk_contact string, prob_7 double, prob_15 double, prob_30 double",
    )
    routes = spark.createDataFrame(
        [("a", "X -> Y", 0.5), ("c", "Y -> X", 1.0)], "fk_contact string, next_route string, probability double"
    )
    asked = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("new",), (None,)], "fk_contact string")
    got = sorted(map(tuple, joint_plan(asked, timing, routes).collect()), key=str)
    assert got == sorted(
        [
            ("a", True, 15, 0.5, "X -> Y", 0.5, 0.25), ("a", True, 15, 0.5, "X -> Y", 0.5, 0.25),
            ("b", True, 7, 0.9, None, None, None), ("c", True, None, None, "Y -> X", 1.0, None),
            ("new", False, None, None, None, None, None), (None, False, None, None, None, None, None),
        ],
        key=str,
    )


def test_list_of_one_id(spark):
    """A list filled by one id stays a list of that many rows."""
    asked = spark.range(20_000).selectExpr("'a' as fk_contact")
    timing = spark.createDataFrame([("a", 0.1, 0.2, 0.3)], "fk_contact string, prob_7 double, prob_15 double, prob_30 double")
    routes = spark.createDataFrame([("a", "r", 0.5)], "fk_contact string, next_route string, probability double")
    assert joint_plan(asked, timing, routes).where("best_window_days = 30 and known").count() == 20_000
