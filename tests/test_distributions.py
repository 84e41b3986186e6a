"""Histograms and the price density against direct computation."""

import numpy as np
import pytest

from farebox.operators import cart
from farebox.operators.distributions import histogram, ticket_price_density
from farebox.plans.queries import QUERIES, workspace
from conftest import SF_SMALL


def test_histogram_equals_numpy(spark):
    values = np.random.default_rng(1).normal(50, 12, 4000).round(3)
    frame = spark.createDataFrame([(float(v),) for v in values], "x double")
    found = {r.bin: r.n for r in histogram(frame, "x", 30).collect()}
    counts, _ = np.histogram(values, bins=30)
    assert [found.get(i, 0) for i in range(30)] == counts.tolist()


def test_histogram_of_one_value(spark):
    frame = spark.createDataFrame([(4.0,), (4.0,), (None,)], "x double")
    assert [tuple(r) for r in histogram(frame, "x", 10).collect()] == [(0, 4.0, 4.0, 2)]


def test_density_equals_the_sum_over_all_prices(spark):
    prices = cart.ticket_prices(workspace(spark, SF_SMALL).trips)
    x = np.array([r.price for r in prices.collect()])
    found = np.array([r.density for r in ticket_price_density(prices).orderBy("point").collect()])
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 200)
    exact = np.exp(-(((grid[:, None] - x) / h) ** 2) / 2).sum(1) / (h * np.sqrt(2 * np.pi))
    exact *= (x.max() - x.min()) / 30
    assert np.abs(found - exact).max() < 2e-3 * exact.max()


def test_shares_sum_to_a_hundred(spark):
    report = QUERIES["segment_report"](spark, SF_SMALL).collect()
    assert sum(r.pct_customers for r in report) == pytest.approx(100)
    assert sum(r.pct_value for r in report) == pytest.approx(100)
    assert sum(r.customers for r in report) == 150


def test_density_with_one_far_price(spark):
    prices = spark.createDataFrame([(float(50 + i % 40),) for i in range(500)] + [(1e9,)], "price double")
    rows = {r.point: r for r in ticket_price_density(prices).collect()}
    assert len(rows) == 200 and rows[0].price == 50.0 and rows[199].price == 1e9
    assert rows[0].density > 0 and all(r.density is not None for r in rows.values())
    pairs = ticket_price_density(prices)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" in pairs and pairs.count("LogicalRDD") == 1  # one scan besides the moments


def test_density_of_prices_very_near_each_other(spark):
    prices = spark.createDataFrame([(10 + (i % 7) * 1e-6,) for i in range(700)], "price double")
    rows = ticket_price_density(prices).collect()
    assert len(rows) == 200 and all(r.density > 0 for r in rows)


def test_density_without_spread_or_rows(spark):
    same = spark.createDataFrame([(3.0,), (3.0,)], "price double")
    assert {(r.price, r.density) for r in ticket_price_density(same).collect()} == {(3.0, None)}
    assert ticket_price_density(same.where("false")).count() == 200


def test_kpi_plan_does_not_multiply_rows(spark):
    from conftest import SF_SMALL

    from farebox.plans.queries import QUERIES

    plan = QUERIES["kpi_overview"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
