"""Chains of routes over blocks, Markov back-off, and waits with censoring, by brute force."""

import datetime
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from farebox.operators import cohort, sequence, survival

SCHEMA = "fk_contact string, date_purchase date, time_purchase_second int, nk_ota_localizer_id string, route string"
START = datetime.date(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    """A third of the purchases are one customer's; ties of day and second, nulls, repeats."""
    r = random.Random(8)
    out = []
    for i in range(3000):
        who = "hot" if i % 3 == 0 else f"c{r.randrange(400)}"
        day = None if i % 97 == 0 else START + datetime.timedelta(r.randrange(40))
        second = r.choice([None, 5, 60, 86399])
        out.append((None if i % 101 == 0 else who, day, second, f"p{i % 2900}", r.choice(["A", "B", "C", None])))
    return out


def brute_chain(rows):
    own = defaultdict(list)
    for who, day, second, purchase, route in rows:
        if who is not None and day is not None and route is not None:
            own[who].append((day, -1 if second is None else second, purchase, route))
    out = []
    for who, seen in own.items():
        seen.sort()
        routes = [None, None, *(s[3] for s in seen)]
        out += [(who, *s, routes[i + 1], routes[i]) for i, s in enumerate(seen)]
    return sorted(out, key=str)


@pytest.mark.parametrize("partitions", [1, 8, 40])
def test_chain_over_blocks(spark, rows, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chain = sequence.route_chain(spark.createDataFrame(rows, SCHEMA).repartition(6))
        assert sorted(map(tuple, chain.collect()), key=str) == brute_chain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_hot_customer_is_cut(spark, rows, monkeypatch):
    """No window takes more than a block of one customer."""
    staged = {}
    real = sequence.stage
    monkeypatch.setattr(sequence, "stage", lambda df, label: staged.setdefault(label, real(df, label)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sequence.route_chain(spark.createDataFrame(rows, SCHEMA)).count()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    blocks = staged["chain-blocks"].where("fk_contact = 'hot'").groupBy("block").count().collect()
    assert len(blocks) >= 3 and max(b["count"] for b in blocks) < 500


def test_back_off(spark):
    """A, B leads to C although B alone leads to D; rare contexts give way."""
    rows, day = [], lambda k: START + datetime.timedelta(k)
    for i in range(12):
        rows += [(f"x{i}", day(k), None, f"x{i}-{k}", route) for k, route in enumerate("ABC")]
    for i in range(20):
        rows += [(f"y{i}", day(k), None, f"y{i}-{k}", route) for k, route in enumerate("EBD")]
    asked = {"two": "AB", "one": "CB", "none": "C", "rare": "ZZ"}
    for who, routes in asked.items():
        rows += [(who, day(k), None, f"{who}-{k}", route) for k, route in enumerate(routes)]
    chain = sequence.route_chain(spark.createDataFrame(rows, SCHEMA))
    found = {r.fk_contact: r for r in sequence.next_route_markov(chain).collect()}
    assert (found["two"].next_route, found["two"].context_length, found["two"].probability) == ("C", 2, 1.0)
    assert (found["one"].next_route, found["one"].context_length) == ("D", 1)
    assert {found[w].context_length for w in ("none", "rare")} == {0} and found["none"].next_route == "B"
    assert len(found) == 36
    shares = {(r.previous_route, r.route): r.share for r in sequence.route_transitions(chain).collect()}
    assert shares[("B", "D")] == 20 / 32 and shares[("A", "B")] == 1
    metrics = sequence.markov_metrics(chain, ~F.col("fk_contact").isin("x0", "y0", "two")).first()
    assert (metrics.customers, metrics.accuracy, metrics.by_two_routes, metrics.by_one_route) == (3, 1.0, 2, 1)
    assert metrics.popular_accuracy == pytest.approx(1 / 3)
    empty = chain.where("false")
    assert sequence.next_route_markov(empty).count() == 0 and sequence.route_transitions(empty).count() == 0
    assert sequence.markov_metrics(empty, F.lit(True)).first().customers == 0


def test_survival_by_brute_force(spark):
    r = random.Random(3)
    intervals = [(f"c{r.randrange(60)}", r.randrange(50), r.randint(1, 3)) for _ in range(300)]
    rfm = [(f"c{i}", r.randrange(-3, 80), 1) for i in range(60)]
    segments = [(f"c{i}", "AB"[i % 2]) for i in range(60)]
    waits = survival.waits(
        spark.createDataFrame(intervals, "fk_contact string, days_since_prev_purchase int, purchases long"),
        spark.createDataFrame(rfm, "fk_contact string, recency int, frequency int"),
        spark.createDataFrame(segments, "fk_contact string, Segment string"),
    )
    segment = dict(segments)
    for row in survival.days_to_next_baseline(survival.survival(waits)).collect():
        ends, stays = Counter(), Counter()
        for who, days, n in intervals:
            ends[days] += n * (segment[who] == row.Segment)
        for who, recency, _ in rfm:
            stays[max(recency, 0)] += segment[who] == row.Segment
        left, median, chances = 1.0, None, {7: 0.0, 15: 0.0, 30: 0.0}
        for t in range(81):
            risk = sum(n for d, n in (ends + stays).items() if d >= t)
            left *= 1 - ends[t] / risk if risk else 1
            median = t if median is None and left <= 0.5 else median
            chances |= {h: 1 - left for h in chances if t <= h}
        assert (row.bought, row.waiting, row.median_days) == (sum(ends.values()), sum(stays.values()), median)
        for h, chance in chances.items():
            assert row[f"chance_{h}_days"] == pytest.approx(chance, abs=1e-6)


def test_waiting_customers_lengthen_the_median(spark):
    """Waits are 20 days, but only those of half the customers are over yet."""
    intervals = [(f"c{i}", 5, 1) for i in range(10)]
    rfm = [(f"c{i}", 40, 1) for i in range(30)]
    segments = spark.createDataFrame([(f"c{i}", "A") for i in range(30)], "fk_contact string, Segment string")
    waits = survival.waits(
        spark.createDataFrame(intervals, "fk_contact string, days_since_prev_purchase int, purchases long"),
        spark.createDataFrame(rfm, "fk_contact string, recency int, frequency int"), segments,
    )
    assert survival.naive_median(waits).first().median_days == 5
    row = survival.days_to_next_baseline(survival.survival(waits)).first()
    assert row.median_days is None and row.chance_7_days == 0.25


def test_mistyped_year_adds_few_columns(spark):
    """A first purchase in the year 202 and one 21,864 months later."""
    first = datetime.date(202, 1, 1)
    counts = spark.createDataFrame(
        [(first, 0, 1), (first, 21864, 1), (datetime.date(2024, 1, 1), 0, 4), (datetime.date(2024, 1, 1), 1, 2)],
        "primeira_compra date, periods int, purchases long",
    )
    retention = cohort.cohort_retention(counts)
    grid = cohort.cohort_grid(retention)
    assert grid.columns == ["primeira_compra", "p0", "p1", "p21864"]
    cells = {(r.primeira_compra.year, r.periods): r.retention for r in cohort.cohort_cells(retention).collect()}
    assert cells == {
        (202, 0): 100, (202, 1): None, (202, 21864): 100, (2024, 0): 100, (2024, 1): 50, (2024, 21864): None,
    }
    long = {tuple(r) for r in cohort.grid_to_rows(grid).collect()}
    assert long == {tuple(r) for r in cohort.cohort_cells(retention).collect()}
    plan = cohort.cohort_cells(retention)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert cohort.cohort_cells(retention.where("false")).count() == 0
