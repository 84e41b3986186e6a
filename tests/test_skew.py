"""One customer, day or order holding a third of the rows changes no result."""

import datetime
import random
from collections import Counter

import pytest
from conftest import SF
from pyspark.sql import functions as F

from farebox.operators import cohort, cycle, skew
from farebox.operators import rfm as R
from farebox.sources.star_schema import raw_purchases

SCHEMA = "nk_ota_localizer_id string, fk_contact string, date_purchase date, gmv_success double"


def skewed_purchases(n: int = 6000):
    rng = random.Random(3)
    first = datetime.date(2023, 1, 1)
    for i in range(n):
        hot = rng.random() < 1 / 3
        # A third of the hot customer's rows fall on one day.
        day = 200 if hot and rng.random() < 1 / 3 else rng.randrange(500)
        customer = "hot" if hot else f"c{rng.randrange(300)}"
        yield (f"p{i}", customer, first + datetime.timedelta(day), float(rng.randrange(1, 900)))


@pytest.fixture(scope="module")
def rows():
    return list(skewed_purchases())


@pytest.fixture(scope="module")
def purchases(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(8).cache()


def by_customer(rows):
    days = {}
    for _, customer, day, _ in rows:
        days.setdefault(customer, []).append(day)
    return {customer: sorted(found) for customer, found in days.items()}


def test_intervals_equal_row_by_row(purchases, rows):
    expected = Counter(
        (customer, after, before, (after - before).days)
        for customer, days in by_customer(rows).items()
        for before, after in zip(days, days[1:])
    )
    found = Counter()
    for r in cycle.purchase_intervals(purchases).collect():
        found[tuple(r)[:4]] += r.purchases
    assert found == expected


@pytest.mark.parametrize("one", [False, True])
def test_labels_equal_row_by_row(purchases, rows, one):
    expected = Counter()
    for customer, days in by_customer(rows).items():
        pairs = list(zip(days, days[1:]))
        if pairs:
            last = max(day for day, _ in pairs)
            here = [(customer, day, after, (after - day).days) for day, after in pairs if day == last]
            expected.update([max(here, key=lambda x: x[3])] if one else here)
    found = Counter()
    for r in cycle.next_purchase_labels(purchases, one).collect():
        found[tuple(r)[:4]] += r.purchases
        assert r.will_buy_next_7_days <= r.will_buy_next_15_days <= r.will_buy_next_30_days
    assert found == expected


def test_windows_run_on_at_most_one_row_per_calendar_day(purchases, rows):
    per_customer = cycle.purchase_days(purchases).groupBy("fk_contact").count()
    calendar = len({day for _, _, day, _ in rows})
    assert per_customer.agg(F.max("count")).first()[0] <= calendar
    plan = cycle.purchase_intervals(purchases)._jdf.queryExecution().executedPlan().toString()
    window, aggregate = plan.index("Window"), plan.index("HashAggregate(keys=[fk_contact")
    assert window < aggregate


def test_rfm_of_the_hot_customer(purchases, rows):
    hot = R.rfm(purchases, datetime.date(2024, 6, 1)).where("fk_contact = 'hot'").first()
    own = [row for row in rows if row[1] == "hot"]
    assert hot.frequency == len(own) and hot.monetary == sum(row[3] for row in own)


@pytest.fixture
def small_partitions(spark):
    """No broadcasts by size, and everything above a few kB counts as skewed."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_hot_customers_stay_out_of_the_shuffled_join(spark, purchases, rows, monkeypatch, small_partitions):
    monkeypatch.setattr(skew, "HOT_ONE_IN", 20)
    firsts = purchases.groupBy("fk_contact").agg(
        F.min("date_purchase").alias("first"), F.count(F.lit(1)).alias("n")
    )
    joined = skew.join_per_key(purchases, firsts, "fk_contact", "n")
    assert joined.count() == len(rows)
    hot = firsts.where("n * 20 > 6000")
    assert [r.fk_contact for r in hot.collect()] == ["hot"]
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [fk_contact" in plan and "LeftAnti" in plan


def test_star_schema_joins_can_be_split(spark, small_partitions, tmp_path):
    orders = spark.range(60_000).select(
        F.col("id").alias("o_orderkey"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).alias("o_custkey"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 900).cast("int"))
        .cast("timestamp_ntz").alias("o_orderdate"),
        F.col("id").cast("double").alias("o_totalprice"),
    )
    orders.repartition(8).write.parquet(str(tmp_path / "orders.parquet"))
    lines = orders.select(
        F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_partkey"),
        (F.col("o_orderkey") % 40).alias("l_suppkey"), F.lit(1).alias("l_linenumber"),
        F.lit("R").alias("l_returnflag"),
    )
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    for table in ("customer", "supplier", "nation"):
        spark.read.parquet(f"{SF}/{table}.parquet").write.parquet(str(tmp_path / f"{table}.parquet"))
    frame = raw_purchases(spark, str(tmp_path))
    assert len(frame.collect()) == 60_000
    assert "SortMergeJoin(skew=true)" in frame._jdf.queryExecution().executedPlan().toString()


def test_cohorts_equal_row_by_row(purchases, rows):
    counts = cohort.cohort_counts(purchases)
    found = {(r.primeira_compra, r.periods): r.purchases for r in counts.collect()}
    expected = Counter()
    firsts = {customer: days[0].replace(day=1) for customer, days in by_customer(rows).items()}
    for _, customer, day, _ in rows:
        first = firsts[customer]
        expected[(first, (day.year - first.year) * 12 + day.month - first.month)] += 1
    assert found == expected
