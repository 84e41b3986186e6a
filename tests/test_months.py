"""A new month reads and writes that month only, and the store equals a full run."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from farebox.operators import monthly
from farebox.sources import months

MAY, JAN, FEB = (datetime.date(2024, m, 1) for m in (5, 1, 2))


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select(*sorted(frame.columns)).collect()), key=str)


def in_may(edge, day="2024-05-03"):
    return edge.where("nk_ota_localizer_id IN ('T01', 'T05')").withColumns(
        {"date_purchase": F.lit(day).cast("date"), "purchase_year_month": F.lit(MAY)}
    )


@pytest.fixture
def store(spark, edge, tmp_path):
    folder = str(tmp_path / "store")
    touched = months.put_purchases(edge, folder, "first")
    assert touched == [datetime.date(2024, m, 1) for m in (1, 2, 3, 4)]
    assert months.refresh_results(spark, folder, touched) == list(months.RESULTS)
    return folder


def check_whole(spark, folder, purchases):
    assert rows_of(months.stored_purchases(spark, folder)) == rows_of(
        purchases.where("date_purchase IS NOT NULL").select(*months.stored_purchases(spark, folder).columns)
    )
    for name, (result, _) in months.RESULTS.items():
        assert rows_of(months.stored_result(spark, folder, name)) == rows_of(result(purchases)), name


def test_store_equals_a_full_run(spark, edge, store):
    check_whole(spark, store, edge)
    assert [r.nk_ota_localizer_id for r in months.undated_purchases(spark, store).collect()] == ["T11"]
    kpis = {r.purchase_year_month: r for r in months.stored_result(spark, store, "monthly_kpis").collect()}
    assert (kpis[JAN].purchases, kpis[JAN].customers, kpis[JAN].days, kpis[JAN].gmv) == (4, 2, 3, 525.5)


def test_new_month_touches_itself_only(spark, edge, store, tmp_path):
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "store").rglob("part-*") if "=2024" in str(f)}
    before = files()
    new = in_may(edge)
    assert months.put_purchases(new, store, "may") == [MAY]
    months.refresh_results(spark, store, [MAY])
    after = files()
    assert before.items() <= after.items() and all("2024-05" in str(f) for f in set(after) - set(before))
    check_whole(spark, store, edge.unionByName(new))
    assert months.undated_purchases(spark, store).count() == 1


def test_a_batch_can_come_again(spark, edge, store):
    months.put_purchases(edge, store, "first")
    changed = edge.where(F.col("purchase_year_month") == F.lit(FEB)).limit(1)
    assert months.put_purchases(changed, store, "february") == [FEB]
    months.refresh_results(spark, store, [FEB])
    check_whole(spark, store, edge.where(F.coalesce(F.col("purchase_year_month") != F.lit(FEB), F.lit(True))).unionByName(changed))
    assert months.undated_purchases(spark, store).count() == 1


def test_months_are_pruned(spark, store):
    plan = monthly.monthly_kpis(months.stored_purchases(spark, store, [FEB]))._jdf.queryExecution()
    scan = plan.executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*purchase_year_month#\d+ = 2024-02-01", scan)
    assert "ReadSchema: struct<fk_contact:string,date_purchase:date,gmv_success:double>" in scan
    files = months.stored_purchases(spark, store, [FEB]).select(F.input_file_name().alias("f")).distinct().collect()
    assert files and all("2024-02-01" in r.f for r in files)


def test_empty_and_undated_batches(spark, edge, tmp_path):
    folder = str(tmp_path / "empty")
    assert months.put_purchases(edge.where("false"), folder, "nothing") == []
    months.refresh_results(spark, folder, [])
    assert months.stored_purchases(spark, folder).count() == 0
    assert months.stored_result(spark, folder, "monthly_routes").count() == 0
    assert months.put_purchases(edge.where("date_purchase IS NULL"), folder, "un/dated") == []
    assert months.undated_purchases(spark, folder).count() == 1


def test_batches_with_other_columns(spark, edge, store):
    wider = in_may(edge).withColumn("channel", F.lit("app"))
    months.put_purchases(wider, store, "may")
    kept = months.stored_purchases(spark, store)
    assert {(r.purchase_year_month == MAY, r.channel) for r in kept.collect()} == {(True, "app"), (False, None)}
