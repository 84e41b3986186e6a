"""The driver's contract, and the command line."""

import datetime
import subprocess
import sys

from conftest import ROOT, SF_SMALL

import __spark_entry__ as contract
from farebox.plans.reports import REPORTS, available, write_reports
from farebox.plans.workspace import Workspace
from farebox.sources.star_schema import raw_event_purchases, raw_purchases


def test_importing_needs_no_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 60; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_entry(spark):
    report = contract.entry(spark)
    assert report.count() == 9 and "Segment" in report.columns


def test_oracles_belong_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_reports_are_written(spark, tmp_path):
    w = Workspace(raw_event_purchases(spark, SF_SMALL), datetime.date(2024, 2, 1))
    names = ["kpi_overview", "gmv_by_month", "rfm_segments", "cohort_grid", "interval_stats"]
    assert set(names) <= set(REPORTS)
    write_reports(w, str(tmp_path), names)
    for name in names:
        assert spark.read.parquet(str(tmp_path / name)).count() > 0


def test_reports_without_return_columns(spark, edge_raw):
    slim = edge_raw.drop("place_origin_return", "fk_return_ota_bus_company")
    names = available(Workspace(slim, datetime.date(2024, 5, 1)))
    assert set(REPORTS) - set(names) == {"round_trip_comparison", "same_company_share"}
    assert set(available(Workspace(edge_raw, datetime.date(2024, 5, 1)))) == set(REPORTS)


SPREAD = [
    "kpi_overview", "gmv_by_month", "best_contact_slot", "rfm_segments", "segment_report",
    "purchase_intervals", "interval_stats", "next_purchase_labels", "cohort_retention",
    "customer_ranking", "route_features", "avg_ticket_price", "rfm_histograms",
]


def test_results_do_not_depend_on_partitioning(spark):
    raw = raw_purchases(spark, SF_SMALL).cache()
    as_of = datetime.date(2001, 9, 1)
    one = Workspace(raw.coalesce(1), as_of)
    many = Workspace(raw.repartition(13, "time_purchase"), as_of)
    for name in SPREAD:
        tables = [sorted(map(str, REPORTS[name](w).collect())) for w in (one, many)]
        assert tables[0] == tables[1], name


def test_shared_tables_are_made_once(spark):
    w = Workspace(raw_event_purchases(spark, SF_SMALL), datetime.date(2024, 2, 1))
    assert w.rfm is w.rfm and w.segments is w.segments
    assert w.rfm.inputFiles() and all("/rfm-" in path for path in w.rfm.inputFiles())


FOUR = "nk_ota_localizer_id,fk_contact,date_purchase,gmv_success\n1,a,2024-01-05,10.0\n2,b,2024-01-06,20.5\n"


def test_few_columns_and_no_repeat_customer(spark, tmp_path):
    (tmp_path / "few.csv").write_text(FOUR)
    (tmp_path / "personas.txt").write_text("Leais: fiéis\n")
    w = Workspace.read(spark, str(tmp_path / "few.csv"), datetime.date(2024, 2, 1), str(tmp_path / "personas.txt"))
    left_out = write_reports(w, str(tmp_path / "out"))
    assert {"gmv_by_hour", "kpi_overview", "route_ranking", "same_company_share"} <= set(left_out)
    written = set(REPORTS) - set(left_out)
    assert {"rfm_segments", "cohort_grid", "repurchase_metrics", "segment_profiles"} <= written
    read = lambda name: spark.read.parquet(str(tmp_path / "out" / name))
    assert all(not r.enough_data and r.auc is None for r in read("repurchase_metrics").collect())
    assert "persona" in read("segment_profiles").columns


def test_staged_tables_go_when_the_last_workspace_closes(spark, tmp_path):
    code = f"""
import datetime, os
from pyspark.sql import SparkSession
from farebox.plans.workspace import Workspace
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", "{tmp_path}/shared").getOrCreate())
one, two = (Workspace.on_star_schema(spark, "{SF_SMALL}", datetime.date(2001, 9, 1)) for _ in range(2))
one.rfm, two.cohorts
one.close()
assert spark.conf.get("spark.app.id") in os.listdir("{tmp_path}/shared")
assert two.cohorts.count() > 0
two.close()
app = spark.conf.get("spark.app.id")
assert app not in os.listdir("{tmp_path}/shared")
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=300)


def test_changed_files_give_new_results(spark, tmp_path):
    import os
    import shutil

    from farebox.plans.queries import QUERIES

    for name in ("orders", "lineitem", "customer", "supplier", "nation"):
        shutil.copy(f"{SF_SMALL}/{name}.parquet", tmp_path / f"{name}.parquet")
        os.chmod(tmp_path / f"{name}.parquet", 0o644)
    before = QUERIES["rfm"](spark, str(tmp_path)).count()
    spark.read.parquet(f"{SF_SMALL}/orders.parquet").where("o_custkey < 50").toPandas().to_parquet(
        tmp_path / "orders.parquet", coerce_timestamps="us"
    )
    os.utime(tmp_path / "orders.parquet", (2_000_000_000, 2_000_000_000))
    assert QUERIES["rfm"](spark, str(tmp_path)).count() < before
