"""Every registered query: name -> (spark, table folder) -> DataFrame."""

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.functions.cleaning import clean_purchases
from farebox.models import metrics
from farebox.models.joint import joint_plan
from farebox.operators import overview
from farebox.plans.reports import REPORTS
from farebox.plans.workspace import Workspace
from farebox.sources.star_schema import as_text, modified, raw_event_purchases

# Day on which recency is taken: a month after the last order, two days after the last event.
AS_OF = datetime.date(2001, 9, 1)
EVENTS_AS_OF = datetime.date(2024, 2, 1)

PURCHASES_CLEAN_COLUMNS = [
    "nk_ota_localizer_id",
    "fk_contact",
    "date_purchase",
    "time_purchase",
    "time_purchase_hour",
    "gmv_success",
    "total_tickets_quantity_success",
    "purchase_year_month",
    "purchase_day_of_week",
    "purchase_month",
    "purchase_year",
    "purchase_day",
    "avg_ticket_price",
    "has_return",
    "route",
    "place_origin_departure",
    "place_destination_departure",
    "place_origin_return",
    "place_destination_return",
    "fk_departure_ota_bus_company",
    "fk_return_ota_bus_company",
]

# Analyses that also run over the event log, which has real clock times.
EVENT_REPORTS = {
    "events_kpi_overview": "kpi_overview",
    "events_weekday_hour_counts": "weekday_hour_counts",
    "events_rfm_segments": "rfm_segments",
    "events_interval_stats": "interval_stats",
    "events_next_purchase_labels": "next_purchase_labels",
}

_workspaces: dict[tuple, Workspace] = {}


def workspace(spark: SparkSession, folder: str, source: str = "orders") -> Workspace:
    """The session's workspace on a folder; its staged tables and models are shared until
    the files change."""
    files = ["orders", "lineitem", "customer", "supplier", "nation"] if source == "orders" else ["events"]
    key = (spark.conf.get("spark.app.id"), folder, source, *modified(spark, folder, files))
    if key not in _workspaces:
        if source == "orders":
            _workspaces[key] = Workspace.on_star_schema(spark, folder, AS_OF)
        else:
            _workspaces[key] = Workspace(raw_event_purchases(spark, folder), EVENTS_AS_OF)
    return _workspaces[key]


def purchases_clean(spark: SparkSession, folder: str) -> DataFrame:
    raw = as_text(workspace(spark, folder).raw_trips)
    return clean_purchases(raw).select(*PURCHASES_CLEAN_COLUMNS)


def ingest_profile(spark: SparkSession, folder: str) -> DataFrame:
    return overview.ingest_profile(as_text(workspace(spark, folder).raw_trips))


def asked_customers_plan(spark: SparkSession, folder: str) -> DataFrame:
    """When and where, by digest scores and Markov routes, for every customer on file; many
    of them have never bought."""
    w = workspace(spark, folder)
    asked = spark.read.parquet(f"{folder}/customer.parquet").select(F.col("c_custkey").cast("string").alias("fk_contact"))
    return joint_plan(asked, metrics.with_digest_scores(w.rfm), w.next_route)


def _query(report: Callable, source: str = "orders") -> Callable:
    return lambda spark, folder: report(workspace(spark, folder, source))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "purchases_clean": purchases_clean,
    "ingest_profile": ingest_profile,
    "asked_customers_plan": asked_customers_plan,
    **{name: _query(report) for name, report in REPORTS.items()},
    **{name: _query(REPORTS[report], "events") for name, report in EVENT_REPORTS.items()},
}
