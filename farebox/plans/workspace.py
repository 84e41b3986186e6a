"""One set of purchases and the intermediate tables its analyses share."""

import datetime
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.functions.cleaning import clean_purchases
from farebox.functions.fixed_values import PURCHASE_COLUMNS
from farebox.models import collaborative
from farebox.models.clusters import Clusters, fit_clusters, scaled
from farebox.models.collaborative import RouteFactors, fit_factors
from farebox.models.days_to_next import DaysModel, fit_days
from farebox.models.features import in_training, point_in_time_features, repurchase_features, route_features
from farebox.models.folds import cross_validated_scores
from farebox.models.repurchase import RepurchaseModels, fit_repurchase
from farebox.models.routes import RouteModel, fit_routes
from farebox.operators import cohort, cycle, rankings, sequence, survival
from farebox.operators import rfm as rfm_operators
from farebox.operators.decisions import best_contact_slot
from farebox.sources import months
from farebox.sources.reader import (
    conform,
    good_rows,
    is_csv,
    read_csv,
    read_personas,
    read_raw,
    rejected_lines,
)
from farebox.sources.star_schema import order_purchases, order_tickets, raw_purchases
from farebox.staging import release, stage, staging_folder


class Workspace:
    """Purchases and, each worked out at most once, what several analyses need.

    ``purchases`` stays a lazy plan, so an analysis of customers, dates and values scans
    only those columns. ``trips`` are the same rows for analyses that also need places,
    companies or tickets. Where getting those takes joins, ``slim`` gives the purchases
    without them, and the trips are staged on first use. The other staged tables are one
    row per customer, or smaller.
    """

    _open: set[int] = set()

    def __init__(
        self,
        raw: DataFrame,
        as_of: datetime.date | None = None,
        slim: DataFrame | None = None,
        personas: DataFrame | None = None,
        tickets: DataFrame | None = None,
        rejected: DataFrame | None = None,
    ):
        self.raw = raw
        self.rejected = rejected
        self.as_of = as_of
        self.slim = slim
        self.personas = personas
        self._tickets = tickets
        Workspace._open.add(id(self))
        self.purchases = clean_purchases(raw if slim is None else slim)
        self.spark: SparkSession = raw.sparkSession

    @classmethod
    def on_star_schema(cls, spark: SparkSession, folder: str, as_of: datetime.date) -> "Workspace":
        slim, tickets = order_purchases(spark, folder), order_tickets(spark, folder)
        return cls(raw_purchases(spark, folder), as_of, slim, tickets=tickets)

    @classmethod
    def read(
        cls,
        spark: SparkSession,
        path: str,
        as_of: datetime.date | None = None,
        personas: str | None = None,
    ) -> "Workspace":
        """On a purchases file, and a personas file for the segment profiles. CSV text is
        parsed once, into typed Parquet; its lines that are no rows become ``rejected``."""
        rejected = None
        if is_csv(path):
            records = conform(read_csv(spark, path))
            given = [c for c in PURCHASE_COLUMNS if c in records.columns]
            records = stage(clean_purchases(records).select(*given, "_fault", "_line"), "purchases")
            raw, rejected = good_rows(records), rejected_lines(records)
        else:
            raw = conform(read_raw(spark, path))
        found = read_personas(spark, personas) if personas else None
        return cls(raw, as_of, personas=found, rejected=rejected)

    def close(self) -> None:
        """The workspace is done. With the last open one go all tables the application staged."""
        Workspace._open.discard(id(self))
        if not Workspace._open:
            release(self.spark)

    @property
    def tickets(self) -> DataFrame:
        """Tickets per purchase, from the narrowest source there is."""
        return self.trips if self._tickets is None else self._tickets

    @cached_property
    def columns(self) -> set[str]:
        """Columns of the trips, known without staging them."""
        return set(clean_purchases(self.raw).columns)

    @cached_property
    def raw_trips(self) -> DataFrame:
        return self.raw if self.slim is None else stage(self.raw, "purchases")

    @cached_property
    def trips(self) -> DataFrame:
        return clean_purchases(self.raw_trips)

    @cached_property
    def rfm(self) -> DataFrame:
        return stage(rfm_operators.rfm(self.purchases, self.as_of), "rfm")

    @cached_property
    def quartiles(self) -> DataFrame:
        return rfm_operators.rfm_quartiles(self.rfm)

    @cached_property
    def segments(self) -> DataFrame:
        return rfm_operators.rfm_segments(self.quartiles)

    @cached_property
    def interval_lengths(self) -> DataFrame:
        intervals = cycle.purchase_intervals(self.purchases)
        return stage(cycle.interval_lengths(intervals), "interval-lengths")

    @cached_property
    def cohorts(self) -> DataFrame:
        return stage(cohort.cohort_counts(self.purchases), "cohorts")

    @cached_property
    def retention(self) -> DataFrame:
        return cohort.cohort_retention(self.cohorts)

    @cached_property
    def customer_totals(self) -> DataFrame:
        return stage(rankings.customer_totals(self.purchases), "customer-totals")

    @cached_property
    def labels(self) -> DataFrame:
        return stage(cycle.next_purchase_labels(self.purchases), "labels")

    @cached_property
    def repurchase_features(self) -> DataFrame:
        return stage(repurchase_features(self.labels, self.rfm), "repurchase-features")

    @cached_property
    def repurchase(self) -> RepurchaseModels:
        return fit_repurchase(self.repurchase_features)

    @cached_property
    def cross_validated_scores(self) -> DataFrame:
        return cross_validated_scores(self.repurchase_features)

    @cached_property
    def repurchase_scores(self) -> DataFrame:
        return stage(self.repurchase.score(self.repurchase_features), "repurchase-scores")

    @cached_property
    def top_routes(self) -> DataFrame:
        return stage(rankings.route_ranking(self.trips), "top-routes")

    @cached_property
    def route_features(self) -> DataFrame:
        features = route_features(self.trips, self.top_routes, self.as_of)
        return stage(features, "route-features")

    @cached_property
    def routes(self) -> RouteModel:
        return fit_routes(self.route_features)

    @cached_property
    def route_chain(self) -> DataFrame:
        return stage(sequence.route_chain(self.trips), "route-chain")

    @cached_property
    def scaled_rfm(self) -> DataFrame:
        return stage(scaled(self.rfm), "scaled-rfm")

    @cached_property
    def clusters(self) -> Clusters:
        return fit_clusters(self.scaled_rfm)

    @cached_property
    def held_out_routes(self) -> DataFrame:
        test = ~in_training(F.col("fk_contact"))
        return stage(collaborative.held_out_routes(self.route_chain, test), "held-out-routes")

    @cached_property
    def route_history(self) -> DataFrame:
        return stage(collaborative.route_history(self.route_chain, self.held_out_routes), "route-history")

    @cached_property
    def route_factors(self) -> RouteFactors:
        return fit_factors(self.route_history)

    @cached_property
    def next_route(self) -> DataFrame:
        return stage(sequence.next_route_markov(self.route_chain), "next-route")

    @cached_property
    def point_in_time_features(self) -> DataFrame:
        return stage(point_in_time_features(self.labels, self.purchases), "point-in-time-features")

    @cached_property
    def days_model(self) -> DaysModel:
        return fit_days(self.point_in_time_features)

    @cached_property
    def waits(self) -> DataFrame:
        intervals = cycle.purchase_intervals(self.purchases)
        return stage(survival.survival(survival.waits(intervals, self.rfm, self.segments)), "waits")

    @cached_property
    def contact_slot(self) -> DataFrame:
        return stage(best_contact_slot(self.purchases), "contact-slot")

    @cached_property
    def month_store(self) -> str:
        """Folder of a staged month store of the trips, filled in two batches."""
        folder = f"{staging_folder(self.spark)}/months-{uuid.uuid4().hex}"
        odd = F.coalesce(F.month("purchase_year_month") % 2 == 1, F.lit(True))
        for batch, side in (("odd", odd), ("even", ~odd)):
            touched = months.put_purchases(self.trips.where(side), folder, batch)
            months.refresh_results(self.spark, folder, touched)
        return folder
