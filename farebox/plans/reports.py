"""Every analysis by name: workspace -> result table."""

import datetime
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.functions.fixed_values import HORIZONS
from farebox.models import clusters, collaborative, days_to_next
from farebox.models import features as model_features
from farebox.models import folds, metrics, permutation
from farebox.models import repurchase as repurchase_operators
from farebox.models import routes as route_operators
from farebox.models.joint import joint_plan
from farebox.operators import (
    cart,
    cohort,
    cycle,
    decisions,
    distributions,
    monthly,
    overview,
    rankings,
    sequence,
    survival,
)
from farebox.operators import rfm as rfm_operators
from farebox.plans.workspace import Workspace
from farebox.sources import months
from farebox.sources.reader import write_result


def top_route_purchases(w: Workspace) -> DataFrame:
    columns = ["nk_ota_localizer_id", "fk_contact", "date_purchase", "route", "gmv_success"]
    return rankings.purchases_on_routes(w.trips, w.top_routes).select(*columns)


def contact_plan(w: Workspace) -> DataFrame:
    profiles = w.segments.select("fk_contact", "Segment", *model_features.FEATURES)
    return decisions.contact_plan(w.repurchase.score(profiles), w.contact_slot)


def scored_contact_plan(w: Workspace) -> DataFrame:
    profiles = w.segments.select("fk_contact", "Segment", *model_features.FEATURES)
    return decisions.contact_plan(metrics.with_digest_scores(profiles), w.contact_slot)


def _test_rows(w: Workspace) -> DataFrame:
    return w.repurchase_features.where(~model_features.in_training(F.col("fk_contact")))


def scored_routes(w: Workspace) -> DataFrame:
    """Three best of the top routes for every customer, by digest scores."""
    routes = sorted(row.route for row in w.top_routes.collect())  # at most ten
    names = F.array(*map(F.lit, routes))
    scores = F.array(*[metrics.digest_score(F.col("fk_contact"), route) for route in routes])
    best = metrics.top_options(scores, names, 3)
    return route_operators.ranked_options(route_operators.profiles_of(w.rfm), best)


def guessed_route_metrics(w: Workspace) -> DataFrame:
    """Accuracy and lift of a guess by digest among ten codes."""
    guess = F.floor(metrics.digest_score(F.col("fk_contact"), "route") * 10)
    guessed = w.route_features.withColumns({"prediction": guess, "label": F.col("route_encoded")})
    return metrics.class_metrics(guessed, ~model_features.in_training(F.col("fk_contact")))


def stored_gmv_by_month(w: Workspace) -> DataFrame:
    """GMV by month from the stored months, one row each, without reading a purchase."""
    kept = months.stored_result(w.spark, w.month_store, "monthly_kpis")
    names = {"purchase_year_month": "date_purchase", "gmv": "gmv_success"}
    return overview.gmv_by_month(kept.select(*names).withColumnsRenamed(names))


REPORTS: dict[str, Callable[[Workspace], DataFrame]] = {
    # Overview and seasonality
    "kpi_overview": lambda w: overview.kpi_overview(w.purchases, w.tickets),
    "gmv_by_month": lambda w: overview.gmv_by_month(w.purchases),
    "gmv_by_weekday": lambda w: overview.gmv_by_weekday(w.purchases),
    "gmv_by_hour": lambda w: overview.gmv_by_hour(w.purchases),
    "gmv_by_calendar_month": lambda w: overview.gmv_by_calendar_month(w.purchases),
    "purchases_by_weekday": lambda w: overview.purchases_by_weekday(w.purchases),
    "purchases_by_hour": lambda w: overview.purchases_by_hour(w.purchases),
    "weekday_hour_counts": lambda w: overview.weekday_hour_counts(w.purchases),
    "weekday_hour_grid": lambda w: overview.weekday_hour_grid(w.purchases),
    "best_contact_slot": lambda w: decisions.best_contact_slot(w.purchases),
    # Month by month, directly and from a store kept by month
    "monthly_kpis": lambda w: monthly.monthly_kpis(w.purchases),
    "monthly_weekday_hours": lambda w: monthly.monthly_weekday_hours(w.purchases),
    "monthly_routes": lambda w: monthly.monthly_routes(w.trips),
    "stored_monthly_kpis": lambda w: months.stored_result(w.spark, w.month_store, "monthly_kpis"),
    "stored_monthly_routes": lambda w: months.stored_result(w.spark, w.month_store, "monthly_routes"),
    "stored_gmv_by_month": stored_gmv_by_month,
    # Customer value and segments
    "rfm": lambda w: rfm_operators.rfm(w.purchases, w.as_of),
    "rfm_excluded_rows": lambda w: rfm_operators.excluded_from_rfm(w.purchases),
    "rfm_quartiles": lambda w: w.quartiles,
    "rfm_segments": lambda w: w.segments,
    "segment_report": lambda w: rfm_operators.segment_report(w.segments),
    "segment_profiles": lambda w: decisions.segment_profiles(w.segments, w.personas),
    "rfm_sample": lambda w: rfm_operators.rfm_sample(w.segments),
    "rfm_histograms": lambda w: distributions.rfm_histograms(w.rfm),
    # Purchase cycle
    "purchase_intervals": lambda w: cycle.purchase_intervals(w.purchases),
    "interval_stats": lambda w: cycle.interval_stats(w.interval_lengths),
    "interval_stats_180": lambda w: cycle.interval_stats_180(w.interval_lengths),
    "interval_histogram": lambda w: distributions.interval_histogram(w.interval_lengths),
    "interval_by_segment": lambda w: cycle.interval_by_segment(
        cycle.purchase_intervals(w.purchases), w.segments
    ),
    "next_purchase_labels": lambda w: w.labels,
    "next_purchase_one_per_customer": lambda w: cycle.next_purchase_labels(w.purchases, True),
    "conversion_by_segment": lambda w: cycle.conversion_by_segment(w.labels, w.segments),
    # Cohorts
    "cohort_counts": lambda w: w.cohorts,
    "cohort_customers": lambda w: cohort.cohort_counts(w.purchases, "customers"),
    "cohort_retention": lambda w: w.retention,
    "retention_curve": lambda w: cohort.retention_curve(w.retention),
    "cohort_grid": lambda w: cohort.cohort_grid(w.retention),
    "cohort_grid_rows": lambda w: cohort.cohort_cells(w.retention),
    # Rankings
    "route_ranking": lambda w: rankings.route_ranking(w.trips),
    "origin_ranking": lambda w: rankings.origin_ranking(w.trips),
    "destination_ranking": lambda w: rankings.destination_ranking(w.trips),
    "company_ranking": lambda w: rankings.company_ranking(w.trips),
    "customer_ranking": lambda w: rankings.customer_ranking(w.customer_totals),
    "business_highlights": lambda w: decisions.business_highlights(w.trips),
    # Cart
    "same_company_share": lambda w: cart.same_company_share(w.trips),
    "tickets_distribution": lambda w: cart.tickets_distribution(w.trips),
    "avg_ticket_price": lambda w: cart.avg_ticket_price(w.trips),
    "round_trip_comparison": lambda w: cart.round_trip_comparison(w.trips),
    "ticket_price_histogram": lambda w: distributions.ticket_price_histogram(
        cart.ticket_prices(w.trips)
    ),
    "ticket_price_density": lambda w: distributions.ticket_price_density(
        cart.ticket_prices(w.trips)
    ),
    "purchase_count_histogram": lambda w: distributions.purchase_count_histogram(w.purchases),
    # Model inputs
    "repurchase_features": lambda w: w.repurchase_features,
    "repurchase_features_point_in_time": lambda w: w.point_in_time_features,
    "train_test_split": lambda w: model_features.train_test_split(w.repurchase_features),
    "top_route_purchases": top_route_purchases,
    "route_features": lambda w: w.route_features,
    "route_baseline": lambda w: model_features.route_baseline(w.route_features),
    # Models
    "repurchase_model": lambda w: repurchase_operators.repurchase_model(w.spark, w.repurchase),
    "repurchase_metrics": lambda w: repurchase_operators.repurchase_metrics(
        w.repurchase, w.repurchase_scores
    ),
    "repurchase_importance": lambda w: repurchase_operators.repurchase_importance(
        w.spark, w.repurchase
    ),
    "repurchase_scores": lambda w: w.repurchase_scores,
    "timing_scores": lambda w: w.repurchase.score(route_operators.profiles_of(w.rfm)),
    "top_repurchase_customers": lambda w: repurchase_operators.top_repurchase_customers(
        w.repurchase_scores, w.segments
    ),
    "route_model": lambda w: route_operators.route_model(w.spark, w.routes),
    "route_metrics": lambda w: route_operators.route_metrics(w.routes, w.route_features),
    "route_importance": lambda w: route_operators.route_importance(w.spark, w.routes),
    "route_recommendations": lambda w: w.routes.recommend(route_operators.profiles_of(w.rfm)),
    # Clusters
    "customer_clusters": lambda w: w.clusters.assign(w.scaled_rfm).select(
        "fk_contact", *model_features.FEATURES, "cluster"
    ),
    "cluster_profile": lambda w: clusters.cluster_profile(w.clusters.assign(w.scaled_rfm)),
    "scored_cluster_profile": lambda w: clusters.cluster_profile(
        w.scaled_rfm.withColumn(
            "cluster", F.floor(metrics.digest_score(F.col("fk_contact"), "cluster") * 4).cast("int")
        )
    ),
    # Sequences of routes, and waits with those not yet over
    "route_transitions": lambda w: sequence.route_transitions(w.route_chain),
    "next_route_markov": lambda w: w.next_route,
    "next_route_markov_metrics": lambda w: sequence.markov_metrics(
        w.route_chain, model_features.in_training(F.col("fk_contact"))
    ),
    # Routes by collaborative filtering
    "held_out_routes": lambda w: w.held_out_routes,
    "route_history": lambda w: w.route_history,
    "collaborative_routes": lambda w: w.route_factors.recommend(w.route_history),
    "collaborative_metrics": lambda w: collaborative.collaborative_metrics(
        w.held_out_routes, w.route_factors, collaborative.popular_routes(w.route_history)
    ),
    "popular_route_metrics": lambda w: collaborative.ranking_metrics(
        w.held_out_routes, collaborative.popular_routes(w.route_history)
    ),
    "scored_route_ranking_metrics": lambda w: collaborative.ranking_metrics(
        w.held_out_routes, scored_routes(w)
    ),
    "waits_by_segment": lambda w: w.waits.withColumn("survival", F.round("survival", 6)),
    "days_to_next_scores": lambda w: w.days_model.score(w.point_in_time_features),
    "days_to_next_metrics": lambda w: days_to_next.days_metrics(
        w.days_model.score(w.point_in_time_features)
    ),
    "scored_days_metrics": lambda w: days_to_next.days_metrics(
        w.repurchase_features.withColumn(
            "predicted_days", metrics.digest_score(F.col("fk_contact"), "days") * 100
        )
    ),
    "joint_plan": lambda w: joint_plan(
        w.rfm, w.repurchase.score(route_operators.profiles_of(w.rfm)), w.next_route
    ),
    "days_to_next_baseline": lambda w: survival.days_to_next_baseline(w.waits),
    # Cross-validation
    "fold_sizes": lambda w: folds.fold_sizes(w.repurchase_features),
    "cross_validated_metrics": lambda w: folds.fold_metrics(w.cross_validated_scores),
    "cross_validation_summary": lambda w: folds.fold_summary(
        folds.fold_metrics(w.cross_validated_scores)
    ),
    "scored_fold_metrics": lambda w: folds.fold_metrics(
        metrics.with_digest_scores(w.repurchase_features)
    ),
    "scored_fold_summary": lambda w: folds.fold_summary(
        folds.fold_metrics(metrics.with_digest_scores(w.repurchase_features))
    ),
    # Importance of each feature by mixing it among the test rows
    "permutation_importance": lambda w: permutation.permutation_importance(
        _test_rows(w), w.repurchase.score
    ),
    "scored_permutation_importance": lambda w: permutation.permutation_importance(
        _test_rows(w), metrics.with_linear_scores
    ),
    # Decisions
    "contact_plan": contact_plan,
    # The same rules and metrics on scores from digests, which need no model
    "scored_metrics": lambda w: metrics.binary_metrics(
        metrics.with_digest_scores(w.repurchase_features).where(
            ~model_features.in_training(F.col("fk_contact"))
        ),
        HORIZONS,
    ),
    "scored_top_customers": lambda w: repurchase_operators.top_repurchase_customers(
        metrics.with_digest_scores(w.repurchase_features), w.segments
    ),
    "scored_contact_plan": scored_contact_plan,
    "scored_routes": scored_routes,
    "guessed_route_metrics": guessed_route_metrics,
}


# Columns that analyses need besides id, customer, date and value.
TIMED = ["gmv_by_hour", "purchases_by_hour", "weekday_hour_counts", "weekday_hour_grid",
         "best_contact_slot", "business_highlights", "contact_plan", "scored_contact_plan", "monthly_weekday_hours"]
TICKETED = ["kpi_overview", "tickets_distribution", "avg_ticket_price",
            "ticket_price_histogram", "ticket_price_density"]
ROUTED = ["route_ranking", "top_route_purchases", "route_features", "route_baseline", "route_model",
          "route_metrics", "route_importance", "route_recommendations", "scored_routes", "guessed_route_metrics",
          "route_transitions", "next_route_markov", "next_route_markov_metrics", "joint_plan",
          "held_out_routes", "route_history", "collaborative_routes", "collaborative_metrics",
          "popular_route_metrics", "scored_route_ranking_metrics", "monthly_routes", "stored_monthly_routes"]
_NEEDS: list[tuple[list[str], str]] = [
    (TIMED, "time_purchase_hour"),
    (TICKETED, "total_tickets_quantity_success"),
    (ROUTED, "route"),
    (["origin_ranking", "business_highlights"], "place_origin_departure"),
    (["destination_ranking", "business_highlights"], "place_destination_departure"),
    (["company_ranking", "same_company_share"], "fk_departure_ota_bus_company"),
    (["same_company_share"], "fk_return_ota_bus_company"),
    (["round_trip_comparison"], "has_return"),
]
NEEDS: dict[str, list[str]] = {
    name: [column for names, column in _NEEDS if name in names] for name in REPORTS
}


def available(w: Workspace) -> list[str]:
    """Names of the analyses the workspace's columns allow."""
    return [name for name in REPORTS if set(NEEDS[name]) <= w.columns]


def write_reports(w: Workspace, folder: str, names: Iterable[str] | None = None) -> list[str]:
    """Write the named (or all) analyses as Parquet, one folder each.

    Returns the names that were left out because the purchases lack a column for them.
    Lines of a CSV that were no rows are written to ``rejected_lines`` beside the analyses.
    """
    if w.rejected is not None:
        write_result(w.rejected, f"{folder}/rejected_lines")
    wanted, possible = list(REPORTS if names is None else names), set(available(w))
    for name in wanted:
        if name in possible:
            write_result(REPORTS[name](w), f"{folder}/{name}")
    return [name for name in wanted if name not in possible]


def update_months(w: Workspace, folder: str, batch: str) -> list[datetime.date]:
    """Put the workspace's purchases into the month store in ``folder`` and work out the
    monthly results of the months they have; returns those months."""
    touched = months.put_purchases(w.trips, folder, batch)
    months.refresh_results(w.spark, folder, touched)
    return touched
