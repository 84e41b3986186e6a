"""Expected results on the twelve-row table of awkward purchases."""

import datetime

import pytest

from farebox.operators import cart, cohort, cycle, decisions, overview, rankings
from farebox.operators import rfm as R
from farebox.staging import stage

AS_OF = datetime.date(2024, 5, 1)


def rows(frame, key, *columns):
    out = {}
    for row in frame.collect():
        values = tuple(row[c] for c in columns)
        out[row[key]] = values[0] if len(values) == 1 else values
    return out


@pytest.fixture(scope="module")
def segments(edge):
    table = stage(R.rfm(edge, AS_OF), "edge-rfm")
    return R.rfm_segments(R.rfm_quartiles(table)).cache()


@pytest.fixture(scope="module")
def intervals(edge):
    return cycle.purchase_intervals(edge)


def test_cleaning(edge):
    hour = rows(edge, "nk_ota_localizer_id", "time_purchase_hour")
    assert hour["T06"] is None and hour["T12"] is None and hour["T08"] == 9
    price = rows(edge, "nk_ota_localizer_id", "avg_ticket_price")
    assert price["T03"] == 110 and price["T04"] == 0 and price["T05"] == 75
    assert price["T07"] is None and price["T08"] == 30 and price["T12"] == 0
    back = rows(edge, "nk_ota_localizer_id", "has_return")
    assert {name for name, flag in back.items() if flag} == {"T03", "T05", "T08"}
    assert set(back.values()) == {True, False}
    names = rows(edge, "nk_ota_localizer_id", "purchase_day_of_week", "purchase_month")
    assert names["T01"] == ("Friday", "January") and names["T11"] == (None, None)


def test_profile(edge_raw, edge):
    profile = rows(overview.ingest_profile(edge_raw), "metric", "value")
    assert profile["rows"] == "12" and profile["columns"] == "12"
    assert profile["invalid_dates"] == "1" and profile["invalid_hours"] == "2"
    assert profile["nulls:gmv_success"] == "1" and profile["nulls:fk_contact"] == "1"
    assert profile["first_date"] == "2024-01-05" and profile["last_date"] == "2024-04-01"
    assert profile["outbound_companies"] == "3"


def test_kpis(edge):
    kpi = overview.kpi_overview(edge).first()
    assert tuple(kpi) == (1090.5, 15, 12, 5, 90.875, 1.25, 72.7, 218.1)


def test_rfm_leaves_out_missing_customer_and_date(edge):
    assert rows(R.rfm(edge, AS_OF), "fk_contact", "recency", "frequency", "monetary") == {
        "A": (30, 4, 450.0), "B": (42, 3, 395.5), "C": (88, 1, 0.0), "D": (55, 2, 100.0),
    }
    assert tuple(R.excluded_from_rfm(edge).first()) == (1, 1)


def test_segments(segments):
    found = rows(segments, "fk_contact", "R_quartile", "F_quartile", "M_quartile", "Segment")
    assert found == {
        "A": (4, 4, 4, "Campeões"), "B": (3, 3, 3, "Leais"),
        "D": (2, 2, 2, "Hibernando"), "C": (1, 1, 1, "Perdidos"),
    }


def test_profiles_keep_segments_without_customers(segments):
    profiles = rows(decisions.segment_profiles(segments), "Segment", "customers", "total_value")
    assert len(profiles) == 8 and profiles["Novos"] == (0, 0.0)
    assert profiles["Campeões"] == (1, 450.0)


def test_intervals(intervals):
    found = sorted(
        (r.fk_contact, r.days_since_prev_purchase, r.purchases) for r in intervals.collect()
    )
    assert found == [
        ("A", 0, 1), ("A", 36, 1), ("A", 51, 1), ("B", 5, 1), ("B", 55, 1), ("D", 7, 1),
    ]
    stats = cycle.interval_stats(cycle.interval_lengths(intervals)).first()
    assert (stats.mean_days, stats.median_days, stats.min_days, stats.max_days) == (30.8, 36, 5, 55)
    assert stats.std_days == pytest.approx(23.7318, abs=1e-4) and stats.p99_days == 54.84


def test_intervals_by_segment(intervals, segments):
    found = rows(cycle.interval_by_segment(intervals, segments), "Segment", "mean_days", "intervals")
    assert found == {"Hibernando": (7, 1), "Leais": (30, 2), "Campeões": (43.5, 2)}


def test_labels(edge):
    labels = rows(
        cycle.next_purchase_labels(edge), "fk_contact", "date_purchase", "days_until_next_purchase",
        "will_buy_next_7_days", "will_buy_next_15_days", "will_buy_next_30_days",
    )
    day = datetime.date
    assert labels == {
        "A": (day(2024, 2, 10), 51, 0, 0, 0), "B": (day(2024, 1, 25), 55, 0, 0, 0),
        "D": (day(2024, 2, 29), 7, 1, 1, 1),
    }


def test_cohorts(edge):
    january, february = datetime.date(2024, 1, 1), datetime.date(2024, 2, 1)
    counts = cohort.cohort_counts(edge)
    cells = {(r.primeira_compra, r.periods): r.purchases for r in counts.collect()}
    assert cells == {
        (january, 0): 4, (january, 1): 1, (january, 2): 1, (january, 3): 1,
        (february, 0): 2, (february, 1): 1,
    }
    curve = rows(cohort.retention_curve(cohort.cohort_retention(counts)), "periods", "mean_retention")
    assert curve == {0: 100, 1: 37.5, 2: 25, 3: 25}
    people = cohort.cohort_retention(cohort.cohort_counts(edge, "customers"))
    assert {(r.primeira_compra, r.periods): r.retention for r in people.collect()} == {
        (january, 0): 100, (january, 1): 50, (january, 2): 50, (january, 3): 50,
        (february, 0): 100, (february, 1): 50,
    }
    grid = cohort.cohort_grid(cohort.cohort_retention(counts), 3)
    back = {(r.primeira_compra, r.periods): r.retention for r in cohort.grid_to_rows(grid).collect()}
    assert back[(january, 3)] == 25 and back[(february, 2)] is None and len(back) == 8


def test_purchase_ids_seen_twice_count_once_in_a_cohort_cell(edge):
    doubled = edge.unionAll(edge)
    assert sorted(map(tuple, cohort.cohort_counts(doubled).collect())) == sorted(
        map(tuple, cohort.cohort_counts(edge).collect())
    )


def test_seasonality(edge):
    months = rows(overview.gmv_by_month(edge), "year_month", "gmv", "moving_avg")
    assert months == {
        "2024-01": (525.5, None), "2024-02": (280, None), "2024-03": (150, 318.5),
        "2024-04": (80, 170),
    }
    gmv = rows(overview.gmv_by_weekday(edge), "day_en", "gmv")
    assert gmv == {
        "Monday": 80, "Tuesday": None, "Wednesday": 20, "Thursday": 175.5, "Friday": 240,
        "Saturday": 520, "Sunday": None,
    }
    assert rows(overview.purchases_by_weekday(edge), "day_pt", "purchases") == {
        "Segunda": 1, "Terça": None, "Quarta": 1, "Quinta": 3, "Sexta": 3, "Sábado": 3,
        "Domingo": None,
    }
    hours = {7: 1, 9: 4, 10: 1, 13: 2, 18: 1, 21: 1}
    assert rows(overview.purchases_by_hour(edge), "hour", "purchases") == hours


def test_moving_average_needs_three_months(edge):
    two = edge.where("date_purchase < '2024-03-01'")
    assert all(r.moving_avg is None for r in overview.gmv_by_month(two).collect())


def test_routes_and_cart(edge):
    assert rows(rankings.route_ranking(edge), "route", "purchases") == {
        "SP -> RJ": 7, "BH -> SP": 2, "RJ -> SP": 1, "SP -> BH": 1,
    }
    trips = rows(cart.round_trip_comparison(edge), "kind", "mean_gmv", "pct_purchases",
                 "pct_round_trip_above")
    assert trips["Ida e Volta"][:2] == (pytest.approx(193.3333, abs=1e-4), 25)
    assert trips["Somente Ida"] == (63.8125, 75, pytest.approx(202.97, abs=1e-2))
    share = cart.same_company_share(edge).first()
    assert (share.purchases, share.round_trips) == (11, 3)
    assert share.pct_same_company == pytest.approx(18.1818, abs=1e-4)
    assert share.pct_same_company_round_trips == pytest.approx(66.6667, abs=1e-4)
    assert rows(cart.tickets_distribution(edge), "tickets", "purchases") == {0: 1, 1: 7, 2: 2, 4: 1}
    assert cart.avg_ticket_price(edge).first().avg_ticket_price == 69.5


def test_slot_and_highlights(edge):
    slot = decisions.best_contact_slot(edge).first()
    assert (slot.best_day, slot.best_hour) == ("Quinta", 9)
    assert (slot.slot_day, slot.slot_hour, slot.slot_purchases) == ("Sábado", 9, 2)
    top = decisions.business_highlights(edge).collect()
    assert ("route", 1, "SP → RJ") in {(r.highlight, r.position, r.value) for r in top}


def test_slot_falls_back_without_purchases(edge):
    slot = decisions.best_contact_slot(edge.where("false")).first()
    assert (slot.best_day, slot.best_hour, slot.slot_day) == ("Segunda", 12, None)
