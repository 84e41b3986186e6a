"""Files in, tables out."""

import datetime

import pytest
from conftest import SF, SF_SMALL

from farebox.functions.cleaning import parse_number
from farebox.functions.fixed_values import PURCHASE_COLUMNS, TICKETS_COLUMN_NAMES
from farebox.operators import overview
from farebox.operators.decisions import segment_profiles
from farebox.operators.rfm import segment_report
from farebox.plans.queries import QUERIES
from farebox.plans.workspace import Workspace
from farebox.sources.reader import (
    conform,
    find_column,
    read_personas,
    read_purchases,
    read_raw,
    write_result,
)

AS_OF = datetime.date(2024, 5, 1)


@pytest.fixture(scope="module")
def csv(edge_raw, tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "purchases.csv"
    edge_raw.toPandas().to_csv(path, index=False)
    return str(path)


def test_csv_equals_the_typed_rows(spark, csv, edge):
    read = read_purchases(spark, csv)
    assert sorted(map(str, read.collect())) == sorted(map(str, edge.collect()))


def test_csv_scan_is_all_text(spark, csv):
    assert {kind for _, kind in read_raw(spark, csv).dtypes} == {"string"}


def test_workspace_on_csv_and_parquet(spark, csv, edge_raw, tmp_path):
    path = str(tmp_path / "purchases.parquet")
    write_result(edge_raw, path)
    reports = [
        sorted(map(tuple, segment_report(Workspace.read(spark, p, AS_OF).segments).collect()))
        for p in (csv, path)
    ]
    assert reports[0] == reports[1] and len(reports[0]) == 4


@pytest.mark.parametrize("path", ["sales.xlsx", "sales.txt", "sales.json"])
def test_other_formats_are_refused(spark, path):
    with pytest.raises(ValueError, match="unsupported format"):
        read_raw(spark, path)


def test_missing_columns_are_named(edge_raw):
    with pytest.raises(ValueError, match="fk_contact, gmv_success"):
        conform(edge_raw.drop("fk_contact", "gmv_success"))


def test_return_columns_are_optional(edge_raw):
    slim = edge_raw.drop("place_origin_return", "place_destination_return")
    assert "fk_contact" in conform(slim).columns


@pytest.mark.parametrize(
    "columns, found",
    [
        (["id", "total_tickets_quantity_sucess"], "total_tickets_quantity_sucess"),
        (["id", "Total Tickets Quantity Success"], "Total Tickets Quantity Success"),
        (["id", "n_tickets_sold"], None),
        (["id", "total", "quantity", "a"], None),
        (["id", "TICKETS"], "TICKETS"),
        (["id", "QTD PASSAGENS"], "QTD PASSAGENS"),
        (["date", "value"], None),
    ],
)
def test_tickets_column_is_found(columns, found):
    assert find_column(columns, TICKETS_COLUMN_NAMES) == found


def test_misspelt_columns_are_renamed(edge_raw):
    odd = edge_raw.withColumnRenamed(
        "total_tickets_quantity_success", "total_tickets_quantity_sucess"
    ).withColumnRenamed("fk_contact", "FK Contact")
    assert sorted(conform(odd).columns) == sorted(PURCHASE_COLUMNS)


def test_missing_texts_in_csv(spark, tmp_path):
    path = tmp_path / "few.csv"
    path.write_text("id,who,note\n1,NULL,a\n2,NA,\n3,N,none\n")
    rows = [tuple(r) for r in read_raw(spark, str(path)).orderBy("id").collect()]
    assert rows == [("1", None, "a"), ("2", None, None), ("3", "N", "none")]


def test_numeric_keys_become_text(spark, edge_raw):
    from pyspark.sql import functions as F

    from farebox.functions.cleaning import clean_purchases

    numeric = edge_raw.withColumns(
        {"fk_contact": F.lit(7), "place_origin_return": F.lit(0), "gmv_success": F.lit(2)}
    )
    row = clean_purchases(numeric).first()
    assert (row.fk_contact, row.has_return, row.gmv_success) == ("7", False, 2.0)


def test_numbers(spark):
    texts = ["1", " 2.5 ", "-3e2", "12d", "NaN", "Infinity", "", "1,5", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    column = parse_number(frame["t"], frame.schema["t"].dataType)
    values = [row[0] for row in frame.select(column).collect()]
    assert values == [1.0, 2.5, -300.0, None, None, None, None, None, None]


def test_nan_in_typed_input_is_null(spark, edge_raw):
    from pyspark.sql import functions as F

    from farebox.functions.cleaning import clean_purchases

    typed = edge_raw.withColumn("gmv_success", F.lit(float("nan")))
    assert clean_purchases(typed).where("gmv_success is not null").count() == 0


def test_personas(spark, tmp_path):
    path = tmp_path / "personas.txt"
    path.write_text("Leais: fiéis: sempre\n\nNovos : chegaram agora\nsem texto\nNovos: de novo\n")
    found = {r.Segment: r.persona for r in read_personas(spark, str(path)).collect()}
    assert found == {"Leais": "fiéis: sempre", "Novos": "de novo", "sem texto": ""}
    segments = QUERIES["rfm_segments"](spark, SF_SMALL)
    profiles = segment_profiles(segments, read_personas(spark, str(path))).collect()
    assert {r.Segment: r.persona for r in profiles}["Leais"] == "fiéis: sempre"
    assert len(profiles) == 9
    assert {r.Segment: r.description for r in profiles}["Outros"] is None


def test_results_are_written(spark, edge, tmp_path):
    path = str(tmp_path / "gmv_by_month")
    write_result(overview.gmv_by_month(edge), path)
    assert spark.read.parquet(path).count() == 4


@pytest.mark.parametrize(
    "query, scanned",
    [
        ("rfm", {"o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"}),
        ("weekday_hour_counts", {"o_orderkey", "o_orderdate"}),
        ("gmv_by_weekday", {"o_orderdate", "o_totalprice"}),
        ("purchase_intervals", {"o_custkey", "o_orderdate"}),
    ],
)
def test_scans_read_only_what_the_query_needs(spark, query, scanned):
    plan = QUERIES[query](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scans = [part.split(">")[0] for part in plan.split("ReadSchema: struct<")[1:]]
    columns = [{c.split(":")[0] for c in scan.split(",")} for scan in scans]
    assert len(columns) == 1 and columns[0] <= scanned


def test_extreme_values_are_counted_not_fatal(spark, edge_raw):
    from pyspark.sql import functions as F

    from farebox.functions.cleaning import clean_purchases

    odd = {"T01": "0.004", "T02": "0.004", "T03": "0.004", "T04": "1e25", "T05": "1e400", "T06": "1e17"}
    value = F.coalesce(*[F.when(F.col("nk_ota_localizer_id") == k, v) for k, v in odd.items()], F.lit("0"))
    raw = edge_raw.withColumn("gmv_success", value)
    clean = clean_purchases(raw)
    kpi = overview.kpi_overview(clean).first()
    assert kpi.total_gmv == pytest.approx(1e17)
    small = clean.where("nk_ota_localizer_id in ('T01', 'T02', 'T03')")
    assert overview.kpi_overview(small).first().total_gmv == 0.012
    profile = {r.metric: r.value for r in overview.ingest_profile(raw).collect()}
    assert profile["rejected:gmv_success"] == "2" and profile["nulls:gmv_success"] == "2"
    typed = edge_raw.withColumn("gmv_success", F.lit(float("inf")))
    assert clean_purchases(typed).where("gmv_success is not null").count() == 0


def test_last_route_is_by_clock_time(spark, edge_raw):
    from pyspark.sql import functions as F

    from farebox.functions.cleaning import clean_purchases
    from farebox.models.features import route_features

    row = edge_raw.where("nk_ota_localizer_id = 'T01'").drop(
        "nk_ota_localizer_id", "time_purchase", "place_origin_departure", "place_destination_departure"
    )
    trips = [("1", "18:00:00", "RJ", "SP"), ("2", "9:05:00", "SP", "RJ"), ("3", None, "SP", "BH")]
    names = "nk_ota_localizer_id string, time_purchase string, place_origin_departure string, place_destination_departure string"
    raw = row.crossJoin(spark.createDataFrame(trips, names))
    clean = clean_purchases(raw)
    routes = clean.select("route").distinct()
    assert route_features(clean, routes).first().route == "RJ -> SP"
    timed = raw.withColumn("time_purchase", F.to_timestamp(F.concat(F.lit("2024-01-05 "), "time_purchase")))
    hours = {r.nk_ota_localizer_id: r.time_purchase_hour for r in clean_purchases(timed).collect()}
    assert hours == {"1": 18, "2": 9, "3": None}
    assert route_features(clean_purchases(timed), routes).first().route == "RJ -> SP"


def test_suffixless_folder_is_parquet(spark, edge_raw, tmp_path):
    edge_raw.write.parquet(str(tmp_path / "purchases"))
    assert read_raw(spark, str(tmp_path / "purchases")).count() == 12
