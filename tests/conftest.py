import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from farebox.functions.cleaning import clean_purchases  # noqa: E402
from farebox.functions.fixed_values import PURCHASE_COLUMNS  # noqa: E402

SF = "/root/testdata/sf0.01"
SF_SMALL = "/root/testdata/sf0.001"

# id, contact, date, time, origin, destination, return origin, return destination,
# company, return company, gmv, tickets
EDGE_ROWS = [
    ("T01", "A", "2024-01-05", "09:10:00", "SP", "RJ", "0", "0", "10", "1", "100.00", "1"),
    ("T02", "A", "2024-01-05", "18:00:00", "RJ", "SP", "0", "0", "10", "1", "50.00", "1"),
    ("T03", "A", "2024-02-10", "09:30:00", "SP", "RJ", "RJ", "SP", "10", "10", "220.00", "2"),
    ("T04", "A", "2024-04-01", "21:15:00", "SP", "BH", "0", "0", "11", "1", "80.00", "0"),
    ("T05", "B", "2024-01-20", "09:05:59", "SP", "RJ", "RJ", "SP", "12", "13", "300.00", "4"),
    ("T06", "B", "2024-01-25", "25:00:00", "SP", "RJ", "0", "0", "12", "1", "75.50", "1"),
    ("T07", "C", "2024-02-03", "07:45:00", "BH", "SP", "0", "0", "11", "1", "oops", "1"),
    ("T08", "D", "2024-02-29", "9:05:00", "BH", "SP", "SP", "BH", "11", "11", "60.00", "2"),
    ("T09", "D", "2024-03-07", "13:00:00", None, "SP", "0", "0", "11", "1", "40.00", "1"),
    ("T10", None, "2024-03-08", "13:10:00", "SP", "RJ", "0", "0", "10", "1", "90.00", "1"),
    ("T11", "E", "2024-02-30", "10:00:00", "SP", "RJ", "0", "0", "10", "1", "55.00", "1"),
    ("T12", "B", "2024-03-20", None, "SP", "RJ", None, None, "12", None, "20.00", None),
]


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def edge_raw(spark):
    schema = ", ".join(f"{name} string" for name in PURCHASE_COLUMNS)
    return spark.createDataFrame(EDGE_ROWS, schema)


@pytest.fixture(scope="session")
def edge(edge_raw):
    return clean_purchases(edge_raw).cache()
