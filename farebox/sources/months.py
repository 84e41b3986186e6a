"""Purchases kept by month, and monthly results that follow only the months that change.

In the folder of a store::

    purchases/purchase_year_month=2024-05-01/   purchases of the month, typed and derived
    undated/batch=<name>/                       rows without a date, by the batch they came in
    monthly_kpis/purchase_year_month=.../       a result, by month; the others beside it

A batch replaces every month it has rows of, and its own undated rows, so writing a batch
again changes nothing. Months it has no rows of stay as they are.
"""

import datetime
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.operators import monthly
from farebox.operators.monthly import MONTH
from farebox.sources.reader import write_result
from farebox.staging import stage

ID = "nk_ota_localizer_id"
# Result by name, with the column it needs besides the required ones.
RESULTS = {
    "monthly_kpis": (monthly.monthly_kpis, None),
    "monthly_weekday_hours": (monthly.monthly_weekday_hours, "time_purchase_hour"),
    "monthly_routes": (monthly.monthly_routes, "route"),
}


def write_months(rows: DataFrame, path: str, *order: str) -> None:
    """Replace the months that ``rows`` have in a table kept by month; the others stay.

    Rows are ranged by month and ``order``: a task writes few months, and a month with a
    third of all rows is written by many tasks.
    """
    laid_out = rows.repartitionByRange(MONTH, *order).sortWithinPartitions(MONTH, *order)
    laid_out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)


def put_purchases(purchases: DataFrame, folder: str, batch: str) -> list[datetime.date]:
    """Store a batch of clean purchases; returns the months it has replaced, in order.

    Pass whole months: what a month had before goes. Repeated rows stay repeated. An empty
    batch replaces no month. A batch is read once here, into a staged copy.
    """
    rows = stage(purchases, "month-batch")
    # written first, also without rows: its files carry the columns of the batch
    write_result(rows.where(F.col(MONTH).isNull()).drop(MONTH), f"{folder}/undated/batch={quote(batch, safe='')}")
    dated = rows.where(F.col(MONTH).isNotNull())
    months = [row[0] for row in dated.select(MONTH).distinct().orderBy(MONTH).collect()]  # calendar months
    if months:
        write_months(dated, f"{folder}/purchases", ID)
    return months


def undated_purchases(spark: SparkSession, folder: str) -> DataFrame:
    """Stored rows without a date, of all batches."""
    rows = spark.read.option("mergeSchema", True).parquet(f"{folder}/undated")
    return rows.drop("batch").withColumn(MONTH, F.lit(None).cast("date"))


def stored_purchases(spark: SparkSession, folder: str, months: list[datetime.date] | None = None) -> DataFrame:
    """Stored purchases that have a date, of the given months (default: all).

    Only the folders of those months are read. A column that only some batches have is null
    in the others.
    """
    schema = undated_purchases(spark, folder).schema
    if not _exists(spark, f"{folder}/purchases"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(f"{folder}/purchases")
    return rows if months is None else rows.where(F.col(MONTH).isin(months))


def refresh_results(spark: SparkSession, folder: str, months: list[datetime.date]) -> list[str]:
    """Work out the monthly results of the given months anew, from their purchases alone.

    Returns the names of the results written; those whose column is missing are left out.
    """
    rows = stored_purchases(spark, folder, months)
    names = [name for name, (_, needs) in RESULTS.items() if needs is None or needs in rows.columns]
    for name in names if months else []:
        result = RESULTS[name][0](rows)
        write_months(result, f"{folder}/{name}", *[c for c in result.columns if c != MONTH])
    return names


def stored_result(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A monthly result over all months; without rows if no month has been worked out."""
    schema = RESULTS[name][0](stored_purchases(spark, folder)).schema
    if not _exists(spark, f"{folder}/{name}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/{name}")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
