"""Purchases derived from an orders / lineitem star schema, or from an event log."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.functions.fixed_values import NO_RETURN_COMPANY, NO_RETURN_PLACE, PURCHASE_COLUMNS


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def modified(spark: SparkSession, folder: str, names: list[str]) -> list[int]:
    """When each table was last written, in milliseconds; 0 for an absent one."""
    jvm, settings = spark._jvm, spark._jsc.hadoopConfiguration()
    times = []
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        system = path.getFileSystem(settings)
        known = system.exists(path)
        times.append(system.getFileStatus(path).getModificationTime() if known else 0)
    return times


def order_tickets(spark: SparkSession, folder: str) -> DataFrame:
    """Tickets of each order that has lines: their number. No places, no staging."""
    lines = _table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("int").alias("total_tickets_quantity_success")
    )
    orders = _table(spark, folder, "orders").select("o_orderkey")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(lines.columns[-1])


def _order_columns() -> list[Column]:
    return [
        F.col("o_orderkey").cast("string").alias("nk_ota_localizer_id"),
        F.col("o_custkey").cast("string").alias("fk_contact"),
        F.col("o_orderdate").cast("date").alias("date_purchase"),
        _clock(F.col("o_orderkey") * 7919 % 86400).alias("time_purchase"),
        F.col("o_totalprice").alias("gmv_success"),
    ]


def order_purchases(spark: SparkSession, folder: str) -> DataFrame:
    """One purchase per order with the columns that need no join: id, customer, date,
    time and value."""
    return _table(spark, folder, "orders").select(*_order_columns())


def raw_purchases(spark: SparkSession, folder: str) -> DataFrame:
    """One purchase per order, all columns, typed.

    The first and last line of each order are found by aggregates on the line order
    (not by a window), so lines are combined before the shuffle and a very large
    order costs no more than a small one. Names are attached to customers and suppliers
    before these meet the orders; those joins have a plain shuffle on either side, which
    AQE splits when one customer or supplier holds much of the orders.
    """
    # Each line is one fixed-width tie-break order; what is not read later is not carried.
    line = F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_returnflag")
    first = F.struct("l_linenumber", "l_suppkey")
    legs = (
        _table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("tickets"),
            F.min(first).alias("first_line"),
            F.max(line).alias("last_line"),
        )
    )
    nation = _table(spark, folder, "nation")
    customers = (
        _table(spark, folder, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select("c_custkey", F.col("n_name").alias("origin"))
    )
    suppliers = (
        _table(spark, folder, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .select("s_suppkey", F.col("n_name").alias("destination"))
    )

    flat = (
        _table(spark, folder, "orders")
        .join(legs, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .withColumn("supplier", F.col("first_line.l_suppkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(suppliers, F.col("supplier") == F.col("s_suppkey"), "left")
    )
    returns = F.coalesce(F.col("last_line.l_returnflag"), F.lit("N")) == "R"
    return flat.select(
        *_order_columns(),
        F.col("origin").alias("place_origin_departure"),
        F.col("destination").alias("place_destination_departure"),
        F.when(returns, F.col("destination"))
        .otherwise(NO_RETURN_PLACE)
        .alias("place_origin_return"),
        F.when(returns, F.col("origin"))
        .otherwise(NO_RETURN_PLACE)
        .alias("place_destination_return"),
        F.col("supplier").cast("string").alias("fk_departure_ota_bus_company"),
        F.when(returns, F.col("last_line.l_suppkey").cast("string"))
        .otherwise(NO_RETURN_COMPANY)
        .alias("fk_return_ota_bus_company"),
        F.coalesce(F.col("tickets"), F.lit(0)).cast("int").alias("total_tickets_quantity_success"),
    ).select(*PURCHASE_COLUMNS)


def raw_event_purchases(spark: SparkSession, folder: str) -> DataFrame:
    """One purchase per ``purchase`` event: real clock times, one ticket, no route."""
    nothing = F.lit(None).cast("string")
    return (
        _table(spark, folder, "events")
        .where(F.col("event_type") == "purchase")
        .select(
            F.col("event_id").cast("string").alias("nk_ota_localizer_id"),
            F.col("user_id").cast("string").alias("fk_contact"),
            F.col("ts").cast("date").alias("date_purchase"),
            F.date_format("ts", "HH:mm:ss").alias("time_purchase"),
            nothing.alias("place_origin_departure"),
            nothing.alias("place_destination_departure"),
            F.lit(NO_RETURN_PLACE).alias("place_origin_return"),
            F.lit(NO_RETURN_PLACE).alias("place_destination_return"),
            nothing.alias("fk_departure_ota_bus_company"),
            F.lit(NO_RETURN_COMPANY).alias("fk_return_ota_bus_company"),
            F.col("value").alias("gmv_success"),
            F.lit(1).alias("total_tickets_quantity_success"),
        )
    )


def as_text(purchases: DataFrame) -> DataFrame:
    """The same rows with every column as text, as a CSV file would deliver them."""
    return purchases.select(*[F.col(name).cast("string") for name in PURCHASE_COLUMNS])


def _clock(second: Column) -> Column:
    two = lambda part: F.lpad(part.cast("string"), 2, "0")
    return F.concat(
        two(F.floor(second / 3600).cast("int")),
        F.lit(":"),
        two(F.floor(second % 3600 / 60).cast("int")),
        F.lit(":"),
        two((second % 60).cast("int")),
    )
