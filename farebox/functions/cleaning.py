"""Coercing parsers and the columns derived when purchases are loaded.

Bad values become null, never NaN: Spark orders NaN above every number, so a NaN
would pass ``> 0``.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farebox.functions.calendar import name_of, weekday_number
from farebox.functions.measures import MONEY_LIMIT
from farebox.functions.fixed_values import (
    MONTHS_EN,
    NO_RETURN_PLACE,
    ROUTE_SEPARATOR,
    TEXT_COLUMNS,
    WEEKDAYS_EN,
)

ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
CLOCK_TIME = r"^([01]?\d|2[0-3]):[0-5]?\d:[0-5]?\d$"
PLAIN_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def parse_date(value: Column, dtype: T.DataType) -> Column:
    """ISO ``yyyy-MM-dd`` text to date. Spark's cast alone also takes ``2024-1-5``."""
    if isinstance(dtype, T.StringType):
        return F.when(value.rlike(ISO_DATE), value.try_cast("date"))
    return value.cast("date")


def parse_second(value: Column, dtype: T.DataType) -> Column:
    """Second of the day of ``H:M:S`` text or of a timestamp; null when it is no clock time."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.hour(value) * 3600 + F.minute(value) * 60 + F.second(value)
    text = value.cast("string")
    hour, minute, second = (F.split_part(text, F.lit(":"), F.lit(i)).try_cast("int") for i in (1, 2, 3))
    return F.when(text.rlike(CLOCK_TIME), hour * 3600 + minute * 60 + second)


def parse_hour(value: Column, dtype: T.DataType) -> Column:
    """Hour of the same clock times, from the first part alone."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.hour(value)
    text = value.cast("string")
    return F.when(text.rlike(CLOCK_TIME), F.substring_index(text, ":", 1).try_cast("int"))


def parse_number(value: Column, dtype: T.DataType) -> Column:
    """Number or null. The pattern keeps out ``12d`` and ``NaN``; infinite values and values
    of ``MONEY_LIMIT`` or more, which no sum could hold, are null as well."""
    number = value.try_cast("double")
    if isinstance(dtype, T.StringType):
        number = F.when(value.rlike(PLAIN_NUMBER), number)
    return F.when(~F.isnan(number) & (F.abs(number) < MONEY_LIMIT), number)


def whole_number(value: Column) -> Column:
    """Whole part of a parsed number as int, null when it does not fit."""
    return value.try_cast("int")


def route(origin: Column, destination: Column) -> Column:
    """``origin -> destination``, null when either end is null."""
    return F.concat(origin, F.lit(ROUTE_SEPARATOR), destination)


def clean_purchases(raw: DataFrame) -> DataFrame:
    """Type the purchases columns and add the derived ones.

    Works on all-text input (CSV) and on typed input (Parquet) alike. A pure
    projection: a query that needs two of the columns still scans only those. Columns
    derived from absent ones are left out.
    """
    types = {field.name: field.dataType for field in raw.schema.fields}
    day = F.col("date_purchase")
    gmv = F.col("gmv_success")
    tickets_name = "total_tickets_quantity_success"
    tickets = F.col(tickets_name)

    typed = {
        # Keys and markers are text whatever type a file gives them.
        name: F.col(name).cast("string")
        for name in TEXT_COLUMNS
        if name in types and not isinstance(types[name], T.StringType)
    }
    typed |= {
        "date_purchase": parse_date(day, types["date_purchase"]),
        "gmv_success": parse_number(gmv, types["gmv_success"]),
    }
    derived = {
        "purchase_year_month": F.trunc(day, "MM"),
        "purchase_day_of_week": name_of(WEEKDAYS_EN, weekday_number(day)),
        "purchase_month": name_of(MONTHS_EN, F.month(day) - 1),
        "purchase_year": F.year(day),
        "purchase_day": F.dayofmonth(day),
    }
    if "time_purchase" in types:
        given = F.col("time_purchase"), types["time_purchase"]
        typed["time_purchase_second"] = parse_second(*given)
        typed["time_purchase_hour"] = parse_hour(*given)
    if tickets_name in types:
        typed[tickets_name] = whole_number(parse_number(tickets, types[tickets_name]))
        derived["avg_ticket_price"] = F.when(tickets > 0, gmv / tickets).otherwise(F.lit(0.0))
    if {"place_origin_departure", "place_destination_departure"} <= set(types):
        derived["route"] = route(
            F.col("place_origin_departure"), F.col("place_destination_departure")
        )
    if {"place_origin_return", "place_destination_return"} <= set(types):
        back = F.col("place_origin_return").cast("string")
        derived["has_return"] = back.isNotNull() & (F.coalesce(back, F.lit("")) != NO_RETURN_PLACE)
    return raw.withColumns(typed).withColumns(derived)
