"""Small expressions used by several operators."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Money is summed as a decimal: the total does not depend on how rows are spread. Eight
# places keep values as they came; sums of 10^10 values of the largest size still fit.
MONEY = "decimal(28,8)"
MONEY_LIMIT = 1e20


def money(value: Column) -> Column:
    """A value as a decimal; null if it is too large for one."""
    return value.try_cast(MONEY)


def money_sum(value: Column) -> Column:
    """Sum of a money column, 0 for a group that is all null."""
    return F.coalesce(F.sum(money(value)).cast("double"), F.lit(0.0))


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``, 0 unless the denominator is positive."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def percent_above(value: Column, base: Column) -> Column:
    """How many percent ``value`` is above ``base``, 0 unless the base is positive."""
    return F.when(base > 0, (value / base - 1) * 100).otherwise(F.lit(0.0))


def round2(value: Column) -> Column:
    """Two decimals, halves to even on the scaled value."""
    return F.rint(value * 100) / 100


def scalar_struct(one_row: DataFrame) -> Column:
    """A one-row frame as a struct-valued scalar subquery.

    Add it as a column and read the fields from there: the plan then holds it once.
    """
    return one_row.select(F.struct(*one_row.columns)).scalar()


def literal_rows(spark: SparkSession, rows: list[tuple], schema: dict[str, str]) -> DataFrame:
    """A few rows known to the driver, as a plan of constants."""
    if not rows:
        return spark.createDataFrame([], ", ".join(f"{n} {k}" for n, k in schema.items()))
    structs = [
        F.struct(
            *[
                F.lit(value).cast(kind).alias(name)
                for value, (name, kind) in zip(row, schema.items())
            ]
        )
        for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def month_offset(later: Column, earlier: Column) -> Column:
    """Whole months between two first-of-month dates."""
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def labelled(condition: Column) -> Column:
    """0/1 label of a comparison; an unknown comparison is 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")
