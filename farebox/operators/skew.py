"""A join that stays balanced when one key holds much of the rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot above this fraction of all rows, so there are fewer hot keys than this.
HOT_ONE_IN = 10_000


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join of ``rows`` with a table of one row per key.

    ``weight`` is the number of rows each key has. Rows of hot keys stay where they are
    and meet a broadcast of the hot part, at most ``HOT_ONE_IN`` rows by construction;
    only the other rows are shuffled by key. AQE's own skew split does not reach a join
    whose other side is an aggregate. Pass a staged ``per_key``; it is read three times.
    """
    total = per_key.agg(F.sum(weight)).scalar()
    hot = F.broadcast(per_key.where(F.col(weight) * HOT_ONE_IN > total).drop(weight))
    hot_rows = rows.join(hot, key)
    other_rows = rows.join(hot.select(key), key, "left_anti").join(per_key.drop(weight), key)
    return hot_rows.unionByName(other_rows)
