"""When and where together, for a given list of customers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.functions.fixed_values import HORIZONS
from farebox.operators.cycle import KEY


def joint_plan(asked: DataFrame, timing: DataFrame, routes: DataFrame) -> DataFrame:
    """A row for every asked row: the most likely window, the most likely next route, and the
    chance of both.

    ``timing`` has ``prob_<horizon>`` and ``routes`` has ``next_route`` and ``probability``,
    one row a customer each; they are joined from stored tables, so that an id that fills
    the list is split by AQE. The two chances are taken as independent. Repeated ids keep
    their rows. Ids without purchases, and null ids, have ``known = false`` and nulls; a
    customer without routes has a window and no route. Equal chances go to the shorter
    window.
    """
    days = F.lit(HORIZONS[-1])
    best = F.greatest(*[f"prob_{h}" for h in HORIZONS])
    for h in reversed(HORIZONS[:-1]):
        days = F.when(best == F.col(f"prob_{h}"), h).otherwise(days)
    timing = timing.select(
        KEY, F.lit(True).alias("known"), best.alias("window_probability"),
        F.when(best.isNotNull(), days).alias("best_window_days"),
    )
    places = routes.select(KEY, "next_route", F.col("probability").alias("route_probability"))
    return asked.select(KEY).join(timing, KEY, "left").join(places, KEY, "left").select(
        KEY, F.coalesce("known", F.lit(False)).alias("known"), "best_window_days", "window_probability",
        "next_route", "route_probability",
        (F.col("window_probability") * F.col("route_probability")).alias("joint_probability"),
    )
