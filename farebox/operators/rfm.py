"""Recency, frequency and monetary value per customer, quartiles and segments."""

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farebox.functions.fixed_values import OTHER_SEGMENT
from farebox.functions.measures import money_sum
from farebox.staging import stage

KEY = "fk_contact"
SKETCH_ACCURACY = 10_000
# The sketch's rank error is at most 1/accuracy of the rows; twice that is the margin.
SKETCH_MARGIN = 2.0 / SKETCH_ACCURACY


def rfm(purchases: DataFrame, as_of: datetime.date | None = None) -> DataFrame:
    """One row per customer: days since the last purchase, purchases (rows), GMV.

    Rows without customer or date are left out. ``as_of`` defaults to today.
    """
    today = F.current_date() if as_of is None else F.lit(as_of)
    return (
        purchases.where(F.col(KEY).isNotNull() & F.col("date_purchase").isNotNull())
        .groupBy(KEY)
        .agg(
            F.datediff(today, F.max("date_purchase")).alias("recency"),
            F.count("nk_ota_localizer_id").alias("frequency"),
            money_sum(F.col("gmv_success")).alias("monetary"),
        )
    )


def excluded_from_rfm(purchases: DataFrame) -> DataFrame:
    """How many rows RFM leaves out, and why; one row."""
    return purchases.agg(
        F.count_if(F.col(KEY).isNull()).alias("without_customer"),
        F.count_if(F.col("date_purchase").isNull()).alias("without_date"),
    )


def cut_ranks(n: int, parts: int = 4) -> list[int]:
    """Last rank of each part but the top one, when ranks 1..n are cut at linearly
    interpolated quantiles. Not ``ntile``: they differ when n mod 4 is 2 or 3."""
    return [k * (n - 1) // parts + 1 for k in range(1, parts)]


def rank_cuts(df: DataFrame, measures: list[str], n: int, brackets: dict) -> dict:
    """For each measure, the (value, key) rows at the cut ranks of (value, key) order.

    ``brackets`` holds value ranges expected to contain the cuts. They are checked by
    exact counts and only the rows inside are sorted, by range over all tasks with the
    key as second sort column, so one hugely repeated value is spread as well. At most
    three rows per measure reach the driver.
    """
    ranks = cut_ranks(n)
    checks = []
    for measure in measures:
        for i, (low, high) in enumerate(brackets[measure]):
            checks += [
                F.count_if(F.col(measure) < low).alias(f"{measure}_below_{i}"),
                F.count_if(F.col(measure) <= high).alias(f"{measure}_upto_{i}"),
            ]
    counts = df.agg(*checks).first()

    wanted, candidates, position = [], None, 0
    for measure in measures:
        spans = [
            (low, high, counts[f"{measure}_below_{i}"], counts[f"{measure}_upto_{i}"])
            for i, (low, high) in enumerate(brackets[measure])
        ]
        homes = [
            next((j for j, s in enumerate(spans) if s[2] < rank <= s[3]), None) for rank in ranks
        ]
        inside = F.lit(False)
        if None in homes:
            # A bracket missed its cut: sort everything rather than answer wrongly.
            spans, homes, inside = [(None, None, 0, n)], [0] * len(ranks), F.lit(True)
        for low, high, _, _ in spans:
            if low is not None:
                inside = inside | F.col(measure).between(low, high)
        starts = [position + sum(s[3] - s[2] for s in spans[:j]) for j in range(len(spans))]
        wanted += [
            (measure, starts[home] + rank - spans[home][2]) for rank, home in zip(ranks, homes)
        ]
        position += sum(s[3] - s[2] for s in spans)
        rows = df.where(inside).select(
            F.lit(len(wanted)).alias("part"), F.col(measure).cast("double").alias("value"), KEY
        )
        candidates = rows if candidates is None else candidates.unionAll(rows)

    order = ["part", "value", KEY]
    ordered = stage(
        candidates.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumns(
            {
                "task": F.spark_partition_id(),
                # Low 33 bits of this id are the row's position within its task.
                "row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
            }
        ),
        "rank-cuts",
    )
    # One row per task: bounded by the number of shuffle partitions.
    sizes = ordered.groupBy("task").count().orderBy("task").collect()
    picks, seen = {}, 0
    for task, size in sizes:
        for index, (_, at) in enumerate(wanted):
            if seen < at <= seen + size:
                picks[index] = (task, at - seen - 1)
        seen += size
    hit = F.lit(False)
    for task, row in set(picks.values()):
        hit = hit | ((F.col("task") == task) & (F.col("row") == row))
    found = {(r["task"], r["row"]): (r["value"], r[KEY]) for r in ordered.where(hit).collect()}
    cuts = {measure: [] for measure in measures}
    for index, (measure, _) in enumerate(wanted):
        cuts[measure].append(found[picks[index]])
    return cuts


def _merged(pairs: list[tuple]) -> list[tuple]:
    """Ranges in ascending order with overlapping ones joined."""
    merged = []
    for low, high in sorted(pairs):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def _part(measure: str, cuts: list[tuple]) -> Column:
    value, key = F.col(measure), F.col(KEY)
    part = None
    for number, (cut_value, cut_key) in enumerate(cuts, start=1):
        reached = (value < cut_value) | ((value == cut_value) & (key <= cut_key))
        part = F.when(reached, number) if part is None else part.when(reached, number)
    return part.otherwise(len(cuts) + 1)


def rfm_quartiles(table: DataFrame, strict: bool = False) -> DataFrame:
    """``rfm`` with quartiles 1..4 and their sum. Pass a staged table: it is read for
    the quantiles, for the rank cuts and for the result.

    Recency is cut at its value quartiles (4 is most recent); frequency and monetary
    are cut at quartiles of their rank, ties ranked by customer. ``strict`` refuses
    recency with coinciding edges instead of using the lowest fitting bin.
    """
    points = [0.25, 0.5, 0.75]
    probes = [min(1.0, max(0.0, p + side * SKETCH_MARGIN)) for p in points for side in (-1, 1)]
    summary = table.agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile("recency", points).alias("edges"),
        *[
            F.percentile_approx(measure, probes, SKETCH_ACCURACY).alias(measure)
            for measure in ("frequency", "monetary")
        ],
    ).first()
    n = summary["n"]
    if n == 0:
        empty = F.lit(None).cast("int")
        return table.withColumns(
            {name: empty for name in ("R_quartile", "F_quartile", "M_quartile", "RFM_score")}
        )
    edges = summary["edges"]
    if strict and len(set(edges)) < len(edges):
        raise ValueError("recency quartile edges are not distinct")
    brackets = {
        measure: _merged(list(zip(summary[measure][0::2], summary[measure][1::2])))
        for measure in ("frequency", "monetary")
    }
    cuts = rank_cuts(table, ["frequency", "monetary"], n, brackets)
    recency = F.col("recency")
    r = (
        F.when(recency <= edges[0], 4)
        .when(recency <= edges[1], 3)
        .when(recency <= edges[2], 2)
        .otherwise(1)
    )
    return table.withColumns(
        {
            "R_quartile": r,
            "F_quartile": _part("frequency", cuts["frequency"]),
            "M_quartile": _part("monetary", cuts["monetary"]),
        }
    ).withColumn("RFM_score", F.col("R_quartile") + F.col("F_quartile") + F.col("M_quartile"))


def segment_name(r: Column, f: Column, m: Column) -> Column:
    """Segment of a quartile triple; the first rule that holds decides."""
    score = r + f + m
    return (
        F.when((r <= 2) & (f <= 1) & (m <= 1), "Perdidos")
        .when((r == 4) & (f == 1), "Novos")
        .when((r >= 3) & (f <= 2) & (m <= 2), "Precisam Atenção")
        .when((r <= 2) & (f <= 2) & (m >= 2), "Hibernando")
        .when((r <= 2) & (f >= 3) & (m >= 3), "Em Risco")
        .when((r >= 3) & (f < 3) & (m >= 3), "Potenciais")
        .when((score >= 8) & (score < 10), "Leais")
        .when(score >= 10, "Campeões")
        .otherwise(OTHER_SEGMENT)
    )


def rfm_segments(quartiles: DataFrame) -> DataFrame:
    return quartiles.withColumn(
        "Segment", segment_name(F.col("R_quartile"), F.col("F_quartile"), F.col("M_quartile"))
    )


def segment_report(segments: DataFrame) -> DataFrame:
    """Customers, value, mean value and shares per segment, most valuable first (at most
    nine rows)."""
    every = Window.partitionBy()
    return (
        segments.groupBy("Segment")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            money_sum(F.col("monetary")).alias("total_value"),
        )
        .withColumns(
            {
                "mean_value": F.col("total_value") / F.col("customers"),
                "pct_customers": F.col("customers") / F.sum("customers").over(every) * 100,
                "pct_value": F.col("total_value")
                / F.sum(F.col("total_value").cast("decimal(28,2)")).over(every).cast("double")
                * 100,
            }
        )
        .orderBy(F.desc("total_value"), "Segment")
    )


def rfm_sample(segments: DataFrame, size: int = 1000) -> DataFrame:
    """A repeatable sample of at most ``size`` customers: the smallest key digests."""
    return (
        segments.orderBy(F.md5(KEY), KEY)
        .limit(size)
        .select(KEY, "recency", "frequency", "monetary", "Segment")
    )
