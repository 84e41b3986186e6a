"""Rank quartiles against brute force, and the segment rules on every cell."""

import math
import random

import pytest
from pyspark.sql import functions as F

from farebox.operators import rfm as R
from farebox.staging import stage

SCHEMA = "fk_contact string, recency int, frequency bigint, monetary double"

# Segment by (R, F) row and M column, M = 1..4.
CELLS = {
    (4, 1): ["Novos", "Novos", "Novos", "Novos"],
    (4, 2): ["Precisam Atenção", "Precisam Atenção", "Potenciais", "Potenciais"],
    (4, 3): ["Leais", "Leais", "Campeões", "Campeões"],
    (4, 4): ["Leais", "Campeões", "Campeões", "Campeões"],
    (3, 1): ["Precisam Atenção", "Precisam Atenção", "Potenciais", "Potenciais"],
    (3, 2): ["Precisam Atenção", "Precisam Atenção", "Potenciais", "Potenciais"],
    (3, 3): ["Outros", "Leais", "Leais", "Campeões"],
    (3, 4): ["Leais", "Leais", "Campeões", "Campeões"],
    (2, 1): ["Perdidos", "Hibernando", "Hibernando", "Hibernando"],
    (2, 2): ["Outros", "Hibernando", "Hibernando", "Hibernando"],
    (2, 3): ["Outros", "Outros", "Em Risco", "Em Risco"],
    (2, 4): ["Outros", "Leais", "Em Risco", "Em Risco"],
    (1, 1): ["Perdidos", "Hibernando", "Hibernando", "Hibernando"],
    (1, 2): ["Outros", "Hibernando", "Hibernando", "Hibernando"],
    (1, 3): ["Outros", "Outros", "Em Risco", "Em Risco"],
    (1, 4): ["Outros", "Outros", "Em Risco", "Em Risco"],
}


def test_every_segment_cell(spark):
    cells = [(r, f, m, name) for (r, f), names in CELLS.items() for m, name in enumerate(names, 1)]
    table = spark.createDataFrame(cells, "r int, f int, m int, expected string")
    wrong = table.where(R.segment_name(F.col("r"), F.col("f"), F.col("m")) != F.col("expected"))
    assert len(cells) == 64 and wrong.count() == 0


def rank_quartiles(values: dict) -> dict:
    """Quartile of the rank of (value, key), straight from the definition."""
    n = len(values)
    ordered = sorted(values, key=lambda key: (values[key], key))
    if n == 1:
        return {ordered[0]: 1}
    return {
        key: max(1, math.ceil(4 * (rank - 1) / (n - 1))) for rank, key in enumerate(ordered, start=1)
    }


def customers(n: int, kind: str):
    rng = random.Random(n)
    for i in range(n):
        frequency = {"tied": 1, "skewed": 1 if rng.random() < 0.8 else rng.randint(2, 40)}.get(
            kind, rng.randint(1, 30)
        )
        yield (f"c{rng.randrange(10**9):09d}-{i}", rng.randint(0, 900), frequency,
               round(rng.uniform(0, 5000), 2))


@pytest.mark.parametrize(
    "n, kind", [(1, "tied"), (2, "mixed"), (7, "tied"), (10, "mixed"), (3001, "skewed"), (997, "tied")]
)
def test_rank_quartiles_equal_brute_force(spark, n, kind):
    data = list(customers(n, kind))
    table = stage(spark.createDataFrame(data, SCHEMA), "test-rfm")
    found = {r.fk_contact: r for r in R.rfm_quartiles(table).collect()}
    for column, position in (("F_quartile", 2), ("M_quartile", 3)):
        expected = rank_quartiles({row[0]: row[position] for row in data})
        assert {key: row[column] for key, row in found.items()} == expected
    sizes = [sum(row.M_quartile == q for row in found.values()) for q in (1, 2, 3, 4)]
    assert n < 4 or max(sizes) - min(sizes) <= 1


def test_a_bracket_that_misses_is_made_good(spark):
    data = list(customers(500, "mixed"))
    table = spark.createDataFrame(data, SCHEMA).cache()
    useless = {"monetary": [(-2.0, -1.0)], "frequency": [(10_000, 20_000)]}
    cuts = R.rank_cuts(table, ["frequency", "monetary"], 500, useless)
    for measure, position in (("frequency", 2), ("monetary", 3)):
        ordered = sorted((row[position], row[0]) for row in data)
        assert cuts[measure] == [ordered[rank - 1] for rank in R.cut_ranks(500)]


def test_quartiles_do_not_depend_on_partitioning(spark):
    data = list(customers(400, "skewed"))
    once = stage(spark.createDataFrame(data, SCHEMA).coalesce(1), "one-file")
    spread = stage(spark.createDataFrame(data, SCHEMA).repartition(7), "seven-files")
    assert sorted(R.rfm_quartiles(once).collect()) == sorted(R.rfm_quartiles(spread).collect())


def test_tied_recency(spark):
    data = [(f"c{i}", 5 if i < 8 else 40, 1, 1.0) for i in range(10)]
    table = stage(spark.createDataFrame(data, SCHEMA), "tied-recency")
    assert {r.R_quartile for r in R.rfm_quartiles(table).where("recency = 5").collect()} == {4}
    with pytest.raises(ValueError):
        R.rfm_quartiles(table, strict=True)


def test_no_customers(spark):
    table = stage(spark.createDataFrame([], SCHEMA), "no-rfm")
    frame = R.rfm_segments(R.rfm_quartiles(table))
    assert frame.count() == 0 and "RFM_score" in frame.columns
