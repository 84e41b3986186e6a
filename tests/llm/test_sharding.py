"""Exact shard sizes, gapless slots, uniform dealing."""

import math

import numpy as np
import pytest
from odd_tables import clashing, no_documents, odd_documents
from pyspark.sql import functions as F

from farebox.llm import sharding
from farebox.llm.queries import QUERIES
from farebox.llm.sharding import communication_matrix, shard_rows


def test_matrix_sums():
    counts = [0, 5, 1, 700, 33, 12]
    table = communication_matrix(counts, 24, 3)
    assert table.sum(axis=1).tolist() == counts and (table >= 0).all()
    sizes = table.sum(axis=0)
    assert sizes.max() - sizes.min() <= 1
    assert communication_matrix([], 4, 1).shape == (0, 4)
    big = communication_matrix([2 * 10**9, 10**9], 3, 1)
    assert big.sum(axis=1).tolist() == [2 * 10**9, 10**9] and big.sum(axis=0).tolist() == [10**9] * 3


def test_matrix_follows_the_law():
    """Rows of one partition in one shard: mean and variance of the hypergeometric law."""
    got = np.array([communication_matrix([60, 60], 3, seed)[0, 0] for seed in range(3000)])
    assert abs(got.mean() - 20) < 0.2
    assert abs(got.var() - 60 * (1 / 3) * (2 / 3) * (60 / 119)) < 0.6


@pytest.mark.parametrize("good, bad, draws", [(60, 60, 20), (300, 40, 270), (7, 500, 100), (5, 5, 5), (0, 9, 4)])
def test_large_urns_follow_the_law(monkeypatch, good, bad, draws):
    """The way for large urns, on small ones: frequencies against the probabilities."""
    monkeypatch.setattr(sharding, "NUMPY_LIMIT", 0)
    monkeypatch.setattr(sharding, "FEW", 3)
    rng, n = np.random.default_rng(5), 20_000
    got = np.bincount([sharding._hypergeometric(rng, good, bad, draws) for _ in range(n)], minlength=good + 1)
    want = np.array([math.comb(good, k) * math.comb(bad, draws - k) if k <= draws else 0 for k in range(good + 1)], float)
    want *= n / want.sum()
    assert got.sum() == n and (got[want == 0] == 0).all()
    seen = want > 5
    assert ((got - want)[seen] ** 2 / want[seen]).sum() < seen.sum() + 4 * math.sqrt(2 * seen.sum()) + 4


def test_urns_beyond_numpy():
    rng = np.random.default_rng(2)
    good, bad, draws = 10**13, 3 * 10**13, 10**12
    got = np.array([sharding._hypergeometric(rng, good, bad, draws) for _ in range(2000)], float)
    deviation = math.sqrt(draws * 0.25 * 0.75 * (1 - draws / (good + bad)))
    assert abs(got.mean() - draws / 4) < 4 * deviation / math.sqrt(2000)
    assert abs(got.std() / deviation - 1) < 0.07
    table = communication_matrix([10**12 + 7, 0, 5, 4 * 10**12], 24, 9)
    assert table.sum(axis=1).tolist() == [10**12 + 7, 0, 5, 4 * 10**12] and (table >= 0).all()
    sizes = table.sum(axis=0)
    assert sizes.max() - sizes.min() <= 1


def check(rows, total, shards):
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert sum(map(len, slots.values())) == total
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_shards(spark):
    docs = clashing(odd_documents(spark), "shard", "slot", "row_uid")
    rows = shard_rows(docs.select("doc_id", "extra", "shard"), 5).collect()
    check(rows, 13, 5)
    same = spark.range(0, 1003, 1, 7).select(F.lit(1).alias("x"))
    check(shard_rows(same, 8).collect(), 1003, 8)
    assert shard_rows(no_documents(spark).select("doc_id"), 8).count() == 0


def test_dealing_is_uniform(spark):
    rows = shard_rows(spark.range(0, 24_000, 1, 6), 4, seed=5).collect()
    table = np.zeros((6, 4))
    for r in rows:
        table[r.id // 4000, r.shard] += 1
    assert ((table - 1000) ** 2 / 1000).sum() < 45  # chi-square with 15 degrees of freedom
    firsts = sorted(r.id for r in rows if r.shard == 0 and r.slot < 600)
    assert abs(np.mean(firsts) - 12_000) < 1000


def test_query(spark):
    rows = QUERIES["op6_sharding"](spark, "/root/testdata/sf0.01").collect()
    check(rows, 1000, 24)
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    import zlib

    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)
