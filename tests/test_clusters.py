"""Planted customer groups are found, and the silhouette equals that over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from farebox.models import clusters

SCHEMA = "fk_contact string, recency int, frequency long, monetary double"
GROUPS = [(5, 30, 9000.0), (60, 6, 400.0), (300, 1, 30.0)]


@pytest.fixture(scope="module")
def planted(spark):
    r = random.Random(2)
    rows = []
    for i in range(600):
        recency, frequency, monetary = GROUPS[i % 3]
        rows.append((f"c{i}", round(recency * r.uniform(0.8, 1.2)), round(frequency * r.uniform(0.9, 1.1)), monetary * r.uniform(0.8, 1.2)))
    return spark.createDataFrame(rows, SCHEMA).cache()


def test_planted_groups(planted):
    rows = clusters.scaled(planted)
    found = clusters.fit_clusters(rows, 3).assign(rows).collect()
    assert {(r.cluster, int(r.fk_contact[1:]) % 3) for r in found} == {(0, 0), (1, 1), (2, 2)}
    moved = clusters.scaled(planted.repartition(11, "monetary"))
    again = clusters.fit_clusters(moved, 3).assign(moved).collect()
    assert sorted((r.fk_contact, r.cluster) for r in found) == sorted((r.fk_contact, r.cluster) for r in again)
    profile = clusters.cluster_profile(clusters.fit_clusters(rows, 3).assign(rows)).collect()
    assert [r.customers for r in profile] == [200] * 3 and min(r.silhouette for r in profile) > 0.8


def test_silhouette_over_all_pairs(spark, planted):
    rows = clusters.scaled(planted.limit(60)).withColumn("cluster", F.pmod(F.hash("fk_contact"), F.lit(4)))
    rows = rows.withColumn("cluster", F.when(F.col("fk_contact") == "c1", 9).otherwise(F.col("cluster"))).cache()
    points = [(r.fk_contact, r.cluster, [r[x] for x in clusters.SCALED]) for r in rows.collect()]
    far = lambda p, q: sum((a - b) ** 2 for a, b in zip(p, q))
    for r in clusters.silhouettes(rows).collect():
        p = [r[x] for x in clusters.SCALED]
        means = {}
        for who, cluster, q in points:
            if who != r.fk_contact:
                means.setdefault(cluster, []).append(far(p, q))
        means = {c: sum(v) / len(v) for c, v in means.items()}
        if r.cluster not in means:
            assert r.silhouette == 0
            continue
        inside, near = means.pop(r.cluster), min(means.values())
        assert r.silhouette == pytest.approx((near - inside) / max(near, inside), abs=1e-9)


def test_odd_tables(spark, planted):
    empty = clusters.scaled(planted.where("false"))
    assert clusters.fit_clusters(empty).assign(empty).count() == 0
    same = clusters.scaled(spark.createDataFrame([("a", 1, 1, 1.0), ("b", 1, 1, 1.0), ("c", None, 1, 1.0)], SCHEMA))
    found = clusters.fit_clusters(same).assign(same)
    assert found.count() == 2 and {r.silhouette for r in clusters.silhouettes(found).collect()} == {None}
