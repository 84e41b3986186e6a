"""Components of similar documents against brute force."""

import re

import pytest
from odd_tables import ODD_ROWS, clashing, near_copies, no_documents, odd_documents

from farebox.llm import jaccard_join
from farebox.llm.components import components


def brute(rows, k, percent):
    sets = {}
    for i, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        whole = [tuple(w)] if w else []
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else set(whole)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def found(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


@pytest.mark.parametrize("k, percent, seed", [(4, 85, 1), (5, 80, 2), (3, 60, 3), (4, 100, 4)])
def test_components_equal_brute_force(spark, k, percent, seed):
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(jaccard_join.similar_components(docs, k=k, percent=percent)) == brute(rows, k, percent)


def test_hot_grams_and_small_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_COUNT", 3)
    monkeypatch.setattr(jaccard_join, "SALT_ROWS", 2)
    rows = near_copies(5, groups=4, copies=25)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert found(jaccard_join.similar_components(docs)) == brute(rows, 4, 85)


def test_without_the_original(spark):
    """Copies that link only through others must still be one component."""
    r = near_copies(6, groups=1, copies=60, words=100)
    docs = spark.createDataFrame(r[1:], "doc_id long, text string")
    assert found(jaccard_join.similar_components(docs)) == brute(r[1:], 4, 85)


def test_odd_rows(spark):
    docs = clashing(odd_documents(spark), "key", "n_shingles", "component_id")
    rows = jaccard_join.similar_components(docs).collect()
    assert len(rows) == len(ODD_ROWS)
    by_id = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert by_id[2] == by_id[3][:1] + (2,) == (0, 2) and by_id[4] == (0, 4)
    assert by_id[6][1] == 1 and by_id[8][1] == 7 and by_id[10] == (1, 9) and by_id[5] == (1, 5)
    assert by_id[None][1] is None
    repeated = docs.select("doc_id", "text").union(docs.select("doc_id", "text"))
    assert {(r.doc_id, r.component_id) for r in jaccard_join.similar_components(repeated).collect()} == {
        (r.doc_id, r.component_id) for r in rows
    }
    assert jaccard_join.similar_components(no_documents(spark)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91)], "a long, b long")
    labels = {r.node: r.label for r in components(links).collect()}
    assert labels == {**{i: 0 for i in range(41)}, 90: 90, 91: 90}


def test_plan_has_no_cross_join(spark):
    docs = spark.createDataFrame(near_copies(7, groups=2), "doc_id long, text string")
    plan = jaccard_join.similar_components(docs)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan
