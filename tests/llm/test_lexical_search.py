"""Search against brute force: every score, ties, repeats, blocks of items, small trees."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from odd_tables import clashing, no_documents, odd_documents

from farebox.llm import lexical_search as module
from farebox.llm.lexical_search import Query, Tree, impact, search


def terms_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, top):
    bags = [(i, Counter(terms_of(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for (i, bag), size in zip(bags, sizes):
            m = 75 + (25 * size * n) // max(total, 1)
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in terms_of(text) if bag[t]
            )
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def ours(docs, items, **options):
    return sorted((tuple(r) for r in search(docs, items, **options).collect()), key=str)


def random_texts(seed, n, words=40, longest=120):
    r = random.Random(seed)
    pool = [f"w{k}" for k in range(words)] + ["É1", "é1", "naïve", "ABC"]
    text = lambda: " ".join(r.choice(pool[: r.randint(3, len(pool))]) for _ in range(r.randint(0, longest)))
    rows = [(i, text()) for i in range(n)]
    return rows + [(n + i, rows[3][1]) for i in range(60)] + [(2 * n + i, r.choice(rows)[1] + "-x") for i in range(40)]


@pytest.mark.parametrize(("leaf", "tree"), [(1, 64), (32, 4096)])
def test_brute_force(spark, monkeypatch, leaf, tree):
    monkeypatch.setattr(module, "LEAF_DOCS", leaf)
    monkeypatch.setattr(module, "TREE_DOCS", tree)
    docs = random_texts(1, 300)
    items = [*((i, t) for i, t in random_texts(2, 12, 44, 15)[:12]), (90, ""), (91, None), (92, "w1 w1 zz w1"), (92, "w2")]
    got = ours(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
        spark.createDataFrame(items, "item_id long, text string"), top=7,
    )
    assert got == brute(docs, items, 7)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK_CHARS", 60)
    docs, items = random_texts(3, 80), random_texts(4, 9, 44, 10)[:9]
    got = ours(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    )
    assert got == brute(docs, items, 20)


def test_odd_rows(spark):
    docs = clashing(odd_documents(spark), "id", "score", "rank", "item")
    items = clashing(docs.selectExpr("doc_id as item_id", "substring(text, 1, 70) as text"), "row", "block")
    twice = docs.union(docs)
    rows = [(r.doc_id, r.text) for r in twice.collect()]
    asked = [(r.item_id, r.text) for r in items.collect()]
    assert ours(twice, items) == brute(rows, asked, 20)
    assert ours(no_documents(spark), items) == [] and ours(docs, items.limit(0)) == []


def nested(n):
    """Every path is the start of the next one: the deepest tree there is."""
    return [np.arange(k, dtype=np.int32) for k in range(1, n + 1)]


def test_deep_tree_bounds_and_pruning():
    n = 3000
    paths = nested(n)
    tfs = [np.full(len(p), 1 + k % 5) for k, p in enumerate(paths)]
    m = np.arange(80, 80 + n)
    tree = Tree(np.arange(n).astype(object), m, paths, tfs, n)
    for node, (a, b, _) in enumerate(tree.nodes):
        for k in (a, (a + b) // 2, b - 1):
            assert (tree.bound[node][paths[k]] >= impact(tfs[k].astype(np.int64), m[k])).all()
    best, slot = [], np.zeros(n, np.int64)
    tree.search(Query(0, np.array([2, 2990]), np.array([10, 5000])), best, 3, slot)
    exact = sorted(
        ((sum(w * int(impact(tfs[k][:1].astype(np.int64), m[k])[0]) for t, w in ((2, 10), (2990, 5000)) if k >= t), -k) for k in range(n)),
        reverse=True,
    )[:3]
    assert sorted(best, reverse=True) == exact and not slot.any()


def test_subtrees_are_left_out():
    """A term that few documents hold opens few leaves."""
    r = random.Random(5)
    paths = sorted(tuple(sorted(r.sample(range(60), 12))) for _ in range(4000))
    rare = [p for p in paths if 59 in p and 58 in p]
    tree = Tree(
        np.arange(4000).astype(object), np.full(4000, 100), [np.array(p) for p in paths],
        [np.ones(12, np.int64)] * 4000, 60,
    )
    opened = []
    real = np.cumsum
    module.np.cumsum = lambda *a, **k: opened.append(1) or real(*a, **k)
    best = []
    tree.search(Query(0, np.array([0, 1, 2, 3]), np.array([4000, 4000, 4000, 4000])), best, 5, np.zeros(60, np.int64))
    module.np.cumsum = real
    leaves = sum(not c for c in tree.children)
    assert len(best) == 5 and len(opened) < leaves / 4 and rare
