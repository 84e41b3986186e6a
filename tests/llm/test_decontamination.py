"""Bit-parallel distance and piece search against plain dynamic programming."""

import random

from odd_tables import ODD_ROWS, clashing, no_documents, odd_documents

import corpus_pipeline
from farebox.llm import decontamination as d
from farebox.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def brute(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != t)))
        row = new
    return min(row), row.index(min(row))


def edited(r, text, edits):
    out = list(text)
    for _ in range(edits):
        k, kind = r.randrange(len(out)), r.randrange(3)
        if kind == 0:
            out[k] = r.choice("abcxyz")
        elif kind == 1:
            out.insert(k, r.choice("abcxyz"))
        elif len(out) > 2:
            del out[k]
    return "".join(out)


def test_distance():
    r = random.Random(1)
    for _ in range(200):
        item = "".join(r.choice("abc ") for _ in range(r.randrange(1, 90)))
        text = "".join(r.choice("abc ") for _ in range(r.randrange(150)))
        assert d.best_match(item, d.bits(item), text) == brute(item, text)


def test_pieces_cover_the_item():
    for n in (1, 5, 37, 200):
        for budget in range(5):
            parts = d.pieces("x" * n, budget)
            assert len(parts) == budget + 1 and sum(len(p) for _, p in parts) == n


def test_block_finds_all_and_only(spark):
    r = random.Random(2)
    items = [(i, "".join(r.choice("abcdefghijk ") for _ in range(r.randrange(40, 140)))) for i in range(12)]
    texts = []
    for _ in range(60):
        chosen = r.sample(items, 2)
        gap = lambda: "".join(r.choice("abcdefghijk ") for _ in range(r.randrange(60)))
        texts.append(gap() + "".join(edited(r, t, r.randrange(9)) + gap() for _, t in chosen))
    block = d.Block(items, 0.05)
    hits = 0
    for text in texts:
        want = {i: brute(t, text)[0] for i, t in items if brute(t, text)[0] <= int(0.05 * len(t))}
        got = block.matches(text)
        assert {m[0]: m[1] for m in got} == want
        for item_id, edits, a, b in got:
            assert brute(dict(items)[item_id], text[a:b])[0] == edits
        hits += len(got)
    assert hits > 20


def test_blocks_give_the_same(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    one = sorted(map(tuple, QUERIES["op4_decontamination"](spark, FOLDER).collect()))
    many = d.find_leaks(docs, items, keep=["doc_id"], block_chars=1500)
    assert sorted(map(tuple, many.collect())) == one and len(one) > 10
    leaking = {r[0] for r in one}
    wanted = {
        r.doc_id for r in docs.collect()
        if any(d.normalise(i.text) in d.normalise(r.text) for i in items.collect())
    }
    assert wanted == leaking
    kept = {r.doc_id for r in d.without_leaks(docs, items, block_chars=1500).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - leaking


def test_odd_rows(spark):
    docs = clashing(odd_documents(spark), "item_id", "distance")
    long_item = "The  CAT sat on the mat\nand the dog sat by the door"
    items = spark.createDataFrame(
        [(1, long_item), (2, None), (3, ""), (4, "word"), (5, long_item), (None, long_item)], "item_id long, text string"
    )
    rows = d.find_leaks(docs, items, short_items=False).collect()
    assert sorted((r.doc_id, r.item_id or 0) for r in rows) == [(1, 0), (1, 1), (1, 5), (6, 0), (6, 1), (6, 5)]
    assert all(r.extra == "mine" and r.distance == 0 for r in rows)
    assert d.without_leaks(docs, items, short_items=False).count() == len(ODD_ROWS) - 2
    whole = {(r.doc_id, r.item_id or 0) for r in d.find_leaks(docs, items).collect()}
    assert {pair for pair in whole if pair[1] != 4} == {(1, 0), (1, 1), (1, 5), (6, 0), (6, 1), (6, 5)}
    assert d.find_leaks(no_documents(spark), items).count() == 0
    assert d.find_leaks(docs, items.where("false")).count() == 0
    assert d.without_leaks(docs, items.where("false")).count() == len(ODD_ROWS)


def test_short_items(spark, tmp_path):
    docs = spark.createDataFrame(
        [(1, "So, what is 2+2? Four."), (2, "Words only"), (3, "a word"), (4, "\u6771\u4eac\u90fd\u5e81"), (5, None), (6, "keyword word")],
        "doc_id long, text string",
    )
    items = spark.createDataFrame(
        [(1, "What is 2+2?"), (2, "word"), (3, "\u4eac\u90fd"), (4, " "), (5, "four, or five then"), (6, None)], "item_id long, text string"
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    found = sorted(map(tuple, QUERIES["op4_decontamination"](spark, str(tmp_path)).collect()))
    assert found == [(1, 1, 0, 4, 16), (3, 2, 0, 2, 6), (4, 3, 0, 1, 3), (6, 2, 0, 8, 12)]
    left = corpus_pipeline.without_benchmark(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in left.collect()) == [2, 5]


def test_every_length_has_its_own_budget(spark):
    """From 20 characters on one edit is allowed, whatever stands beside the match."""
    letters = "abcdefghijklmnopqrstuvwxyzabcd"
    items = [(n, letters[:n]) for n in range(18, 31)]
    for n, item in items:
        block = d.Block([(n, item)], 0.05)
        near = "xx" + item[:5] + "#" + item[6:] + "yy"
        assert bool(block.matches(near)) == (n >= 20) == (brute(item, near)[0] <= int(0.05 * n))
        assert block.matches(item) == [(n, 0, 0, n)]
        assert bool(block.matches("x" + item)) == (n >= 20)
    docs = spark.createDataFrame([(1, "so: what is 2 plus 3 then?"), (2, "what is 2 plus then")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "what is 2 plus 2 then?")], "item_id long, text string")
    assert [(r.doc_id, r.distance) for r in d.find_leaks(docs, asked).collect()] == [(1, 1)]
    assert [r.doc_id for r in d.without_leaks(docs, asked).collect()] == [2]
