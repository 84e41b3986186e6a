"""Shared lines against brute force: counts, first places, bitmaps, odd texts."""

import random
import time

import pytest
from odd_tables import clashing, no_documents, odd_documents
from pyspark.sql import functions as F

from farebox.llm import line_dedup
from farebox.llm.line_dedup import kept_text, shared_line_bitmaps
from farebox.llm.queries import QUERIES

BLANKS = " \t\n\x0b\f\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line).strip(BLANKS)


def brute(rows, min_docs, keep_first=False, min_chars=1):
    """(id, text) -> list of (id, lines, dropped, kept text), for rows with ids of their own."""
    lines = {i: (t or "").split("\n") for i, t in rows}
    docs, first = {}, {}
    for i in sorted(lines):
        for p, line in enumerate(lines[i]):
            docs.setdefault(key(line), set()).add(i)
            first.setdefault(key(line), (i, p))
    out = []
    for i, own in lines.items():
        gone = [
            len(key(x)) >= min_chars and len(docs[key(x)]) >= min_docs
            and not (keep_first and first[key(x)] == (i, p)) for p, x in enumerate(own)
        ]
        out.append((i, len(own), sum(gone), "\n".join(x for x, g in zip(own, gone) if not g)))
    return sorted(out)


def ours(df, **options):
    found = shared_line_bitmaps(df, **options)
    text = kept_text(F.col("text"), F.col("keep_lines")).alias("kept")
    return sorted(tuple(r) for r in found.select("doc_id", "n_lines", "n_dropped", text).collect())


def random_rows(seed, n=120):
    r = random.Random(seed)
    pool = [f" Line {k}é " if k % 3 else f"LINE {k}" for k in range(40)] + ["", "  ", "\r", "Ä", "ä", "x"]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.choice([0, 1, 3, 9, 80, 200])))) for i in range(n)]
    return [(i, f"{t}\nShared Foot " if i % 3 == 0 else t) for i, t in rows]


@pytest.mark.parametrize("hot", [1, 2000])
@pytest.mark.parametrize("keep_first", [False, True])
def test_brute_force(spark, monkeypatch, hot, keep_first):
    """With every key in blocks, and with none."""
    monkeypatch.setattr(line_dedup, "HOT_ONE_IN", hot)
    rows = random_rows(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for min_docs in (1, 60):
        got = ours(df, min_docs=min_docs, keep_first=keep_first)
        assert got == brute(rows, min_docs, keep_first)
    assert ours(df, min_docs=5, min_chars=7, keep_first=keep_first) == brute(rows, 5, keep_first, 7)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    twice = clashing(docs.union(docs), "keep_lines", "_pos", "_doc", "_row", "n_lines", "_text1")
    found = {}
    for r in shared_line_bitmaps(twice, min_docs=3).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert all(len(rows) == 2 and rows[0] == rows[1] for rows in found.values())
    dropped = {i for i, rows in found.items() if rows[0].n_dropped}
    assert dropped == {1, 6, 7, 8, 9, 10}  # each text in two ids, so in four rows
    assert found[2][0].n_lines == 1 and found[4][0].n_lines == 3 and found[None][0]._pos == "mine"
    assert found[1][0].keep_lines[0].bits == -2
    assert shared_line_bitmaps(no_documents(spark)).count() == 0


def test_long_text(spark):
    """A text of 300,000 lines is cut in time linear in its lines."""
    text = "\n".join(f"own {k}" if k % 2 else "again" for k in range(300_000))
    rows = [(0, text), *((i, "Again\nmore") for i in range(1, 12))]
    start = time.monotonic()
    got = ours(spark.createDataFrame(rows, "doc_id long, text string"))
    assert time.monotonic() - start < 60
    assert got == brute(rows, 10)


def test_native_plan(spark):
    """No Python in the plans, and the windows need no exchange beyond the range partitioning."""
    docs = odd_documents(spark)
    lines = line_dedup.line_hashes(docs, "doc_id", "text", 1)
    plan = QUERIES["op11_line_dedup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    for node in ("Python", "Arrow", "Pandas", "MapIn", "Cartesian", "NestedLoop"):
        assert node not in plan
    assert "posexplode" in lines._jdf.queryExecution().toString()


def test_windows_share_one_exchange(spark, monkeypatch):
    seen = []
    real = line_dedup.stage
    monkeypatch.setattr(
        line_dedup, "stage",
        lambda df, label: seen.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, label),
    )
    shared_line_bitmaps(odd_documents(spark))
    assert seen[0].count("Exchange") == 1 and "rangepartitioning" in seen[0] and seen[0].count("Sort ") == 1
