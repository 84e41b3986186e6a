"""Removal of repeated strings against brute force."""

import hashlib
import random

import pytest
from odd_tables import LONG, ODD_ROWS, clashing, near_copies, no_documents, odd_documents

from farebox.llm import suffix_dedup
from farebox.llm.suffix_array import suffix_array
from farebox.llm.suffix_dedup import remove_repeats


def brute(rows, length=100):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        covered = bytearray(len(data))
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if window in seen:
                covered[p : p + length] = b"\1" * length
            seen.add(window)
        runs = sum(1 for p in range(len(data)) if covered[p] and (p == 0 or not covered[p - 1]))
        kept = bytes(c for c, x in zip(data, covered) if not x)
        out[i] = (len(data), sum(covered), runs, hashlib.sha256(kept).hexdigest())
    return out


def found(frame):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect()}


def test_suffix_array():
    r = random.Random(1)
    for _ in range(600):
        text = bytes(97 + r.randrange(r.choice([1, 2, 3, 26])) for _ in range(r.randrange(60)))
        text *= r.choice([1, 1, 2, 3])
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("seed, batch, crowd", [(1, 1 << 17, 1000), (2, 300, 4), (3, 1, 9), (4, 1 << 17, 0)])
def test_equal_to_brute_force(spark, monkeypatch, seed, batch, crowd):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", batch)
    monkeypatch.setattr(suffix_dedup, "CROWD_ROWS", crowd)
    r = random.Random(seed)
    rows = near_copies(seed, groups=6, copies=7)
    rows += [(len(rows) + i, "".join(r.choice("ab") for _ in range(400)) * 2) for i in range(4)]
    passage = " ".join(text for _, text in rows[:2])
    rows += [(len(rows) + i, f"{i} {passage[i * 3:]} {r.random()} {passage[: 300 - i]}") for i in range(12)]
    rows += [(900 + i, "xyz" * (30 + i)) for i in range(8)] + [(950, "é" * 120), (951, "xé" + "é" * 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert found(remove_repeats(docs)) == brute(rows)


def test_other_lengths_and_text(spark):
    rows = near_copies(4, groups=3, copies=4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = remove_repeats(docs, length=60, want_text=True)
    assert found(out) == brute(rows, 60)
    for row in out.collect():
        assert hashlib.sha256(row.kept_text.encode()).hexdigest() == row.kept_sha256


def test_odd_rows(spark):
    docs = clashing(odd_documents(spark), "n_bytes", "id", "copy", "spans")
    rows = {r.doc_id: r for r in remove_repeats(docs).collect()}
    assert len(rows) == len(ODD_ROWS) and rows[1].extra == "mine" and rows[1].n_bytes == 63 + 0
    for i in (2, 3):
        assert (rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans) == (0, 0, 0)
        assert rows[i].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[8].n_removed == len(LONG) and rows[8].n_spans == 1 and rows[12].n_removed == 4999
    assert remove_repeats(no_documents(spark)).count() == 0
    again = sorted(map(str, remove_repeats(docs.union(docs)).collect()))
    assert again[::2] == again[1::2] == sorted(map(str, rows.values()))


def test_null_ids_come_first_and_repeated_ids_are_apart(spark):
    text = "".join(chr(97 + (i * i) % 26) + str(i) for i in range(60))
    docs = spark.createDataFrame([(1, text), (None, text), (1, "x" + text)], "doc_id long, text string")
    rows = [(r.doc_id, r.n_bytes, r.n_removed) for r in remove_repeats(docs).collect()]
    n = len(text)
    assert sorted(rows, key=str) == sorted([(None, n, 0), (1, n, n), (1, n + 1, n)], key=str)


def test_windows_of_many_anchors_are_hashed_at_once(monkeypatch):
    """In one go, groups give what each gives alone; windows of other anchors do not count."""
    r = random.Random(5)
    common = [bytes(r.choices(b"abc", k=130)) for _ in range(3)]
    groups = []
    for g in range(40):
        texts = [common[r.randrange(3)][r.randrange(20) :] + bytes(r.choices(b"xy", k=r.randrange(20))) for _ in range(4)]
        groups.append([((g * 10 + i, 0, 0), 0, r.randrange(2), text) for i, text in enumerate(texts)])
    alone, at = [], 0
    for group in groups:
        alone += [(at + i, a, b) for i, a, b in suffix_dedup.unique_windows_removed(group, 100)]
        at += len(group)
    made = []
    hasher = suffix_dedup.Hasher
    monkeypatch.setattr(suffix_dedup, "Hasher", lambda data: made.append(len(data)) or hasher(data))
    anchors = [7 * g - 100 for g, group in enumerate(groups) for _ in group]
    assert suffix_dedup.unique_windows_removed(sum(groups, []), 100, anchors) == alone
    assert alone and len(made) == 1
