"""Phrases against brute force: overlaps, pieces, languages, cuts, long texts."""

import random
import re
from collections import Counter

import pytest
from odd_tables import clashing, no_documents, odd_documents

from farebox.llm import collocations as module
from farebox.llm.collocations import collocations


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, min_count, top, inside_percent=100):
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                counts.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    often = {p: f for p, f in counts.items() if len(p) > 2 and f >= min_count}
    out = {}
    for (lang, *words), a in often.items():
        holding = [
            f for (other, *q), f in often.items() if other == lang and len(q) > len(words)
            and any(q[i : i + len(words)] == words for i in range(len(q)))
        ]
        if any(100 * f >= inside_percent * a for f in holding):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[(lang, *words[:k])], counts[(lang, *words[k:])]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted(
        (lang, rank, phrase.decode(), -a, left, right, n[lang], -score)
        for lang, found in out.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1)
    )


def ours(df, **options):
    return sorted(tuple(r) for r in collocations(df, **options).collect())


def random_rows(seed, n=60):
    r = random.Random(seed)
    words = ["a", "B", "b", "São", "SÃO", "new", "york", "x\x00y", "the"]
    rows = []
    for _ in range(n):
        parts = [r.choice(words) for _ in range(r.randint(0, 120))]
        parts += ["New York City hall of fame"] * r.randint(0, 2)
        text = "".join(w + r.choice([" ", "  ", "\t", " ", ", ", ".", "\r\n"]) for w in parts)
        rows.append((r.choice(["en", "de", None]), text))
    return rows


@pytest.mark.parametrize("chunk", [50, 1 << 20])
def test_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(module, "CHUNK_TOKENS", chunk)
    rows = random_rows(3)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    for min_count, top in ((3, 2000), (10, 4)):
        assert ours(df, min_count=min_count, top=top) == brute(rows, min_count, top)


def test_percent_inside(spark):
    rows = random_rows(4, 30)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert ours(df, min_count=4, inside_percent=60) == brute(rows, 4, 2000, 60)


def test_clashing_pairs(spark, monkeypatch):
    """A bit table too small for its pairs changes nothing."""
    monkeypatch.setattr(module, "PAIR_BITS", 15)
    rows = [("en", " ".join(f"w{(i * j) % 97}" for i in range(2000))) for j in range(1, 5)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert ours(df, min_count=20, top=50) == brute(rows, 20, 50)


def test_odd_rows(spark):
    docs = clashing(odd_documents(spark), "w1", "n", "phrase")
    rows = [(r.lang, r.text) for r in docs.collect()]
    found = ours(docs.union(docs), min_count=100)
    assert {r[0] for r in found} == {"en", "und"} and all(r[3] >= 100 for r in found)
    assert ours(docs.where("n_chars < 1000"), min_count=2) == brute([r for r in rows if len(r[1] or "") < 1000 and r[1] and not r[1].startswith("no id")] + [r for r in rows if r[1] and r[1].startswith("no id")], 2, 2000)
    assert ours(no_documents(spark)) == []
    assert ours(docs.where("text is null or trim(text) = ''")) == []


def test_products_beyond_64_bits(spark):
    """Counts whose products need more than 64 bits are compared exactly."""
    n = 3 * 10**12
    rows = [("en", "", 0, n), ("en", "a", 1, 10**12 + 1), ("en", "b", 1, 10**12 + 7), ("en", "a b", 2, 10**12 - 11)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, k int, f long")
    monkey = pytest.MonkeyPatch()
    monkey.setattr(module, "phrase_counts", lambda texts, min_count: counts)
    (row,) = ours(no_documents(spark))
    monkey.undo()
    assert row[-1] == 1000 * (10**12 - 11) * n // ((10**12 + 1) * (10**12 + 7))
