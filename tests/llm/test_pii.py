"""Base spans against the patterns in Python; the learned part on planted cases."""

import random
import re
import time

from odd_tables import ODD_ROWS, clashing, no_documents, odd_documents
from pyspark.sql import functions as F

from farebox.llm import pii
from farebox.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    text, out = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    tests = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group().split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    for kind, (pattern, fits) in enumerate(tests):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if fits(m)]
    return ",".join(f"{pii.BASE[k]}:{a}:{b}" for a, k, b in sorted(out))


def base_spans(docs):
    found = pii.find_spans(docs, keep=["doc_id"])
    kept = F.filter("spans", lambda s: s["kind"].isin(pii.BASE))
    return {r.doc_id: r.x for r in found.select("doc_id", pii.spans_text(kept).alias("x")).collect()}


PARTS = [
    "1.2.3.4", "256.1.1.1", "0001.2.3.4.5.6.7.8", "a@b.c", "a@b.c@d.e.f", "x+@y.z+q@r.s", "4111 1111 1111 1111",
    "4111-1111-1111-1111", "4111--1111", "+1 (743) 555-3824", "+49 30 1234567890.", "+1 2 (.", " ", "  ", ".", "-",
    "🤖", "é", "\n", "5", "12 ", "abc@", "@x.y", "+", "(", "7,", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"',
]


def test_base_spans_of_random_texts(spark):
    r = random.Random(4)
    rows = [(i, "".join(r.choice(PARTS) for _ in range(r.randrange(12)))) for i in range(1500)]
    rows += [(9001, "1 " * 3000), (9002, "a" * 50_000 + "@"), (9003, "1." * 2000), (9004, "+1" + "(" * 5000 + "2"),
             (9005, "a@b" + ".c" * 10_000), (9006, "+1 234 567 8901" + "." * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert base_spans(docs) == {i: base(t) for i, t in rows}


def test_every_document(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op9_pii"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    import hashlib

    secrets = 0
    for r in rows:
        spans = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(re.findall(rf"\b{k}:", spans)) for k in pii.BASE]
        assert set(filter(None, spans.split(","))) <= set(r.spans.split(","))
        planted = [(m.start(1), m.end(1)) for m in re.finditer(r'token = "([0-9a-f]{40})"', texts[r.doc_id])]
        added = [s.split(":") for s in r.spans.split(",") if s.startswith(("secret", "number"))]
        assert {(int(a), int(b)) for _, a, b in added} == set(planted)
        secrets += len(planted)
    assert secrets > 5


def test_native_plan(spark):
    plan = QUERIES["op9_pii"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_odd_rows(spark):
    docs = clashing(odd_documents(spark), "spans", "left", "value")
    rows = pii.find_spans(docs).collect()
    assert len(rows) == len(ODD_ROWS) and all(r.spans == [] and r.extra == "mine" for r in rows)
    assert pii.find_spans(no_documents(spark)).count() == 0
    text = 'mail a@b.de or card 4111 1111 1111 1111 key = "0123456789abcdef0123456789abcdef"'
    few = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    out = pii.find_spans(few).collect()
    assert len(out) == 3 and len({str(r.spans) for r in out}) == 1 and len(out[0].spans) >= 2


def test_redaction(spark):
    text = "é🤖 a@b.de, 4111 1111 1111 1111 and 1.2.3.4"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "clean")], "doc_id long, text string")
    out = pii.find_spans(docs).withColumn("text", pii.redact(F.col("text"), F.col("spans"))).orderBy("doc_id").collect()
    assert [r.text for r in out] == ["é🤖 [EMAIL], [CARD] and [IP]", None, "clean"]


def test_expectation_maximisation_finds_reliabilities():
    r = random.Random(2)
    counts = {}
    for _ in range(20_000):
        truth = r.random() < 0.4
        votes = tuple((1 if truth == (r.random() < right) else -1) for right in (0.95, 0.8, 0.6))
        counts[votes] = counts.get(votes, 0) + 1
    chance, rates = pii.expectation_maximisation(counts)
    assert abs(rates[0][1, 1] - 0.95) < 0.05 and abs(rates[1][1, 1] - 0.8) < 0.05 and abs(rates[2][1, 1] - 0.6) < 0.05
    assert chance[1, 1, 1] > 0.9 and chance[-1, -1, -1] < 0.1
    assert pii.expectation_maximisation({}) == ({}, []) and pii.fit_classifier([]) == []


def brute_redaction(text, spans):
    at, parts = 0, []
    for s in spans:
        if s.start >= at:
            parts.append(text[at : s.start] + f"[{s.kind.upper()}]")
        at = max(at, s.end)
    return "".join(parts) + text[at:]


def test_redaction_by_brute_force(spark):
    r = random.Random(12)
    bits = ["ä", "a@b.co", "1.2.3.4", "+1 555 123 4567 89", "x" * 3, "9" * 12, "😀", "key = " + "0123456789abcdef" * 2]
    texts = [r.choice(["", " "]).join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = pii.find_spans(docs)
    rows = found.select("text", "spans", pii.redact(F.col("text"), F.col("spans")).alias("out")).collect()
    assert sum(len(x.spans) for x in rows) > 300
    for x in rows:
        assert x.out == brute_redaction(x.text, x.spans)


def test_running_sums_and_overlaps(spark):
    r = random.Random(5)
    for n in (0, 1, 2, 3, 10, 97, 100, 101):
        values = [r.randrange(50) for _ in range(n)]
        frame = spark.createDataFrame([(values,)], "v array<int>")
        sums, tops = frame.select(pii.running(F.col("v"), lambda a, b: a + b), pii.running(F.col("v"), lambda a, b: F.greatest(a, b))).first()
        assert sums == [sum(values[:i]) for i in range(n)]
        assert tops == [max([0, *values[:i]]) for i in range(n)]
        spans, at = [], 0
        for _ in range(n):
            begin = at + r.randrange(4)
            at = begin + 1 + r.randrange(5)
            spans.append((begin, at))
        asked = [(a, a + 1 + r.randrange(6)) for a in range(-3, at + 4)]
        frame = spark.createDataFrame([(spans, asked)], "b array<struct<start:int,end:int>>, q array<struct<start:int,end:int>>")
        got = frame.select(F.transform("q", lambda s: pii.meets(F.col("b"), s))).first()[0]
        assert got == [any(b < e2 and s2 < e for b, e in spans) for s2, e2 in asked]


def test_many_spans_in_one_text(spark):
    """A hundred thousand addresses and numbers in one text: no step is quadratic in them."""
    n = 50_000
    text = " ".join(f"a{i}@b.co, 555-{i % 900 + 100}-1234" for i in range(n))
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    begun = time.monotonic()
    found = pii.find_spans(docs, keep=["doc_id", "text"])
    rows = found.select("spans", pii.redact(F.col("text"), F.col("spans")).alias("out")).orderBy("doc_id").collect()
    assert time.monotonic() - begun < 120
    assert sum(s.kind == "email" for s in rows[0].spans) == n
    assert rows[0].out == brute_redaction(text, rows[0].spans)
