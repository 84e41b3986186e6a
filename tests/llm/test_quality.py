"""Quality rules against brute force; the classifier on held-out labels."""

import collections
import random
import re
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from odd_tables import LONG, ODD_ROWS, clashing, no_documents, odd_documents

from farebox.llm import quality_classifier, quality_rules
from farebox.llm.queries import QUERIES

SMALL, MIDDLE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = [False] * len(w)
    for i in range(len(w) - 4):
        if windows[tuple(w[i : i + 5])] > 1:
            covered[i : i + 5] = [True] * 5
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    counts = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, sum(covered))
    return (*counts, len(w) < 10 or 100 * counts[4] > 20 * len(w))


def measured(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_base_of_every_document(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op8_quality_rules"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert measured(r) == base(texts[r.doc_id])
        assert not (r.base_failed and r.kept)




def test_verdicts_against_labels(spark):
    rows = QUERIES["op8_quality_rules"](spark, MIDDLE).toPandas().merge(pd.read_parquet(f"{MIDDLE}/labels.parquet"))
    judged = rows[~rows.base_failed]
    assert judged[judged.quality == 1].kept.mean() > 0.995
    assert rows[rows.quality == 0].kept.mean() < 0.1


def test_odd_rows(spark):
    docs = clashing(odd_documents(spark), "kept", "chars", "n_words")
    rows = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert len(rows) == len(ODD_ROWS) and rows[1].extra == "mine" and "text" not in rows[1].asDict()
    texts = {i: t for i, t, *_ in ODD_ROWS}
    assert all(measured(r) == base(texts[i]) for i, r in rows.items())
    assert rows[7].base_failed and len(LONG.split()) == rows[7].n_words
    assert quality_rules.judge(no_documents(spark)).count() == 0


def test_distance():
    p = np.array([[1, 0, 0], [1, 1, 0], [0, 0, 0], [5, 5, 0]])
    d = quality_rules.distance(p, np.array([2, 2, 0]))
    assert d[1] == d[3] == 0 and 0 < d[0] < 1
    assert abs(quality_rules.distance(np.array([[0, 0, 7]]), np.array([2, 2, 0]))[0] - 1) < 1e-12


def test_short_texts_are_not_judged_by_distance(spark):
    docs = spark.createDataFrame([(1, "ZZZ!! " * 1 + "AA BB CC DD EE FF GG HH II JJ KK", "en")], "doc_id long, text string, lang string")
    row = quality_rules.judge(docs).first()
    assert row.kept and row.word_distance is None


def test_classifier_on_held_out_rows(spark):
    rows = QUERIES["op7_quality_classifier"](spark, MIDDLE).toPandas()
    assert len(rows) == 10_000 and rows.score.between(0, 1).all()
    held = rows[rows.held_out].merge(pd.read_parquet(f"{MIDDLE}/labels.parquet"))
    assert (held.predicted == held.quality).mean() > 0.99
    loss = -np.log(np.where(held.quality == 1, held.score, 1 - held.score).clip(1e-9))
    assert loss.mean() < 0.05


def test_held_out_labels_are_not_read(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    from pyspark.sql import functions as F

    wrong = labels.withColumn(
        "quality", F.when(quality_classifier.is_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    one, two = (quality_classifier.fit(docs, x) for x in (labels, wrong))
    assert all((a == b).all() for a, b in zip(one.layers, two.layers)) and one.temperature == two.temperature


def test_classifier_takes_odd_tables(spark):
    docs = clashing(odd_documents(spark), "score", "form")
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 0, 0), (5, 0, None), (7, None, 0), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int"
    )
    model = quality_classifier.fit(docs, labels)
    rows = quality_classifier.score(docs, model).collect()
    assert len(rows) == len(ODD_ROWS) and all(0 <= r.score <= 1 for r in rows)
    again = quality_classifier.fit(docs.union(docs).repartition(5), labels)
    assert np.isfinite(again.temperature)
    empty = quality_classifier.fit(no_documents(spark), labels.where("false"))
    assert quality_classifier.score(no_documents(spark), empty).count() == 0
    assert quality_classifier.score(docs, empty).select("score").distinct().count() >= 1
    few = quality_classifier.fit(docs, labels, training_rows=1)
    assert len(quality_classifier.score(docs, few).collect()) == len(ODD_ROWS)


def test_calibration_lowers_the_loss():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, quality_classifier.DIMENSIONS + 1))
    y = (x[:, 0] + rng.normal(size=400) > 0).astype(float)
    model = quality_classifier.fit_network(x[:200], y[:200], np.zeros((1, 1)))
    raw = -np.log(np.where(y[200:] > 0, model.scores(x[200:]), 1 - model.scores(x[200:]))).mean()
    quality_classifier.calibrate(model, x[200:], y[200:])
    assert -np.log(np.where(y[200:] > 0, model.scores(x[200:]), 1 - model.scores(x[200:]))).mean() <= raw


def test_classifier_tells_words_of_one_shape_apart(spark):
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    good, bad = (["".join(rng.choice(letters, 5)) for _ in range(40)] for _ in range(2))
    rows = [(i, " ".join(rng.choice((bad, good)[i % 2], 40))) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels)
    scored = quality_classifier.score(docs.where(quality_classifier.is_held_out(docs.doc_id)), model).toPandas()
    assert len(scored) > 200 and ((scored.score >= 0.5) == (scored.doc_id % 2 == 1)).mean() > 0.98
    again = quality_classifier.fit(docs.repartition(7), labels)
    assert (again.vectors.context.value == model.vectors.context.value).all() and (again.vectors.mean == model.vectors.mean).all()


ITALIAN = (
    "La mattina del mercato la piazza si riempiva di voci e di cassette di frutta, e mia nonna sceglieva "
    "con calma i pomodori più maturi. Poi andavamo insieme dal fornaio, che ogni volta ci regalava un pezzo "
    "di focaccia ancora calda. Lungo la strada incontravamo i vicini, parlavamo del tempo e dei raccolti, "
    "e tornavamo a casa quando il sole era già alto sopra i tetti. Nel pomeriggio preparava la salsa in una "
    "grande pentola, mentre io leggevo ad alta voce le storie che amava ascoltare."
)
RUSSIAN = (
    "Утром на площади открывался рынок, и бабушка долго выбирала спелые помидоры. Потом мы шли к пекарю, "
    "который каждый раз угощал нас тёплым хлебом. По дороге мы встречали соседей, говорили о погоде и об "
    "урожае, и возвращались домой, когда солнце уже поднималось высоко над крышами. Днём она варила соус в "
    "большой кастрюле, а я читал вслух рассказы, которые она любила слушать."
)


def test_no_reference_no_verdict(spark):
    """Clean prose of a language without a reference is kept; repeats in it still fail."""
    given = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    more = [(-1, ITALIAN, "it"), (-2, RUSSIAN, "ru"), (-3, "sempre la stessa riga di testo " * 30, "it"), (-4, RUSSIAN, "en")]
    docs = given.union(spark.createDataFrame(more, given.schema))
    rows = {r.doc_id: r for r in quality_rules.judge(docs).where("doc_id < 0").collect()}
    assert rows[-1].kept and rows[-2].kept and rows[-1].word_distance is None
    assert rows[-3].base_failed and not rows[-3].kept
    assert not rows[-4].kept and rows[-4].word_distance > 0.2


def test_distances_are_to_one_reference(spark):
    """Each pair of distances is that of the reference whose limits it uses up least."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    measured = quality_rules.text_measures(docs, "text", ["doc_id", "lang"]).cache()
    known = quality_rules.references(measured, "lang")
    rows = {r.doc_id: r for r in measured.collect()}
    judged = 0
    for r in quality_rules.judge(docs).where("char_distance is not null").collect():
        m, spread = rows[r.doc_id], r.n_words**-0.5
        limits = [a + b * spread for a, b in (quality_rules.CHARACTER_LIMIT, quality_rules.WORD_LIMIT)]
        pairs = [
            (quality_rules.distance(np.array([m.chars]), c)[0], quality_rules.distance(np.array([m[f"words_{x}"]]), w)[0])
            for x, (c, w) in known.items()
        ]
        used = [max(c / limits[0], w / limits[1]) for c, w in pairs]
        best = pairs[used.index(min(used))]
        assert (r.char_distance, r.word_distance) == pytest.approx(best, abs=1e-9)
        assert r.kept == (not r.base_failed and min(used) <= 1)
        judged += 1
    assert judged > 50


def test_neighbour_sums_hold_little(monkeypatch):
    """A task has no table of all buckets, and what it holds does not change the sums."""
    r = random.Random(8)
    texts = [" ".join(f"w{r.randrange(3000)}" for _ in range(r.choice([0, 1, 2, 90]))) for _ in range(700)] + [None]

    def batches():
        return quality_classifier.neighbour_sums(iter([pa.record_batch([pa.array(texts)], names=["t"])]))

    def sums():
        total = {}
        for batch in batches():
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new = np.frombuffer(packed, np.int64) if block < 0 else quality_classifier.unpack(packed)
                total[block] = total.get(block, 0) + new
        return {block: values.tolist() for block, values in total.items()}

    whole = sums()
    tracemalloc.start()
    try:
        assert sum(batch.num_rows for batch in batches()) == len(whole)
        assert tracemalloc.get_traced_memory()[1] < 90e6  # the whole table has 102
    finally:
        tracemalloc.stop()
    for held in (1, 5000):  # texts of more words, and texts that come together
        monkeypatch.setattr(quality_classifier, "HELD_WORDS", held)
        assert sums() == whole
