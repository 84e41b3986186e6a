"""Each stage on its predecessor's rows, against brute force."""

import pandas as pd
from odd_tables import ODD_ROWS, clashing, no_documents, odd_documents
from test_jaccard_join import brute

import corpus_pipeline
from farebox.llm.decontamination import normalise
from farebox.staging import stage

FOLDER = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, {}
    steps = {}
    for name, step in corpus_pipeline.STAGES:
        before = docs
        docs = stage(step(spark, docs, FOLDER), "test")
        steps[name] = (before, docs)
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    labels = pd.read_parquet(f"{FOLDER}/labels.parquet").set_index("doc_id").quality
    right = [(i in kept[names[0]]) == (label == 1) for i, label in labels.items()]
    assert sum(right) / len(right) > 0.98

    before = {r.doc_id: r.text for r in steps[names[1]][0].collect()}
    component = brute(list(before.items()), 5, 80)
    assert kept[names[1]] == {c for _, c in component.values()}

    items = [normalise(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    texts = {r.doc_id: normalise(r.text) for r in steps[names[2]][0].collect()}
    assert kept[names[2]] == {i for i, t in texts.items() if not any(x in t for x in items)}

    assert kept[names[3]] == kept[names[2]] == kept[names[4]]
    for r in steps[names[3]][1].collect():
        assert "@mail" not in r.text and r.n_chars == len(r.text)
    assert corpus_pipeline.run(spark, FOLDER).count() == len(kept[names[4]])
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_take_odd_tables(spark):
    docs = clashing(odd_documents(spark), "score", "spans", "ids", "id")
    docs = docs.union(docs)
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, FOLDER)
        assert out.count() <= 2 * len(ODD_ROWS) and set(docs.columns) <= set(out.columns)
        assert step(spark, no_documents(spark), FOLDER).count() == 0
    left = corpus_pipeline.near_duplicates(spark, docs, FOLDER)
    assert sorted(r.doc_id for r in left.where("doc_id IS NOT NULL").collect()) == [1, 2, 3, 4, 5, 7, 9, 11, 12]


def test_near_duplicates_by_row(spark):
    x, y, z = ("".join(f"{c}{i} " for i in range(30)) for c in "xyz")
    rows = [(3, x), (5, x), (5, y), (None, y), (None, z), (None, z + "end"), (6, None), (6, None), (6, ""), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()]
    assert sorted((r for r in left if r[0]), key=str) == [(3, x), (5, y), (6, ""), (6, None)]
    others = [t for i, t in left if i is None]
    assert len(others) == 3 and others.count(None) == 2 and next(filter(None, others)) in (z, z + "end")
