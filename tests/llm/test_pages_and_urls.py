"""Main text of pages, and URL lists in time."""

import datetime

import numpy as np
import pytest

from farebox.llm import url_filter
from farebox.llm.boosted_trees import fit
from farebox.llm.html_extraction import extract, extract_text, trained
from farebox.llm.html_nodes import MARK, Page
from farebox.llm.queries import QUERIES
from farebox.llm.training_pages import training_pages

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    return trained(300)


def test_trees_learn_and_predict():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = fit(x[:1500], y[:1500], trees=30, depth=3)
    assert ((model.log_odds(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.97
    assert len(model.log_odds(np.zeros((0, 5)))) == 0


def test_held_out_pages(model):
    right = total = 0
    for source in training_pages(120, seed=5):
        page = Page(source)
        kept = page.decode(model.log_odds(np.array(page.features())).tolist())
        truth = page.marked()
        right += sum(a == b for a, b in zip(kept[1:], truth[1:]))
        total += len(kept) - 1
    assert right / total > 0.98


def test_no_kept_node_in_a_dropped_one():
    page = Page("<div><p>a</p><div><p>b</p><p>c</p></div></div><div><p>d</p></div>")
    kept = page.decode([0.0, 1.0, 2.0, -9.0, 1.0, 1.0, -1.0, 0.5])
    assert kept == [True, True, True, False, False, False, False, False]
    rng = np.random.default_rng(2)
    for _ in range(50):
        kept = page.decode(rng.normal(size=len(page.nodes)).tolist())
        assert all(kept[n.parent] for n, k in zip(page.nodes[1:], kept[1:]) if k)


def test_page_text(model):
    source = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"
        "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>About us</a></li></ul></nav>"
        '<div class="ad">Buy this now. It is very good for you.</div><article><h1>The &amp; title</h1>'
        "<p><b>First  part\n of the text.<br><p>Second&nbsp;part, with an <em>in</em>line word.</p></article>"
        "<div class='comments'><p>I do not agree with this.</p></div><footer>&copy; someone</footer></body></html>"
    )
    assert extract([source], model) == ["The & title First part of the text. Second part, with an inline word."]


def test_broken_pages(model):
    deep = "<div>" * 3000 + "text" + "</p>" * 3000
    cases = [None, "", "   ", "<", "<p", "</div></div>", "<!-- never closed", "<script>x", "&am", deep, "<p>a" * 2000,
             "<a href=\"x>y", "<article><p>One two three four five.</p><p cla"]
    texts = extract(cases, model)
    assert texts[:3] == ["", "", ""] and len(texts) == len(cases)
    assert all(isinstance(t, str) for t in texts) and MARK not in "".join(texts)


def all_text(source):
    page = Page(source)
    return page.text([True] * len(page.nodes))


@pytest.mark.parametrize("source, text", [
    ("<html><head><title>x</title><body><p>text", "text"),
    ("<head><meta charset=u><title>x</title><p>text</p> more", "text more"),
    ("<head><noscript><style>p{}</style></head><body><p>text", "text"),
    ("<div><select><option>a</div><p>text", "text"),
    ("<select><option>a<p>text", "text"),
    ("<div><svg><path d='M0'></div><p>text", "text"),
    ("<svg><path d='M0'><p>text", "text"),
    ("<div><object data=x><p>one</p></div><p>text", "one text"),
    ("<template><p>text", "text"),
    ("<div><noscript><noscript><img src=x></div><p>text", "text"),
    ("a<svg><title>t</title><foreignObject><body><p>no</p></body></foreignObject></svg>b", "ab"),
    ("<div>a<template><div>no</div><script>'</template></div>'</script></template>b</div>", "ab"),
    (f"""<p data-x="{'{' * 9}>{'y' * 20_000}>">text</p>""", "text"),
    ("<p title='a > b' data-y='\"'>text <a title='>'>more</a></p>", "text more"),
    ("<p title=5\">text</p><p title=\"x>more", "text more"),
])
def test_missing_end_tags_and_quoted_marks(source, text):
    assert all_text(source) == text


def test_unclosed_elements_take_linear_time():
    for source in ("<object>" * 40_000, "<div><noscript>" * 20_000 + "</div>" * 20_000, "<a b=\"'>" * 40_001):
        assert isinstance(all_text(source), str)


def test_every_page_of_the_table(spark):
    rows = {r.page_id: r for r in QUERIES["op1_html_extraction"](spark, SMALL).collect()}
    for page in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        # in these pages all text of the article element, and no other, is the main text
        inner = page.html.split("<article>")[1].split("</article>")[0]
        inner = inner[: inner.rindex("<")] if inner.rfind("<") > inner.rfind(">") else inner
        words = " ".join(Page(inner).text([True] * 10_000).split())
        assert rows[page.page_id].text == words and rows[page.page_id].n_chars == len(words)


def test_page_tables(spark, model):
    docs = spark.createDataFrame([(1, None, "mine"), (1, "", "mine"), (None, "<p>x</p>", "mine")],
                                 "page_id long, html string, text string")
    out = extract_text(docs, model=model)
    assert out.columns == ["page_id", "html", "text"] and out.count() == 3
    assert extract_text(docs.where("false"), model=model).count() == 0


def day(text):
    return datetime.date.fromisoformat(text)


def test_lists_in_time(spark):
    entries = spark.createDataFrame(
        [("Bad.example", day("2024-01-10"), "block"), ("bad.example", day("2024-02-10"), "remove"),
         ("ok.bad.example", day("2024-01-15"), "allow"), ("bad.example", day("2024-01-10"), "allow"),
         ("host.org/x", day("2024-01-01"), "block"), (None, day("2024-01-01"), "block"),
         ("bad.example", None, "block"), ("bad.example", day("2024-01-11"), "nonsense")],
        "key string, listed_on date, action string",
    )
    captures = spark.createDataFrame(
        [("http://bad.example/a", day("2024-01-09")), ("http://bad.example/a", day("2024-01-10")),
         ("https://u:p@Sub.Bad.Example.:80/a?b", day("2024-01-20")), ("http://ok.bad.example/", day("2024-01-20")),
         ("http://ok.bad.example/", day("2024-01-12")), ("http://bad.example/a", day("2024-02-10")),
         ("http://host.org/x/y", day("2024-05-01")), ("http://host.org/z", day("2024-05-01")),
         (None, day("2024-01-20")), ("not a url", day("2024-01-20")), ("http://bad.example/", None)],
        "url string, fetched_on date",
    ).selectExpr("*", "'mine' as key", "'mine' as kept")
    out = url_filter.filter_captures(captures, entries)
    kept = [(r.url, str(r.fetched_on), r.kept) for r in out.collect()]
    blocked = {(u, d) for u, d, k in kept if not k}
    assert blocked == {
        ("http://bad.example/a", "2024-01-10"), ("https://u:p@Sub.Bad.Example.:80/a?b", "2024-01-20"),
        ("http://ok.bad.example/", "2024-01-12"), ("http://host.org/x/y", "2024-05-01"),
    }
    assert len(kept) == 11 and "key" in out.columns
    twice = url_filter.filter_captures(captures.union(captures), entries)
    assert twice.count() == 22 and twice.where("NOT kept").count() == 8
    assert url_filter.filter_captures(captures.where("false"), entries).count() == 0
    assert url_filter.filter_captures(captures, entries.where("false")).where("NOT kept").count() == 0
