"""Main text of web pages: boosted trees over DOM nodes, decoded from the top down.

Every block element is scored from its subtree (text, links, density), its attribute
words, its depth, siblings and ancestors. The choice of nodes is then made for the tree as
a whole, so that no kept node lies inside a dropped one. The trees are trained on made
pages, whose number is the bound of the training sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from farebox.llm.boosted_trees import BoostedTrees, fit
from farebox.llm.html_nodes import FEATURES, Page
from farebox.llm.training_pages import training_pages

TRAINING_PAGES = 1000
BATCH_PAGES = 128


@lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES) -> BoostedTrees:
    """Node model from ``pages`` made pages; the same every time."""
    x, y = [], []
    for source in training_pages(pages):
        page = Page(source)
        x += page.features()[1:]
        y += page.marked()[1:]
    return fit(np.array(x).reshape(-1, FEATURES), np.array(y, float))


def extract(sources: list[str | None], model: BoostedTrees) -> list[str]:
    """Main text of each page; null, empty and textless pages give the empty string."""
    pages = [Page(source) for source in sources]
    lines = [page.features() for page in pages]
    scores = model.log_odds(np.array([f for page in lines for f in page]).reshape(-1, FEATURES))
    out, at = [], 0
    for page in pages:
        n = len(page.nodes)
        out.append(page.text(page.decode(scores[at : at + n].tolist())))
        at += n
    return out


def extract_text(
    pages: DataFrame, source: str = "html", keep: list[str] | None = None,
    model: BoostedTrees | None = None,
) -> DataFrame:
    """``keep`` (default: all columns) and ``text``, the main text, for every row.

    A column named ``text`` gives way to it. One pass, no shuffle.
    """
    keep = [c for c in (pages.columns if keep is None else keep) if c != "text"]
    schema = ", ".join(
        [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep] + ["text string"]
    )
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH_PAGES):
                part = batch.slice(a, BATCH_PAGES)
                texts = extract(part.column(len(keep)).to_pylist(), model)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, "text"]
                )

    return pages.select(*keep, pages[source].alias("__source")).mapInArrow(run, schema)
