"""Ranked lexical search by branch and bound over document FP-trees.

The queries' terms are looked for in every document. A document's vector, restricted to
these terms and ordered from the most to the least frequent, is a path; documents that start
with the same terms share the start of their path in a prefix tree. The vectors are
range-partitioned by path, so that neighbours share much of it, and a task builds trees of
at most ``TREE_DOCS`` documents. A node knows for all documents below it the largest
frequency of each term and the smallest length part ``m``; both bound every score below it.
For each item the tree is walked depth first, best bound first, and a subtree whose bound
is under the item's worst kept score is left out. No document is left out otherwise.

Items are taken in blocks of about ``BLOCK_CHARS`` characters, so that the terms that a task
holds, and the driver sees, are bounded whatever the number of items.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farebox.staging import stage

BLOCK_CHARS = 1_000_000
TREE_DOCS, TREE_ENTRIES = 4096, 1 << 21  # a tree has no more documents and term entries
LEAF_DOCS = 32
NODE_CELLS = 1 << 21  # nodes times terms of one tree
MERGE_SALTS = 64
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
NO_ID = 1 << 63  # rows without id come after all others


def terms_of(text: str) -> list[bytes]:
    """Maximal runs of digits, letters and code points above 127, A-Z in lower case."""
    return _TERM.findall(text.encode("utf-8").translate(_LOWER))


def weight(documents: int, holding: int) -> int:
    """Weight of a term that ``holding`` of the documents hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def length_part(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    return 100 - 25 + (25 * n * documents) // max(total, 1)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Part of a score that one term gives, before its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


@dataclass
class Query:
    row: int  # number of the item row
    terms: np.ndarray  # ranks
    weights: np.ndarray  # weight times repeats


class Tree:
    """Prefix tree over paths in order; a node is a range of documents."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, paths: list[np.ndarray], tfs: list[np.ndarray], terms: int):
        self.ids, self.paths = ids, paths
        self.edges = np.concatenate([[0], np.cumsum([len(p) for p in paths])]).astype(np.int64)
        self.term, tf = np.concatenate(paths).astype(np.int64), np.concatenate(tfs).astype(np.int64)
        self.impact = impact(tf, np.repeat(m, np.diff(self.edges)))
        self.leaf_docs = max(LEAF_DOCS, math.ceil(4 * len(paths) * terms / NODE_CELLS))
        self.nodes = [(0, len(paths), 0)]  # first document, last, terms they share
        self.children: list[list[int]] = []
        while len(self.children) < len(self.nodes):  # parents come before their children
            parts = self.parts(*self.nodes[len(self.children)])
            self.children.append(list(range(len(self.nodes), len(self.nodes) + len(parts))))
            self.nodes += parts
        most = np.zeros((len(self.nodes), terms), np.int64)  # largest tf below each node
        least = np.zeros(len(self.nodes), np.int64)  # smallest m below each node
        for node in range(len(self.nodes) - 1, -1, -1):
            a, b, _ = self.nodes[node]
            if children := self.children[node]:
                most[node], least[node] = most[children].max(axis=0), least[children].min()
            else:
                x, y = self.edges[a], self.edges[b]
                np.maximum.at(most[node], self.term[x:y], tf[x:y])
                least[node] = m[a:b].min()
        self.bound = impact(most, least[:, None])

    def parts(self, a: int, b: int, depth: int) -> list[tuple[int, int, int]]:
        """The nodes right below that of documents ``a`` to ``b``; none below a leaf."""
        if b - a <= self.leaf_docs:
            return []
        first, last = self.paths[a], self.paths[b - 1]
        n = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:n] != last[depth:n])
        depth = depth + int(differ[0]) if len(differ) else n  # paths are in order
        here = np.array([p[depth] if len(p) > depth else -1 for p in self.paths[a:b]], np.int64)
        cuts = [a, *(a + 1 + np.flatnonzero(np.diff(here))).tolist(), b]
        if len(cuts) == 2:  # equal paths
            cuts = [*range(a, b, self.leaf_docs), b]
        groups: list[tuple[int, int, int]] = []
        for x, y in zip(cuts, cuts[1:]):  # small neighbours stay together, up to a leaf
            if groups and y - groups[-1][0] <= self.leaf_docs:
                groups[-1] = (groups[-1][0], y, depth)
            else:
                groups.append((x, y, depth))
        return groups

    def search(self, query: Query, best: list[tuple[int, int]], top: int, slot: np.ndarray) -> None:
        """Put the documents that belong there into ``best``, a heap of (score, -id)."""
        slot[query.terms] = query.weights
        bounds = lambda nodes: self.bound[np.ix_(nodes, query.terms)] @ query.weights
        stack = [(int(bounds([0])[0]), 0)]
        while stack:
            bound, node = stack.pop()
            if bound <= 0 or (len(best) == top and bound < best[0][0]):
                continue
            a, b, _ = self.nodes[node]
            if children := self.children[node]:
                reach = bounds(children)
                order = np.argsort(reach, kind="stable")  # the best is taken up first
                stack += [(int(reach[i]), children[i]) for i in order]
                continue
            x, y = self.edges[a], self.edges[b]
            sums = np.concatenate([[0], np.cumsum(slot[self.term[x:y]] * self.impact[x:y])])
            scores = np.diff(sums[self.edges[a : b + 1] - x])
            worst = best[0][0] if len(best) == top else 1
            for i in np.flatnonzero(scores >= max(worst, 1)):
                found = (int(scores[i]), -int(self.ids[a + i]))
                if len(best) < top:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
        slot[query.terms] = 0


def vectors(docs: DataFrame, text: str, doc_id: str, vocabulary: list[bytes]) -> DataFrame:
    """``id``, ``n`` terms, and the numbers and frequencies of those in the vocabulary."""
    number = {term: i for i, term in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, found, tfs, edges = [], [], [], [0]
            for value in batch.column(1):
                terms = terms_of(value.as_py() or "")
                lengths.append(len(terms))
                for term, tf in Counter(terms).items():
                    i = number.get(term)
                    if i is not None:
                        found.append(i)
                        tfs.append(tf)
                edges.append(len(found))
            edges = pa.array(edges, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()),
                 pa.ListArray.from_arrays(edges, pa.array(found, pa.int32())),
                 pa.ListArray.from_arrays(edges, pa.array(tfs, pa.int64()))],
                names=["id", "n", "terms", "tfs"],
            )

    slim = docs.select(docs[doc_id].cast("long").alias("id"), docs[text].alias("text"))
    return slim.mapInArrow(run, "id long, n long, terms array<int>, tfs array<bigint>")


def ordered(found: DataFrame, rank: np.ndarray, documents: int, total: int) -> DataFrame:
    """``id``, ``m``, and the path: ranks of the terms in order with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, tfs = batch.column(2), batch.column(3)
            size = terms.value_lengths().to_numpy(zero_copy_only=False)
            ranks = rank[terms.flatten().to_numpy(zero_copy_only=False)]
            order = np.lexsort([ranks, np.repeat(np.arange(len(size)), size)])
            edges = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
            m = length_part(batch.column(1).to_numpy(zero_copy_only=False), documents, total)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(m),
                 pa.ListArray.from_arrays(edges, pa.array(ranks[order].astype(np.int32))),
                 pa.ListArray.from_arrays(edges, tfs.flatten().take(pa.array(order)))],
                names=["id", "m", "path", "tfs"],
            )

    some = found.where(F.size("terms") > 0)
    return some.mapInArrow(run, "id long, m long, path array<int>, tfs array<bigint>")


def search_trees(paths: DataFrame, queries: list[Query], terms: int, top: int) -> DataFrame:
    """``item``, ``id``, ``score``: the best ``top`` documents of every task for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in queries]
        slot = np.zeros(terms, np.int64)
        rows: list[tuple] = []
        entries = 0

        def flush() -> None:
            ids, m, path, tfs = zip(*rows)
            tree = Tree(np.array(ids, object), np.array(m, np.int64), list(path), list(tfs), terms)
            for query, heap in zip(queries, best):
                tree.search(query, heap, top, slot)
            rows.clear()

        for batch in batches:
            ids, ms = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            path, tfs = batch.column(2), batch.column(3)
            for i, (doc, m) in enumerate(zip(ids, ms)):
                p = path[i].values.to_numpy(zero_copy_only=False)
                rows.append((NO_ID if doc is None else doc, m, p, tfs[i].values.to_numpy(zero_copy_only=False)))
                entries += len(p)
                if len(rows) >= TREE_DOCS or entries >= TREE_ENTRIES:
                    flush()
                    entries = 0
        if rows:
            flush()
        for query, heap in zip(queries, best):
            ids = [None if -doc == NO_ID else -doc for _, doc in heap]
            columns = [[query.row] * len(heap), ids, [score for score, _ in heap]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=["item", "id", "score"]
            )

    spread = F.xxhash64("id")  # equal paths are dealt out as well
    near = paths.repartitionByRange("path", spread).sortWithinPartitions("path", spread)
    return near.mapInArrow(run, "item long, id long, score long")


def item_blocks(items: DataFrame, item_id: str, text: str) -> tuple[DataFrame, int]:
    """Item rows with a number and a block, written; and the number of blocks."""
    rows = items.select(items[item_id].alias("item_id"), items[text].alias("text"))
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "items")
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = chars // BLOCK_CHARS + 1
    return rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))), blocks


def search(
    docs: DataFrame, items: DataFrame, top: int = 20, text: str = "text", doc_id: str = "doc_id",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``top`` best documents of every item.

    A term weighs ``floor(1000 ln((2N+2)/(2df+1)))`` with ``N`` documents that have terms,
    ``df`` of them with this one. Of ``tf`` occurrences it gives its weight times
    ``10^9 tf div (1000 tf + 12 m)`` for each time the item has it, with ``m`` 75 plus 25
    times the document's length over the mean. Documents of score 0 are left out, equal
    scores go by id, rows without id last.

    Null texts have no terms; items without terms, and terms that no document holds, give
    nothing. Every row of ``docs`` is a document and every row of ``items`` an item of its
    own, repeated or not. Other columns are not read. Ids of documents are whole numbers.
    """
    rows, blocks = item_blocks(items, item_id, item_text)
    results, sizes = None, None
    for block in range(blocks):
        wanted = [(r["row"], Counter(terms_of(r["text"] or ""))) for r in rows.where(F.col("block") == block).collect()]
        vocabulary = sorted(set().union(*(terms for _, terms in wanted)))
        if not vocabulary and sizes is not None:
            continue
        found = stage(vectors(docs, text, doc_id, vocabulary), "vectors")
        if sizes is None:  # the same in every block
            sizes = found.where("n > 0").agg(F.count("*"), F.sum("n")).first()
        documents, total = sizes[0], sizes[1] or 0
        df = np.zeros(len(vocabulary), np.int64)
        for term, n in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[term] = n  # one row a term of the block
        rank = np.empty(len(vocabulary), np.int64)
        rank[np.lexsort([np.arange(len(df)), -df])] = np.arange(len(df))
        number = {term: i for i, term in enumerate(vocabulary)}
        queries = []
        for row, terms in wanted:
            known = [(rank[number[t]], n * weight(documents, df[number[t]])) for t, n in terms.items() if df[number[t]]]
            known = [pair for pair in known if pair[1] > 0]
            if known:
                at, weights = zip(*known)
                queries.append(Query(row, np.array(at, np.int64), np.array(weights, np.int64)))
        paths = ordered(found, rank, documents, total)
        part = stage(search_trees(paths, queries, len(vocabulary), top), "found")
        results = part if results is None else results.unionByName(part)
    order = [F.desc("score"), F.asc_nulls_last("id")]
    few = Window.partitionBy("item", F.pmod(F.xxhash64("id"), F.lit(MERGE_SALTS))).orderBy(*order)
    first = results.withColumn("rank", F.row_number().over(few)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    return (
        ranked.where(F.col("rank") <= top).join(rows.select("row", "item_id"), F.col("item") == F.col("row"))
        .select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")
    )


ORACLE_SQL = r"""
WITH tokens AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
sizes AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id),
whole AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_all FROM sizes),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
wanted AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL),
postings AS (
  SELECT doc_id, term, count(*) AS tf FROM tokens WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), whole),
parts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_all))) AS part
  FROM postings JOIN weights USING (term) JOIN sizes USING (doc_id), whole),
scores AS (
  SELECT item_id, doc_id, CAST(sum(times * part) AS BIGINT) AS score
  FROM wanted JOIN parts USING (term) GROUP BY ALL HAVING sum(times * part) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
       doc_id, score
FROM scores QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""
