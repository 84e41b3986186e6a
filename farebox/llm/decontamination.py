"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and runs of white space become one space. A test item of ``m``
characters may occur in a document with up to ``k = floor(rate * m)`` edits (insertions,
deletions, substitutions). Cut into ``k + 1`` pieces, at least one piece must then occur
unchanged. All pieces of a block of items form one automaton; every document is scanned
once, and around each piece hit the item is verified by Myers' bit-parallel distance.

An item too short for an edit (under 20 characters at a rate of 0.05) is searched as it is,
with word boundaries on both sides; scripts that are written without spaces have a boundary
at every character. All other items have their own budget, whatever their length.

Items are processed in blocks of bounded size, each held against all documents, so memory
does not grow with the benchmark.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from farebox.llm.tables import text_last

EDIT_RATE = 0.05
MIN_CHARS = 30
BLOCK_CHARS = 1_000_000
# Thai, Lao, Burmese, Khmer, and Han with kana.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\ua4cf\uf900-\ufaff\U00020000-\U0003ffff]")
HITS = "item_id long, distance int, match_start int, match_end int"


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of ``budget + 1`` pieces of nearly equal length."""
    edges = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


def best_match(item: str, masks: dict[str, int], text: str) -> tuple[int, int]:
    """(least edits, end of the first such place) of ``item`` anywhere in ``text``.

    Myers' algorithm: vertical differences of the distance table are bits of two integers,
    and one column is one step. Row 0 is all zeros, so a match may start anywhere.
    """
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, where = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | down
        d = (((eq & up) + up) ^ up) | eq
        h_up, h_down = (down | ~(d | up)) & full, up & d
        score += bool(h_up & top) - bool(h_down & top)
        h_up, h_down = (h_up << 1) & full, (h_down << 1) & full
        up, down = (h_down | ~(x | h_up)) & full, h_up & x
        if score < best:
            best, where = score, j + 1
    return best, where


def bits(item: str) -> dict[str, int]:
    """For each character the places where it stands in ``item``."""
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def boundary(left: str, right: str) -> bool:
    """Whether a word may end between two characters (empty: the end of the text)."""
    for c in (left, right):
        if not (c.isalnum() or c == "_" or c and unicodedata.combining(c)) or _UNSPACED.match(c):
            return True
    return False


class Block:
    """A bounded set of items, searched together; those without budget between word
    boundaries."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = items
        self.budgets = [int(rate * len(text)) for _, text in items]
        self.masks = [bits(text) for _, text in items]
        self.mirrors = [bits(text[::-1]) for _, text in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text) in enumerate(items):
            for offset, piece in pieces(text, self.budgets[i]):
                where.setdefault(piece, []).append((i, offset))
        self.machine = ahocorasick.Automaton()
        for piece, places in where.items():
            self.machine.add_word(piece, (len(piece), places))
        if where:
            self.machine.make_automaton()
        self.empty = not where

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, edits, start, end) of the best match of every item within its budget."""
        if self.empty or not text:
            return []
        starts: dict[int, set[int]] = {}
        for end, (length, places) in self.machine.iter(text):
            for i, offset in places:
                starts.setdefault(i, set()).add(end + 1 - length - offset)
        found = []
        for i, at in starts.items():
            item_id, item = self.items[i]
            budget, m = self.budgets[i], len(item)
            if not budget:
                whole = [
                    s for s in at
                    if boundary(text[s - 1 : s] if s else "", item[0]) and boundary(item[-1], text[s + m : s + m + 1])
                ]
                if whole:
                    found.append((item_id, 0, min(whole), min(whole) + m))
                continue
            best: tuple[int, int, int] | None = None
            low = high = None
            for s in [*sorted(at), None]:
                # starts closer than the budget share one window, so no text is read twice
                if s is not None and high is not None and s - budget <= high:
                    high = s + m + budget
                    continue
                if high is not None:
                    a = max(low, 0)
                    edits, end = best_match(item, self.masks[i], text[a:high])
                    if edits <= budget and (best is None or edits < best[0]):
                        best = edits, a, a + end
                if s is not None:
                    low, high = s - budget, s + m + budget
            if best:
                edits, a, end = best
                a = max(a, end - m - budget)
                _, back = best_match(item[::-1], self.mirrors[i], text[a:end][::-1])
                found.append((item_id, edits, end - back, end))
        return found


def item_blocks(
    items: DataFrame, min_chars: int, block_chars: int, short_items: bool
) -> Iterator[list[tuple[int, str]]]:
    """Ids and normalised texts of at most ``block_chars`` characters (or one item), streamed
    to the driver; they stay in the plan, one stage a block."""
    block: list[tuple[int, str]] = []
    size = 0
    for row in items.select("item_id", "text").where("text IS NOT NULL").orderBy("item_id").toLocalIterator():
        text = normalise(row["text"])
        if not text or (len(text) < min_chars and not short_items):
            continue
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append((row["item_id"], text))
        size += len(text)
    if block:
        yield block


def find_leaks(
    docs: DataFrame, items: DataFrame, text: str = "text", keep: list[str] | None = None,
    rate: float = EDIT_RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS,
    short_items: bool = True,
) -> DataFrame:
    """One row for each pair of a document row and an item that occurs in it.

    ``keep`` (default: all columns) of the document, ``item_id``, ``distance`` (edits of
    the best place, the first on ties) and its ``match_start`` and ``match_end`` in the
    normalised text. Null and empty texts match nothing; without
    ``short_items``, items under ``min_chars`` normalised characters are left out. Repeated
    rows give repeated results. Columns named like a result give way to it.
    """
    results = [part.split(" ")[0] for part in HITS.split(", ")]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in results]
    source, at = text_last(docs, text, keep)
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    schema = ", ".join([*kinds, HITS])
    out = docs.sparkSession.createDataFrame([], schema)
    first = True
    for block in item_blocks(items, min_chars, block_chars, short_items):
        found = source.mapInArrow(_searcher(block, rate, keep, at), schema)
        out, first = (found if first else out.unionByName(found)), False
    return out


def _searcher(items: list[tuple[int, str]], rate: float, keep: list[str], at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(items, rate)
        for batch in batches:
            rows, hits = [], []
            for i, value in enumerate(batch.column(at)):
                for hit in block.matches(normalise(value.as_py())):
                    rows.append(i)
                    hits.append(hit)
            columns = list(zip(*hits)) if hits else [()] * 4
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            chosen = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(j).take(chosen) for j in range(len(keep))]
                + [pa.array(c, t) for c, t in zip(columns, types)],
                names=[*keep, "item_id", "distance", "match_start", "match_end"],
            )

    return run


def without_leaks(
    docs: DataFrame, items: DataFrame, text: str = "text", rate: float = EDIT_RATE,
    min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS, short_items: bool = True,
) -> DataFrame:
    """The rows of ``docs`` in which no item occurs, all columns, one pass per block."""
    out = docs
    for block in item_blocks(items, min_chars, block_chars, short_items):
        out = out.mapInArrow(_dropper(block, rate, out.columns.index(text)), out.schema)
    return out


def _dropper(items: list[tuple[int, str]], rate: float, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(items, rate)
        for batch in batches:
            clean = [not block.matches(normalise(v.as_py())) for v in batch.column(column)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run
