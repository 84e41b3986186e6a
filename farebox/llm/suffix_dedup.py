"""Removal of long byte strings that also start earlier in the corpus.

Every byte that lies in a string of ``length`` bytes (a window) which also starts earlier
(in a smaller document, or earlier in the same one) is removed. Windows are never compared
by all pairs and never shipped one by one:

1. Every window has an anchor, the ``GRAM``-byte string with the smallest hash inside it.
   Equal windows have equal anchors at equal places. Neighbouring windows share an anchor;
   such a run of windows with the bytes it covers is a region.
2. Regions meet by anchor. An anchor that occurs once proves its windows unique. Of equal
   regions the first one stays and the others are covered from end to end.
3. Where one anchor has different regions, the bytes of each region's first place are
   compared: windows whose hash is alone in their group are unique and fall away, and the
   suffix array of what is left, built by linear grouping, brings equal windows together.
   The earliest of each set of equal windows stays, the others are covered.
   An anchor of very many regions would make one group too large for a task: its windows
   meet by a digest of 128 bits each instead, in groups that a batch has cut to one row.
4. Covered bytes are merged by document and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farebox.llm.suffix_array import suffix_array
from farebox.llm.text_arrays import Hasher, mix, slices
from farebox.staging import stage

LENGTH, GRAM = 100, 32
BATCH_BYTES, HASH_BYTES = 1 << 17, 1 << 18
CROWD_ROWS = 1000
WINDOW = -1
RESULTS = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def window_anchors(grams: np.ndarray, reach: int) -> np.ndarray:
    """For each window of ``reach`` grams the place of its smallest gram, leftmost on ties.

    Minima of fixed blocks from the left and from the right give every window's minimum.
    """
    n = len(grams)
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // reach) * reach, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, reach)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    smallest = np.minimum(right[: n - reach + 1], left[reach - 1 : n])
    return (smallest & np.uint64(0xFFFFFFFF)).astype(np.int64)


def regions(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor, region, first window, last window, anchor's place) of one document's bytes."""
    if len(data) < length:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty
    hasher = Hasher(data)
    starts = np.arange(len(data) - GRAM + 1)
    grams = hasher(starts, starts + GRAM)
    at = window_anchors(grams, length - GRAM + 1)
    edges = np.flatnonzero(np.diff(at)) + 1
    low = np.concatenate([[0], edges])
    high = np.concatenate([edges, [len(at)]]) - 1
    place = at[low]
    covered = hasher(low, high + length)
    # where the anchor lies in the region and how long the region is count as well
    shape = ((place - low) * 65536 + high - low).astype(np.uint64)
    region = mix(covered + mix(shape + np.uint64(1)))
    return grams[place].view(np.int64), region.view(np.int64), low, high, place


def document_key(doc_id: Column) -> Column:
    """A null id comes before all others."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(2**63)))


def find_regions(docs: DataFrame, length: int) -> DataFrame:
    """All regions. ``again`` marks those that a batch has earlier in the order of documents.

    Such a region is covered whatever other batches hold, so it need not meet the others:
    in place of its anchor it gets a number of its own, which spreads a frequent anchor's
    rows over all tasks.
    """
    schema = "anchor long, region long, id long, copy long, low int, high int, place int, again boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found: list[list[np.ndarray]] = [[] for _ in range(7)]
            for first, data, offsets in slices(batch.column(2)):
                for r in range(len(offsets) - 1):
                    anchor, region, *places = regions(data[offsets[r] : offsets[r + 1]], length)
                    size = len(anchor)
                    row = (anchor, region, np.full(size, ids[first + r]), np.full(size, copies[first + r]),
                           *(p.astype(np.int32) for p in places))
                    for column, values in zip(found, row):
                        column.append(values)
            if not found[0]:
                continue
            anchor, region, id_, copy, low, high, place = (np.concatenate(c) for c in found)
            order = np.lexsort((low, copy, id_, region, anchor))
            again = np.zeros(len(order), bool)
            a, r = anchor[order], region[order]
            # rows of one document that are there twice are one place, not an earlier one
            i, c, p = id_[order], copy[order], low[order]
            same = (a[1:] == a[:-1]) & (r[1:] == r[:-1])
            new_place = (i[1:] != i[:-1]) | (c[1:] != c[:-1]) | (p[1:] != p[:-1])
            start = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(order)), 0))
            moved = np.concatenate([[False], new_place])
            later = np.cumsum(moved) > np.cumsum(moved)[start]
            again[order] = later
            own = mix(mix(id_.view(np.uint64)) + low.astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v) for v in (np.where(again, own, anchor), region, id_, copy, low, high, place, again)],
                names=["anchor", "region", "id", "copy", "low", "high", "place", "again"],
            )

    return docs.select("id", "copy", "__text").mapInArrow(run, schema)


def unique_windows_removed(
    pieces: list[tuple], length: int, anchors: list[int] | None = None
) -> list[tuple[int, int, int]]:
    """(piece, first window, last window) of runs whose hash others of the group share.

    ``pieces``: (order key, low, place, bytes), of one anchor or each with its own in
    ``anchors``. A window's hash counts with its distance from the anchor. The pieces are
    short, so those of many anchors are hashed at once.
    """
    sizes = np.array([len(p[3]) for p in pieces], np.int64)
    windows = np.maximum(sizes - length + 1, 0)
    who = np.repeat(np.arange(len(pieces)), windows)
    at = np.arange(len(who)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = np.repeat(np.cumsum(sizes) - sizes, windows) + at
    shift = at + np.array([p[1] - p[2] + 65536 for p in pieces], np.int64)[who]
    salt = mix(shift.astype(np.uint64))
    if anchors is not None:
        salt = mix(salt + np.array(anchors, np.int64).view(np.uint64)[who])
    hashes = mix(Hasher(np.frombuffer(b"".join(p[3] for p in pieces), np.uint8))(starts, starts + length) + salt)
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    keep = np.zeros(len(hashes), bool)
    keep[order[1:][same]] = keep[order[:-1][same]] = True
    who, at = who[keep], at[keep]
    if not len(who):
        return []
    breaks = np.flatnonzero((np.diff(who) != 0) | (np.diff(at) != 1)) + 1
    firsts, lasts = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(who)]]) - 1
    return list(zip(who[firsts].tolist(), at[firsts].tolist(), at[lasts].tolist()))


def later_windows(pieces: list[tuple[tuple[int, int, int], bytes]], length: int) -> list[tuple[int, int, int]]:
    """(piece, first window, last window) of the runs of windows that start earlier as well.

    ``pieces``: ((id, copy, start), bytes), distinct. The suffix array of all pieces in a
    row brings equal windows side by side.
    """
    pieces_at, total = [], 0
    for _, data in pieces:
        pieces_at.append(total)
        total += len(data) + 1
    text = b"\0".join(data for _, data in pieces) + b"\0"
    order = np.array(suffix_array(text))
    begins = np.array(pieces_at)
    ends = begins + np.array([len(data) for _, data in pieces])
    who = np.searchsorted(begins, order, "right") - 1
    whole = order + length <= ends[who]
    order, who = order[whole], who[whole]
    raw = np.frombuffer(text, np.uint8)
    views = np.lib.stride_tricks.sliding_window_view(raw, length)
    same = np.zeros(len(order), bool)
    for a in range(1, len(order), 8192):
        b = min(a + 8192, len(order))
        same[a:b] = (views[order[a:b]] == views[order[a - 1 : b - 1]]).all(axis=1)
    group = np.cumsum(~same)
    keys = [key for key, _ in pieces]
    by_key = sorted(range(len(keys)), key=keys.__getitem__)
    # places are unique, so (document, start) order is the order of (rank of document, place)
    docs: dict[tuple[int, int], int] = {}
    for i in by_key:
        docs.setdefault(keys[i][:2], len(docs))
    doc = np.array([docs[k[:2]] for k in keys])[who]
    start = np.array([k[2] for k in keys])[who] + order - begins[who]
    by_place = np.lexsort((start, doc, group))
    g, d, s = group[by_place], doc[by_place], start[by_place]
    opens = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(opens, np.arange(len(g)), 0)) if len(g) else g
    later = np.zeros(len(order), bool)
    later[by_place] = (d != d[head]) | (s != s[head])
    hit_who, hit_at = who[later], (order - begins[who])[later]
    arranged = np.lexsort((hit_at, hit_who))
    hit_who, hit_at = hit_who[arranged], hit_at[arranged]
    if not len(hit_who):
        return []
    breaks = np.flatnonzero((np.diff(hit_who) != 0) | (np.diff(hit_at) != 1)) + 1
    firsts, lasts = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(hit_who)]]) - 1
    return list(zip(hit_who[firsts].tolist(), hit_at[firsts].tolist(), hit_at[lasts].tolist()))


def compare_regions(texts: DataFrame, length: int) -> DataFrame:
    """Covered byte ranges (``id``, ``copy``, ``begin``, ``end``) among regions of one anchor.

    ``texts`` is dealt and sorted by ``anchor``. Groups are gathered into batches of about
    ``HASH_BYTES`` to be hashed at once, and what is left into batches of about
    ``BATCH_BYTES`` for one suffix array.
    """
    names = ["id", "copy", "begin", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans: list[tuple[int, int, int, int]] = []
        waiting: list[tuple[tuple[int, int, int], bytes]] = []
        waiting_bytes = 0

        def flush() -> pa.RecordBatch:
            nonlocal waiting, waiting_bytes, spans
            for i, a, b in later_windows(waiting, length) if waiting else ():
                (id_, copy, start), _ = waiting[i]
                spans.append((id_, copy, start + a, start + b + length))
            columns = list(zip(*spans)) if spans else [[], [], [], []]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            waiting, waiting_bytes, spans = [], 0, []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal waiting_bytes, pieces, anchors, piece_bytes
            first: dict[tuple[int, bytes], tuple[int, int, int]] = {}
            current = None
            for i, a, b in [*unique_windows_removed(pieces, length, anchors), (-1, 0, 0)]:
                if i < 0 or anchors[i] != current:  # equal windows are in one group
                    for (_, piece), key in first.items():
                        waiting.append((key, piece))
                        waiting_bytes += len(piece) + 1
                    if waiting_bytes >= BATCH_BYTES or len(spans) >= BATCH_BYTES:
                        yield flush()
                    first, current = {}, anchors[i]
                if i < 0:
                    break
                (id_, copy, low), _, place, data = pieces[i]
                piece = data[a : b + length]
                # equal pieces at equal places: the first stays, later ones are covered
                if first.setdefault((low + a - place, piece), (id_, copy, low + a)) != (id_, copy, low + a):
                    spans.append((id_, copy, low + a, low + b + length))
            pieces, anchors, piece_bytes = [], [], 0

        def close(anchor: int, group: list[tuple]) -> None:
            nonlocal piece_bytes
            earliest: dict[bytes, tuple[int, int, int]] = {}
            group.sort(key=lambda p: p[0])
            for p in group:
                key, _, place, data = p
                if place != WINDOW:
                    pieces.append(p)
                    anchors.append(anchor)
                    piece_bytes += len(data)
                elif data is None or earliest.setdefault(data, key) != key:
                    spans.append((*key, key[2] + length))

        pieces: list[tuple] = []  # of whole groups
        anchors: list[int] = []
        piece_bytes = 0
        current, group = None, []
        for batch in batches:
            for anchor, id_, copy, low, place, data in zip(*(c.to_pylist() for c in batch.columns)):
                if anchor != current:
                    if group:
                        close(current, group)
                        if piece_bytes >= HASH_BYTES:
                            yield from settle()
                        elif len(spans) >= BATCH_BYTES:
                            yield flush()
                    current, group = anchor, []
                group.append(((id_, copy, low), low, place, data))
        if group:
            close(current, group)
        if pieces:
            yield from settle()
        yield flush()

    source = texts.select("anchor", "id", "copy", "low", "place", "bytes")
    return source.mapInArrow(run, "id long, copy long, begin int, end int")


def cut_out(docs: DataFrame, keep: list[str], want_text: bool) -> DataFrame:
    """``docs`` (with ``__begins`` and ``__ends``, null for none) without the bytes of their spans."""
    schema = ", ".join(
        [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [RESULTS]
        + ["kept_text string"] * want_text
    )
    names = [*keep, *(part.split(" ")[0] for part in RESULTS.split(", ")), *["kept_text"] * want_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = [[], [], [], [], []]
            texts, begins, ends = (batch.column(len(keep) + i) for i in range(3))
            for text, begin, end in zip(texts, begins.to_pylist(), ends.to_pylist()):
                data = (text.as_py() or "").encode("utf-8")
                rest, at, removed, runs = [], 0, 0, 0
                for a, b in sorted(zip(begin, end)) if begin else ():
                    if a > at or (a == at == 0):
                        runs += 1
                        rest.append(data[at:a])
                        removed += b - a
                        at = b
                    elif b > at:
                        removed += b - at
                        at = b
                rest.append(data[at:])
                kept = b"".join(rest)
                row = [len(data), removed, runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")]
                for column, value in zip(found, row):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            made = [pa.array(c, t) for c, t in zip(found, types)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], *made[: 4 + want_text]], names=names
            )

    columns = [*keep, "__text", "__begins", "__ends"]
    return docs.select(*columns).mapInArrow(run, schema)


def remove_repeats(
    docs: DataFrame, text: str = "text", keep: list[str] | None = None, length: int = LENGTH,
    want_text: bool = False,
) -> DataFrame:
    """``keep`` (default: all but the text), sizes, number of removed runs and digest of the rest.

    ``want_text`` adds ``kept_text``, the rest as text (a code point cut in two is left
    out). Null and empty texts, and texts under ``length`` bytes, lose nothing. A null
    doc_id comes before all others. Rows that repeat a doc_id are told apart by their text,
    in the order of its hash; rows equal in both are one document and get the same result.
    Columns named like a result give way to it.
    """
    results = {part.split(" ")[0] for part in RESULTS.split(", ")} | {"kept_text"}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in results and c != text]
    plain = docs.select(*keep, document_key(docs["doc_id"]).alias("__id"), docs[text].alias("__text"))
    repeated = docs.groupBy(document_key(docs["doc_id"]).alias("id")).count().where("count > 1")
    copy = F.lit(0).cast("long") if repeated.isEmpty() else F.xxhash64("__text")
    plain = plain.withColumn("__copy", copy)
    slim = plain.select(F.col("__id").alias("id"), F.col("__copy").alias("copy"), "__text")

    by_anchor = Window.partitionBy("anchor")
    by_region = Window.partitionBy("anchor", "region").orderBy("id", "copy", "place", "low")
    met = (
        find_regions(slim, length).repartition("anchor")
        .withColumn("nth", F.rank().over(by_region))
        .withColumn("crowded", F.count("*").over(by_anchor) > CROWD_ROWS)
        .withColumn("mixed", F.min("region").over(by_anchor) != F.max("region").over(by_anchor))
        .where("again OR nth > 1 OR mixed")
    )
    unknown = (F.col("nth") == 1) & ~F.col("again")
    met = stage(
        met.select("id", "copy", "low", "high", "crowded", F.when(unknown, F.col("anchor")).alias("anchor"),
                   F.when(unknown, F.col("place")).alias("place")),
        "repeat-regions",
    )
    covered = met.where("anchor IS NULL").select(
        "id", "copy", F.col("low").alias("begin"), (F.col("high") + length).alias("end")
    )
    unclear = met.where("anchor IS NOT NULL").groupBy("id", "copy").agg(
        F.collect_list(F.struct("anchor", "low", "high", "place", "crowded")).alias("regions")
    )
    texts = _region_bytes(slim.join(unclear, ["id", "copy"]), length)
    texts = texts.repartition("anchor").sortWithinPartitions("anchor")
    spans = stage(covered.union(compare_regions(texts, length)), "repeat-spans")
    spans = spans.groupBy("id", "copy").agg(
        F.collect_list(F.struct("begin", "end")).alias("spans")
    ).select(F.col("id").alias("__id"), F.col("copy").alias("__copy"),
             F.col("spans.begin").alias("__begins"), F.col("spans.end").alias("__ends"))
    return cut_out(plain.join(spans, ["__id", "__copy"], "left"), keep, want_text)


def _region_bytes(docs: DataFrame, length: int) -> DataFrame:
    """The bytes of each region; for regions of crowded anchors a digest of each window.

    Digests that a batch has earlier come out as covered (``bytes`` is null), with a key of
    their own, so a very frequent window adds a row for each batch only.
    """
    schema = "anchor long, id long, copy long, low int, place int, bytes binary"
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            first: dict[bytes, tuple[int, int, int]] = {}
            for id_, copy, text, found in zip(*(c.to_pylist() for c in batch.columns)):
                data = (text or "").encode("utf-8")
                for region in found:
                    low, high = region["low"], region["high"]
                    if not region["crowded"]:
                        piece = data[low : high + length]
                        rows.append((region["anchor"], id_, copy, low, region["place"], piece))
                        continue
                    for at in range(low, high + 1):
                        digest = hashlib.blake2b(data[at : at + length], digest_size=16).digest()
                        place = (id_, copy, at)
                        known = first.get(digest, place)
                        first[digest] = min(known, place)
                        if known != place:
                            rows.append((hash(max(known, place)), *max(known, place), WINDOW, None))
            for digest, place in first.items():
                rows.append((int.from_bytes(digest[:8], "little", signed=True), *place, WINDOW, digest))
            columns = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=["anchor", "id", "copy", "low", "place", "bytes"],
            )

    return docs.select("id", "copy", "__text", "regions").mapInArrow(run, schema)
