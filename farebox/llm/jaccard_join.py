"""Exact Jaccard self-join of documents on word n-grams, with prefix filtering.

Two documents link when their shingle sets have a Jaccard similarity of at least
``percent``. Shingles get one global order, rare ones first. Linked sets must share a
shingle among the first ``n - ceil(percent * n) + 1`` of each (prefix filter); from the
sizes, the places of the shared shingle and counts of the sets over fixed ranges of hash
values follow upper bounds of the overlap (length, positional and suffix filters). What
remains is verified once for each pair, on the sets themselves.

Equal sets are one node from the start. For components not every link is needed: inside a
group that is already connected nothing more is verified. First each node is verified
against the leading nodes of its prefix groups, and then, for whatever groups are still in
several components, every pair across components that passes the filters is verified.
Together they miss no link between components.

Rarity comes from counts over all documents in a table of fixed size (counts of hash
ranges). Any order gives exact results; the table only makes prefixes selective.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farebox.llm.components import components
from farebox.llm.text_arrays import Words, mix, shingle_sets, slices
from farebox.staging import stage

COUNTER_BITS, CHUNK_BITS, RANGES = 20, 16, 8
SALT_ROWS = 100
HOT_COUNT = 200_000


def set_keys(grams: np.ndarray, seed: int) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set."""
    salt = np.uint64(2 * seed + 1)
    one = int(mix(grams + salt).sum(dtype=np.uint64))
    two = int(mix(grams * np.uint64(0xD6E8FEB86659FD93) + salt).sum(dtype=np.uint64))
    wrap = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    return wrap(one), wrap(two)


def sets_of(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    for _, data, offsets in slices(column):
        yield from shingle_sets(Words(data, offsets, lower=True), k)


def profile(docs: DataFrame, k: int, seed: int) -> DataFrame:
    """One pass: per row its set (``key``, ``check``, ``n``, ``ranges``); per task its counts.

    Rows with ``chunk`` are the counts: a part of the table of counters, compressed.
    """
    schema = (
        "doc_id long, key long, check long, n int, ranges array<int>, chunk int, counts binary"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << COUNTER_BITS, np.int64)
        wide = np.uint64(64 - COUNTER_BITS)
        for batch in batches:
            keys, checks, sizes, ranges = [], [], [], []
            for grams in sets_of(batch.column(1), k):
                key, check = set_keys(grams, seed)
                keys.append(key)
                checks.append(check)
                sizes.append(len(grams))
                ranges.append(np.bincount((grams >> np.uint64(61)).astype(np.int64), minlength=RANGES))
                np.add.at(counters, (grams >> wide).astype(np.int64), 1)
            rows = batch.num_rows
            edges = np.arange(rows + 1, dtype=np.int32) * RANGES
            flat = np.concatenate(ranges).astype(np.int32) if ranges else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.int64()), pa.array(checks, pa.int64()),
                 pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(edges, flat),
                 pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())],
                names=["doc_id", "key", "check", "n", "ranges", "chunk", "counts"],
            )
        parts = counters.reshape(-1, 1 << CHUNK_BITS)
        used = [i for i, part in enumerate(parts) if part.any()]
        yield pa.RecordBatch.from_arrays(
            [*(pa.nulls(len(used), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()))),
             pa.array(used, pa.int32()),
             pa.array([zlib.compress(parts[i].tobytes(), 1) for i in used], pa.binary())],
            names=["doc_id", "key", "check", "n", "ranges", "chunk", "counts"],
        )

    return docs.select("doc_id", "__text").mapInArrow(run, schema)


def counter_table(profiled: DataFrame) -> np.ndarray:
    """Counts of all tasks, summed by part on the cluster: 2^20 numbers come to the driver."""
    parts = 1 << (COUNTER_BITS - CHUNK_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(zlib.decompress(packed.as_py()), np.int64)
                sums[chunk] = sums[chunk] + part if chunk in sums else part
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
            names=["chunk", "counts"],
        )

    rows = profiled.where("chunk IS NOT NULL").select("chunk", "counts").repartition(parts, "chunk")
    table = np.zeros((parts, 1 << CHUNK_BITS), np.int64)
    for row in rows.mapInArrow(run, "chunk int, counts binary").collect():
        table[row["chunk"]] += np.frombuffer(row["counts"], np.int64)
    return np.minimum(table.ravel(), np.iinfo(np.uint32).max).astype(np.uint32)


def postings(docs: DataFrame, k: int, percent: int, seed: int, table: Broadcast) -> DataFrame:
    """``gram``, ``salt``, ``key``, ``n``, ``pos`` of the prefix of each set, rare grams first.

    A task gives each set once, however many of its rows have it. Grams of very high count
    are dealt over ``salts`` groups; other grams have one group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, wide = table.value, np.uint64(64 - COUNTER_BITS)
        seen: set[int] = set()
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for grams in sets_of(batch.column(0), k):
                n = len(grams)
                key, _ = set_keys(grams, seed)
                if not n or key in seen:
                    continue
                seen.add(key)
                count = counts[(grams >> wide).astype(np.int64)]
                first = np.lexsort((grams, count))[: n - (percent * n + 99) // 100 + 1]
                size = len(first)
                salts = (1 + count[first] // HOT_COUNT).astype(np.int32)
                for column, values in zip(columns, (
                    grams[first].view(np.int64), ((key & 0xFFFF) % salts).astype(np.int32), salts, np.full(size, key, np.int64),
                    np.full(size, n, np.int32), np.arange(size, dtype=np.int32),
                )):
                    column.append(values)
            if columns[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in columns],
                    names=["gram", "salt", "salts", "key", "n", "pos"],
                )

    schema = "gram long, salt int, salts int, key long, n int, pos int"
    return docs.select("__text").mapInArrow(run, schema)


def needed(n_a: Column, n_b: Column, percent: int) -> Column:
    """Least overlap of linked sets: the smallest I with I * (100 + percent) >= percent * (a + b)."""
    total = (n_a + n_b).cast("long") * percent
    return F.floor((total + 99 + percent) / (100 + percent))


def may_link(a: str, b: str, percent: int) -> Column:
    """Length filter, and positional filter for the first gram that two sets share."""
    n_a, n_b = F.col(f"{a}n"), F.col(f"{b}n")
    most = F.least(n_a - F.col(f"{a}pos"), n_b - F.col(f"{b}pos"))
    return (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent) & (most >= needed(n_a, n_b, percent))


def suffix_filter(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose counts over ranges of hash values leave room for the overlap.

    Sets that differ by d elements in one range differ by at least d there, so the sum over
    the ranges bounds the elements not shared.
    """
    slim = sets.select("key", "n", "ranges")
    joined = (
        pairs.join(slim.toDF("a", "a_n", "a_ranges"), "a").join(slim.toDF("b", "b_n", "b_ranges"), "b")
    )
    apart = F.aggregate(
        F.zip_with("a_ranges", "b_ranges", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x
    )
    room = (F.col("a_n") + F.col("b_n") - apart) / 2
    return joined.where(room >= needed(F.col("a_n"), F.col("b_n"), percent)).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, k: int, percent: int, seed: int) -> DataFrame:
    """The ``a``, ``b`` among distinct ``pairs`` that link; ``a`` leads many pairs, ``b`` few.

    The texts of a leader's partners travel to it in parts of about ``SALT_ROWS``; every
    part gets its own copy of the leader's text.
    """
    sized = pairs.groupBy("a").agg(F.count("*").alias("_n"))
    pairs = stage(
        pairs.join(sized, "a").withColumn(
            "part", F.pmod(F.xxhash64("b"), F.floor(F.col("_n") / SALT_ROWS) + 1).cast("int")
        ).drop("_n"),
        "jaccard-pairs",
    )
    leaders = pairs.select("a", "part", F.lit(False).alias("partner"), F.col("a").alias("key")).distinct()
    partners = pairs.select("a", "part", F.lit(True).alias("partner"), F.col("b").alias("key"))
    wanted = leaders.union(partners).join(sets.select("key", "doc_id"), "key")
    texts = docs.select("doc_id", "__text").join(wanted, "doc_id")
    texts = texts.repartition("a", "part").sortWithinPartitions("a", "part", "partner", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, lead = None, None
        for batch in batches:
            a, part, partner, key = (batch.column(i).to_pylist() for i in range(4))
            found_a, found_b = [], []
            for i, grams in enumerate(sets_of(batch.column(4), k)):
                if set_keys(grams, seed)[0] != key[i]:
                    continue  # another row with the same doc_id
                if not partner[i]:
                    group, lead = (a[i], part[i]), grams
                elif group == (a[i], part[i]):
                    both = len(np.intersect1d(lead, grams, assume_unique=True))
                    if 100 * both >= percent * (len(lead) + len(grams) - both):
                        found_a.append(a[i])
                        found_b.append(key[i])
            yield pa.RecordBatch.from_arrays(
                [pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"]
            )

    linked = texts.select("a", "part", "partner", "key", "__text").mapInArrow(run, "a long, b long")
    return linked.distinct()


def similar_components(
    docs: DataFrame, text: str = "text", k: int = 4, percent: int = 85, max_seeds: int = 5
) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` for every row of ``docs``.

    Words are lower-cased (A-Z) runs without white space; a text of fewer than ``k`` words
    is one shingle; null, empty and wordless texts have none and link with nothing.
    ``component_id`` is the smallest doc_id that links reach. Rows that repeat a doc_id are
    documents of their own that share a name; a row without doc_id has no component (null)
    and lends none.
    """
    docs = docs.select("doc_id", docs[text].alias("__text"))
    for seed in range(max_seeds):
        profiled = stage(profile(docs, k, seed), "jaccard-profile")
        rows = profiled.where("chunk IS NULL")
        sets = stage(
            rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("key").agg(
                F.min("doc_id").alias("doc_id"), F.first("n").alias("n"),
                F.first("ranges").alias("ranges"), (F.min("check") != F.max("check")).alias("clash"),
            ),
            "jaccard-sets",
        )
        if sets.where("clash").isEmpty():
            break  # else two sets share a key, a chance of one in billions: hash anew
    else:
        raise RuntimeError("set keys clash under every seed")
    table = docs.sparkSession.sparkContext.broadcast(counter_table(profiled))
    known = docs.where("doc_id IS NOT NULL")
    groups = shared_prefixes(postings(known, k, percent, seed, table))
    links = linking_pairs(groups, known, sets, k, percent, seed)
    labels = components(links)
    smallest = (
        labels.join(sets, labels["node"] == sets["key"]).groupBy("label").agg(F.min("doc_id").alias("_least"))
    )
    named = labels.join(smallest, "label").select(F.col("node").alias("key"), "_least")
    # equal texts of all rows share one key: a plain join, whose large partitions are split
    own = sets.select("key", F.col("doc_id").alias("_own")).join(named, "key", "left").select(
        "key", F.coalesce("_least", "_own").alias("_component")
    )
    own = stage(own, "jaccard-components")
    return rows.join(own, "key", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("_component")))
        .otherwise(F.col("doc_id")).alias("component_id"),
    )


def shared_prefixes(posted: DataFrame) -> DataFrame:
    """Postings of grams that several sets have in their prefix, with the group's leader.

    The leader is the set where the gram comes first: it has the fewest rarer grams of its
    own. A gram dealt over salts has a leader in each; the last step of ``linking_pairs``
    sees all its sets together.
    """
    posted = posted.repartition("gram", "salt").dropDuplicates(["gram", "salt", "key"])
    group = Window.partitionBy("gram", "salt")
    lead = F.min(F.struct("pos", "key", "n")).over(group).alias("_lead")
    counted = posted.select("*", lead, F.count("*").over(group).alias("_size"))
    fields = [
        F.col("_lead.key").alias("lead"), F.col("_lead.pos").alias("lead_pos"), F.col("_lead.n").alias("lead_n"),
    ]
    return stage(counted.where("_size > 1 OR salts > 1").select("gram", "key", "n", "pos", *fields), "jaccard-groups")


def linking_pairs(
    groups: DataFrame, docs: DataFrame, sets: DataFrame, k: int, percent: int, seed: int
) -> DataFrame:
    """Links that connect the same components as all links do."""
    led = (
        groups.where(F.col("lead") != F.col("key")).where(may_link("lead_", "", percent))
        .select(F.col("lead").alias("a"), F.col("key").alias("b")).distinct()
    )
    led = stage(suffix_filter(led, sets, percent), "jaccard-led")
    links = stage(verified(led, docs, sets, k, percent, seed), "jaccard-links")
    labels = components(links)

    # every pair across components that shares a prefix gram
    marked = groups.join(labels.select(F.col("node").alias("key"), "label"), "key", "left")
    marked = marked.withColumn("label", F.coalesce("label", "key"))
    mixed = marked.groupBy("gram").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
    marked = stage(marked.join(mixed.select("gram"), "gram"), "jaccard-mixed")
    a = marked.select("gram", *(F.col(c).alias(f"a_{c}") for c in ("key", "n", "pos", "label")))
    b = marked.select("gram", *(F.col(c).alias(f"b_{c}") for c in ("key", "n", "pos", "label")))
    across = (
        a.join(b, "gram").where(F.col("a_key") < F.col("b_key")).where(F.col("a_label") != F.col("b_label"))
        .where(may_link("a_", "b_", percent)).select(F.col("a_key").alias("a"), F.col("b_key").alias("b")).distinct()
    )
    tried = led.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    across = stage(suffix_filter(across.join(tried, ["a", "b"], "left_anti"), sets, percent), "jaccard-across")
    if not across.isEmpty():
        links = links.union(verified(across, docs, sets, k, percent, seed))
    return links
