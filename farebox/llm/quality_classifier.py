"""Quality classifier: random-indexing word vectors and a small network.

The vocabulary of a corpus is open, so no table of words is needed to tell them apart: the
sparse random index vectors of a word are drawn from its 64-bit hash. The vector of a word
is its own index vector plus the mean of the index vectors of its neighbours over the whole
corpus (random indexing). The sums over neighbours are kept in ``BUCKETS`` rows by the first
bits of the hash: words that share a row share the second part, never the first. A
document is the mean of its words' vectors, the mean of index vectors of their forms (kind
of the first and last character, length, whether in capitals, whether the word before is
repeated), both drawn a little to the corpus mean so that a few words say little, and the
logarithm of their number. A network with one hidden layer, fitted in numpy on a bounded
sample of labelled documents, gives a logit, and a temperature fitted on rows left out of
the training makes it a probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox.llm.quality_rules import _KIND, CHARACTER_CLASSES
from farebox.llm.tables import text_last
from farebox.llm.text_arrays import Words, mix, slices
from farebox.staging import stage

DIMENSIONS, HIDDEN, NONZERO = 96, 32, 8
TRAINING_ROWS = 20_000
PRIOR_WORDS = 5
_LENGTHS = np.array([2, 3, 4, 6, 9, 14])
_CLASSES = len(CHARACTER_CLASSES)
BUCKET_BITS = 18
BUCKETS, BLOCK, SCALE = 1 << BUCKET_BITS, 32, 1 << 14  # rows, rows sent at once, steps to 1
WIDTH = 2 * DIMENSIONS + 1
PARTS, HELD_WORDS = 16, 3 << 20  # a task adds up a part of the buckets at a time, over words it holds
OWN, BEFORE, AFTER, FORM = np.random.default_rng(1).integers(1, 2**63, (4, 2), dtype=np.uint64)
_START = np.where(_KIND < 0, 0, _KIND).astype(np.int64)  # a word starts with a whole code point
_UPPER = np.arange(256) - 65 < 26
_UPPER[:65] = False


def word_forms(words: Words, data: np.ndarray) -> np.ndarray:
    """Form of each word."""
    if not len(words.starts):
        return np.zeros(0, np.int64)
    first, last = _START[data[words.starts]], _START[data[words.ends - 1]]
    length = np.searchsorted(_LENGTHS, words.ends - words.starts, "right")
    capitals = np.concatenate([[0], np.cumsum(_UPPER[data])])
    capital = 2 * (capitals[words.ends] - capitals[words.starts]) > words.ends - words.starts
    capital &= words.ends - words.starts > 1
    again = np.zeros(len(words.starts), bool)
    again[1:] = words.hashes[1:] == words.hashes[:-1]
    again[words.first[words.first < len(again)]] = False
    form = (first * _CLASSES + last) * (len(_LENGTHS) + 1) + length
    return (form * 2 + capital) * 2 + again


def index_vectors(keys: np.ndarray, seeds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sparse random vectors of the keys: ``NONZERO`` times a dimension and +1 or -1 for each.

    The dimensions fall into ``NONZERO`` equal parts, and each part has one that is not zero.
    """
    part = DIMENSIONS // NONZERO
    for k in range(NONZERO):
        if k % 4 == 0:
            bits = mix(keys.astype(np.uint64) ^ seeds[k // 4])
        chunk = ((bits >> np.uint64(16 * (k % 4))) & np.uint64(0xFFFF)).astype(np.int64)
        yield k * part + ((chunk >> 1) * part >> 15), 1 - 2 * (chunk & 1)


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def index_sums(keys: np.ndarray, seeds: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of the index vectors of the keys of each of ``n`` rows."""
    out = np.zeros(n * DIMENSIONS)
    for spot, sign in index_vectors(keys, seeds):
        out += np.bincount(rows * DIMENSIONS + spot, sign, len(out))
    return out.reshape(n, DIMENSIONS)


@dataclass
class Vectors:
    context: Broadcast  # mean of the neighbours' index vectors for each bucket, in 1 / SCALE
    mean: np.ndarray  # of words and forms over the corpus


def pack(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as they need, after a byte that gives their size."""
    most = max(int(values.max()), -int(values.min()))
    kind = np.int8 if most < 1 << 7 else np.int16 if most < 1 << 15 else np.int32
    return bytes([np.dtype(kind).itemsize]) + zlib.compress(values.astype(kind).tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed[1:]), f"i{packed[0]}").astype(np.int64)


def neighbour_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task's documents by block of buckets, and over all words (block -1).

    The hashes of ``HELD_WORDS`` words are held and added up in a table of one part of the
    buckets after the other.
    """
    columns = DIMENSIONS + 1  # the last counts neighbours
    hashes, linked = np.empty(HELD_WORDS, np.uint64), np.empty(HELD_WORDS, bool)
    sums, seen = np.zeros((2, DIMENSIONS)), 0

    def blocks(hashes: np.ndarray, linked: np.ndarray) -> Iterator[pa.RecordBatch]:
        near = np.zeros(columns, np.int64)
        table = np.zeros((BUCKETS // PARTS, columns), np.int32)
        rows = len(table).bit_length() - 1
        flat, cut = table.reshape(-1), table.reshape(-1, BLOCK * columns)
        for part in range(PARTS):
            table[:] = 0
            own = hashes >> np.uint64(64 - BUCKET_BITS) >> np.uint64(rows) == part
            for side, step, seeds in ((np.flatnonzero(own & linked), 1, AFTER),
                                      (np.flatnonzero(own[1:] & linked[:-1]) + 1, -1, BEFORE)):
                at = (buckets(hashes[side]) - part * len(table)) * columns
                for spot, sign in index_vectors(hashes[side + step], seeds):
                    np.add.at(flat, at + spot, sign.astype(np.int32))
                np.add.at(flat, at + DIMENSIONS, np.int32(1))
            near += table.sum(axis=0, dtype=np.int64)
            some = np.flatnonzero(cut.any(axis=1))
            for a in range(0, len(some), 256):
                ids = some[a : a + 256]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part * len(cut) + ids, pa.int64()), pa.array([pack(cut[i]) for i in ids], pa.binary())],
                    names=["block", "sums"],
                )
        facts = np.concatenate([sums.ravel(), near, [len(hashes)]])
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1], pa.int64()), pa.array([facts.astype(np.int64).tobytes()], pa.binary())],
            names=["block", "sums"],
        )

    for batch in batches:
        for _, data, offsets in slices(batch.column(0)):
            words = Words(data, offsets)
            n = len(words.starts)
            if not n:
                continue
            if seen and seen + n > HELD_WORDS:
                yield from blocks(hashes[:seen], linked[:seen])
                sums[:], seen = 0, 0
            inside = np.ones(n, bool)  # the next word is of the same text
            inside[words.first[words.first > 0] - 1] = False
            row = np.zeros(n, np.int64)
            sums[0] += index_sums(words.hashes, OWN, row, 1)[0]
            sums[1] += index_sums(word_forms(words, data), FORM, row, 1)[0]
            if n > HELD_WORDS:  # one text
                yield from blocks(words.hashes, inside)
                sums[:] = 0
                continue
            hashes[seen : seen + n], linked[seen : seen + n] = words.hashes, inside
            seen += n
    if seen:
        yield from blocks(hashes[:seen], linked[:seen])


def word_vectors(docs: DataFrame, text: str) -> Vectors:
    """Neighbour means of every bucket, over all documents.

    A task adds up its documents and sends a row a block, so a frequent word is no more to
    send than a rare one. Sums are whole numbers: the result does not depend on the
    partitions.
    """
    columns = DIMENSIONS + 1  # the last counts neighbours

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}  # bounded by the table
        for batch in batches:
            for block, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(sums, np.int64) if block < 0 else unpack(sums)
                total[block] = total[block] + values if block in total else values
        for block, values in total.items():
            if block >= 0:
                table = values.reshape(BLOCK, columns)
                means = table[:, :-1] * (SCALE / np.sqrt(NONZERO)) / np.maximum(table[:, -1:], 1)
                values = np.rint(means).astype(np.int16)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([values.tobytes()], pa.binary())],
                names=["block", "sums"],
            )

    schema = "block long, sums binary"
    found = docs.select(docs[text].alias("__text")).mapInArrow(neighbour_sums, schema)
    context = np.zeros((BUCKETS, DIMENSIONS), np.int16)
    mean = np.zeros(2 * DIMENSIONS)
    added = stage(found.repartition("block").mapInArrow(add, schema), "neighbours")
    for block, sums in added.toLocalIterator():  # a part at a time; the whole has the table's size
        if block >= 0:
            context[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(sums, np.int16).reshape(BLOCK, -1)
        else:
            facts = np.frombuffer(sums, np.int64)
            own, form, near = facts[:-2].reshape(3, DIMENSIONS) / np.sqrt(NONZERO)
            mean = np.concatenate([own / facts[-1] + near / max(facts[-2], 1), form / facts[-1]])
    return Vectors(docs.sparkSession.sparkContext.broadcast(context), mean)


def pooled(column: pa.Array, vectors: Vectors) -> np.ndarray:
    """Document vectors: the mean word vector, the mean vector of word forms, and the
    logarithm of the number of words."""
    out = np.zeros((len(column), WIDTH))
    for first, data, offsets in slices(column):
        words = Words(data, offsets)
        n = np.diff(words.first)
        rows = np.repeat(np.arange(len(n)), n)
        near, bucket = np.zeros((len(n), DIMENSIONS), np.int64), buckets(words.hashes)
        context = vectors.context.value
        for a in range(0, len(bucket), 1 << 13):
            part, row = context[bucket[a : a + (1 << 13)]], rows[a : a + (1 << 13)]
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            near[row[starts]] += np.add.reduceat(part.astype(np.int32), starts, axis=0)
        own = index_sums(words.hashes, OWN, rows, len(n)) / np.sqrt(NONZERO) + near / SCALE
        form = index_sums(word_forms(words, data), FORM, rows, len(n)) / np.sqrt(NONZERO)
        sums = np.column_stack([own, form]) + PRIOR_WORDS * vectors.mean
        mean = sums / (n + PRIOR_WORDS)[:, None]
        out[first : first + len(n)] = np.column_stack([mean, np.log1p(n) / 10])
    return out


@dataclass
class Model:
    vectors: Vectors
    centre: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.centre) / self.scale @ w1 + b1) @ w2 + b2[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_network(
    x: np.ndarray, y: np.ndarray, vectors: Vectors, seed: int = 7, epochs: int = 60
) -> Model:
    """Fit by Adam on batches of 256 rows. Without rows every score is one half."""
    rng = np.random.default_rng(seed)
    width = x.shape[1]
    layers = [rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(1)]
    if not len(y):
        return Model(vectors, np.zeros(width), np.ones(width), layers)
    layers[2] = rng.normal(0, HIDDEN**-0.5, HIDDEN)
    model = Model(vectors, x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3), layers)
    z = (x - model.centre) / model.scale
    m, v = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(y), 256):
            rows = order[a : a + 256]
            hidden = np.tanh(z[rows] @ layers[0] + layers[1])
            p = 1 / (1 + np.exp(-np.clip(hidden @ layers[2] + layers[3][0], -30, 30)))
            miss = (p - y[rows]) / len(rows)
            back = np.outer(miss, layers[2]) * (1 - hidden**2)
            slopes = [z[rows].T @ back, back.sum(0), hidden.T @ miss, np.array([miss.sum()])]
            slopes[0] += 1e-4 * layers[0]
            step += 1
            rate = 3e-3 * (1 - epoch / epochs)
            for i, g in enumerate(slopes):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                layers[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return model


def calibrate(model: Model, x: np.ndarray, y: np.ndarray) -> Model:
    """The temperature with the smallest log loss on rows the network has not seen."""
    if len(y):
        logits = model.logits(x)
        loss = lambda t: np.logaddexp(0, -np.where(y > 0, 1, -1) * logits / t).mean()
        model.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return model


def doc_crc(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))


def is_held_out(doc_id: Column) -> Column:
    """Rows whose labels must not be learned from."""
    return doc_crc(doc_id) % 3 == 1


def fit(
    docs: DataFrame, labels: DataFrame, text: str = "text", training_rows: int = TRAINING_ROWS
) -> Model:
    """Vectors from all ``docs``; the network from at most ``training_rows`` labelled ones.

    Labels of held-out ids are not read. The sample is the rows with the smallest hash of
    their id, so it does not depend on partitions; a fifth of it sets the temperature. A
    document with several labels counts once, with the largest.
    """
    vectors = word_vectors(docs, text)
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .where(~is_held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("quality").alias("__y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(training_rows)
    )
    slim = docs.select("doc_id", docs[text].alias("__text"))
    # at most training_rows ids: broadcast by that bound
    labelled = slim.join(F.broadcast(chosen), "doc_id").select(
        "doc_id", "__y", (F.floor(doc_crc(F.col("doc_id")) / 3) % 5 == 0).alias("__late"), "__text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column(3), vectors)
            packed = pa.array([row.tobytes() for row in x], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1).cast(pa.int32()), batch.column(2), packed],
                names=["doc_id", "y", "late", "x"],
            )

    rows = labelled.mapInArrow(run, "doc_id long, y int, late boolean, x binary")
    # repeated document rows are cut to one for each label, which keeps the bound
    rows = stage(rows.groupBy("doc_id", "y", "late").agg(F.min("x").alias("x")), "training-rows")
    facts = sorted((r["doc_id"], r["y"], r["late"], r["x"]) for r in rows.toLocalIterator())
    x = np.frombuffer(b"".join([r[3] for r in facts])).reshape(-1, WIDTH)
    y, late = np.array([r[1] for r in facts], float), np.array([r[2] for r in facts], bool)
    return calibrate(fit_network(x[~late], y[~late], vectors), x[late], y[late])


def score(
    docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``keep`` (default: all columns) and ``score`` from 0 to 1, higher for better texts.

    Null and empty texts have a score too, that of no words. A column ``score`` gives way.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    schema = ", ".join(
        [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["score double"]
    )
    source, at = text_last(docs, text, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = model.scores(pooled(batch.column(at), model.vectors))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(values)], names=[*keep, "score"]
            )

    return source.mapInArrow(run, schema)
