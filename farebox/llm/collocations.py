"""Phrase collocations from one count of the longest windows.

Every word opens one window: the word and the next four of its piece, padded where the
piece ends. Only these windows are counted, one column a word (its lead columns). ROLLUP
over the columns adds them up to every shorter prefix, and a prefix of k words counts each
occurrence of a k-word phrase once, as each opens one window. No n-grams of other lengths
are made.

Most windows are rare. A phrase of ``min_count`` occurrences has only neighbours that stand
side by side as often, so a window is also padded from the first pair on that does not. The
pairs are counted in full by 64-bit hash; the frequent ones become a bit table of fixed size
(``PAIR_BITS``). A clash leaves a window longer than needed and changes no count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farebox.llm.text_arrays import mix
from farebox.staging import stage

LONGEST = 5
WORDS = [f"w{k}" for k in range(1, LONGEST + 1)]
CHUNK_TOKENS = 1 << 20  # a task works on so many tokens at once, or one text if it is longer
OUT_ROWS = 1 << 16
PAIR_BITS = 26  # the bit table of frequent pairs has 2^PAIR_BITS bits (8 MB)
BITMAP = 1 << 15  # bits in one bitmap of bitmap_construct_agg
SALTS = 64
MOST_LANGS = 10_000  # sizes of so many languages are broadcast, of more they are joined by key
BREAK = b"\xff"  # stands between pieces; in no UTF-8 text
_LETTERS = dict(zip(range(ord("A"), ord("Z") + 1), range(ord("a"), ord("z") + 1)))
_FOLD = bytes(BREAK[0] if b in b".,;:!?\n\x0b\x0c\r" else _LETTERS.get(b, b) for b in range(256))
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Ids(dict):
    """Numbers of things in the order they come."""

    def __missing__(self, thing):
        self[thing] = n = len(self)
        return n


def tokens_of(text: str) -> list[bytes]:
    """The words of a text, A-Z in lower case, with ``BREAK`` at every piece separator."""
    return text.encode("utf-8").translate(_FOLD).replace(BREAK, b" \xff ").split()


def hashes(things: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([hashlib.blake2b(t, digest_size=8).digest() for t in things]), np.uint64)


class Chunk:
    """Whole texts as numbers of words; number 0 stands between pieces and texts."""

    def __init__(self) -> None:
        self.words, self.langs = Ids({BREAK: 0}), Ids()
        self.numbers: list[int] = [0]
        self.owners, self.lengths = [0], [1]

    def add(self, lang: str, text: str) -> None:
        before = len(self.numbers)
        self.numbers.extend(map(self.words.__getitem__, tokens_of(text)))
        self.numbers.append(0)
        self.owners.append(self.langs[lang])
        self.lengths.append(len(self.numbers) - before)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Word number and language number of every token."""
        return np.array(self.numbers, np.int64), np.repeat(np.array(self.owners, np.int64), self.lengths)

    def pairs(self, ids: np.ndarray, langs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a word has a next word in its piece, and the 64-bit hashes of these pairs."""
        at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        word = hashes(list(self.words))
        lang = hashes([name.encode("utf-8") for name in self.langs])
        return at, mix(word[ids[at]] * _FIRST + mix(word[ids[at + 1]]) * _SECOND + lang[langs[at]])


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    chunk = Chunk()
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            chunk.add(lang.as_py(), text.as_py() or "")
            if len(chunk.numbers) >= CHUNK_TOKENS:
                yield chunk
                chunk = Chunk()
    if len(chunk.numbers) > 1:
        yield chunk


def frequent_pairs(texts: DataFrame, min_count: int) -> bytes:
    """Bits of the pairs of neighbours that stand together ``min_count`` times in a language.

    The result has 2^PAIR_BITS bits at every size of the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            keys, counts = np.unique(chunk.pairs(*chunk.arrays())[1], return_counts=True)
            for a in range(0, len(keys), OUT_ROWS):
                columns = [pa.array(keys[a : a + OUT_ROWS].view(np.int64)), pa.array(counts[a : a + OUT_ROWS])]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n"])

    counted = texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    place = F.pmod("key", F.lit(1 << PAIR_BITS)) + 1
    found = (
        counted.where(F.col("n") >= min_count).select(place.alias("place"))
        .groupBy(F.bitmap_bucket_number("place").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect()
    )
    table = bytearray(1 << (PAIR_BITS - 3))
    size = BITMAP // 8
    for bucket, bits in found:
        table[(bucket - 1) * size : bucket * size] = bits
    return bytes(table)


def windows(texts: DataFrame, pairs: Broadcast) -> DataFrame:
    """``lang``, one column a word, ``n``: the windows of every chunk, each with its count.

    The pad is the empty string, which no word is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(pairs.value, np.uint8)
        for chunk in chunks(batches):
            ids, langs = chunk.arrays()
            at, keys = chunk.pairs(ids, langs)
            place = (keys % np.uint64(1 << PAIR_BITS)).astype(np.int64)
            follows = np.zeros(len(ids), bool)
            follows[at] = (table[place >> 3] >> (place & 7)) & 1
            leads = [ids]
            for k in range(1, LONGEST):  # the next column, while every pair so far is frequent
                column = np.zeros(len(ids), np.int64)
                column[:-k] = np.where((leads[-1][:-k] > 0) & follows[k - 1 : len(ids) - 1], ids[k:], 0)
                leads.append(column)
            rows = np.flatnonzero(ids)
            packed = [
                leads[0][rows] << 32 | leads[1][rows], leads[2][rows] << 32 | leads[3][rows],
                leads[4][rows] << 32 | langs[rows],
            ]
            order = np.lexsort(packed)
            rows = rows[order]
            fresh = np.ones(len(rows), bool)
            fresh[1:] = np.any([p[order][1:] != p[order][:-1] for p in packed], axis=0)
            starts = np.flatnonzero(fresh)
            counts = np.diff(np.append(starts, len(rows)))
            rows = rows[starts]
            words = pa.array([b"", *list(chunk.words)[1:]], pa.binary()).cast(pa.string())
            names = pa.array(list(chunk.langs), pa.string())
            for a in range(0, len(rows), OUT_ROWS):
                part = rows[a : a + OUT_ROWS]
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(langs[part])), *(words.take(pa.array(c[part])) for c in leads),
                     pa.array(counts[a : a + OUT_ROWS])], names=["lang", *WORDS, "n"],
                )

    return texts.mapInArrow(run, ", ".join(["lang string", *(f"{w} string" for w in WORDS), "n long"]))


def phrase_counts(texts: DataFrame, min_count: int) -> DataFrame:
    """``lang``, ``phrase``, ``k`` words, ``f`` occurrences, for phrases of ``min_count`` and more.

    Rows with ``k`` 0 have the number of words of a language. Written, as it is read often.
    """
    spark = texts.sparkSession
    pairs = spark.sparkContext.broadcast(frequent_pairs(texts, min_count))
    counted = windows(texts, pairs).groupBy("lang", *WORDS).agg(F.sum("n").alias("n"))
    rolled = counted.rollup("lang", *WORDS).agg(F.sum("n").alias("f"))
    last = F.coalesce(*WORDS[::-1])  # columns that are rolled up are null
    found = rolled.where(F.col("lang").isNotNull()).where(
        F.col("w1").isNull() | ((last != "") & (F.col("f") >= min_count))
    )
    k = sum((F.col(w).isNotNull().cast("int") for w in WORDS), F.lit(0))
    out = stage(found.select("lang", F.array_join(F.array(*WORDS), " ").alias("phrase"), k.alias("k"), "f"), "phrases")
    pairs.destroy()
    return out


def joined(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def collocations(
    docs: DataFrame, min_count: int = 100, top: int = 2000, inside_percent: int = 100,
    text: str = "text", lang: str = "lang",
) -> DataFrame:
    """The ``top`` phrases of 2 to 5 words of every language, by the weakest of their cuts.

    A phrase of ``a`` occurrences cut into parts of ``l`` and ``r`` occurrences scores
    ``floor(1000 a n / (l r))``, where ``n`` is the number of words of its language; the
    lowest cut counts, the first of equals. A phrase goes if a longer one of ``min_count``
    occurrences holds it and has ``inside_percent`` of its occurrences or more. Equal scores
    go by ``a``, then by the bytes of the phrase. Columns: ``lang``, ``rank``, ``phrase``,
    ``a``, ``l``, ``r``, ``n``, ``score``.

    Null texts are empty, a null language is ``und``; repeated rows count again. Other
    columns of ``docs`` are not read. An empty table gives no rows.
    """
    texts = docs.select(F.coalesce(docs[lang], F.lit("und")).alias("lang"), docs[text].alias("text"))
    counts = phrase_counts(texts, min_count)
    sizes = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    if sizes.count() <= MOST_LANGS:
        sizes = F.broadcast(sizes)
    parts = counts.where("k > 0").select("lang", "phrase", "f")
    phrases = counts.where("k > 1").select("lang", "phrase", F.split("phrase", " ").alias("words"), "k", F.col("f").alias("a"))

    cut = phrases.select("lang", "phrase", "a", "words", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cut = cut.select(
        "lang", "phrase", "a", "cut", joined(F.col("words"), F.lit(1), F.col("cut")).alias("left"),
        joined(F.col("words"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"),
    )
    exact = lambda name: F.col(name).cast("decimal(19,0)")
    score = F.call_function("div", 1000 * exact("a") * exact("n"), exact("l") * exact("r"))
    scored = (
        cut.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
        .join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
        .join(sizes, "lang")
        .groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    )

    spans = phrases.where("k > 2").select("lang", "words", "k", "a", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    spans = spans.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("start"))
    inside = (
        spans.select("lang", joined(F.col("words"), F.col("start"), F.col("size")).alias("phrase"), "a")
        .groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    )
    free = F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a"))
    left = scored.join(inside, ["lang", "phrase"], "left").where(free)
    left = left.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    first = left.withColumn("rank", F.row_number().over(few)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
pieces_of_words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces_of_words),
grams AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k
  FROM places, range(1, 6) AS sizes(k) WHERE i + k - 1 <= len(w)),
sizes AS (SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang),
counts AS (SELECT lang, phrase, k, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
phrases AS (
  SELECT lang, phrase, string_split(phrase, ' ') AS w, k, f AS a FROM counts WHERE k > 1),
cuts AS (
  SELECT p.lang, p.phrase, p.a, c.cut, x.f AS l, y.f AS r,
         CAST((1000::HUGEINT * p.a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score, n
  FROM phrases p JOIN range(1, 5) AS c(cut) ON c.cut < p.k
  JOIN counts x ON x.lang = p.lang AND x.phrase = array_to_string(p.w[1:c.cut], ' ')
  JOIN counts y ON y.lang = p.lang AND y.phrase = array_to_string(p.w[c.cut + 1:], ' ')
  JOIN sizes s ON s.lang = p.lang),
best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT DISTINCT p.lang, p.phrase
  FROM phrases p JOIN phrases q ON p.lang = q.lang AND q.k > p.k AND 100 * q.a >= 100 * p.a
   AND contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' '))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score
FROM best ANTI JOIN inside USING (lang, phrase)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
