"""Removal of lines that many documents share, as bitmaps of the lines to keep.

Only hashes of lines travel, never their text. The hashes are range-partitioned and sorted
by document and position inside each key (a secondary sort), so that one pass over a
partition meets a key's documents in order: it sees the first place of the key in each
document, counts the documents and marks the lines to drop. What comes back per document
is a compressed bitmap; the text is cut only where it already is.

A key that holds much of all lines would be one long run in one task. A sketch of bounded
size (``HOT_KEYS`` keys at most) finds such keys, and their documents are dealt into as many
blocks as there are shuffle partitions; the counts of the blocks are added up afterwards.
The sketch decides only how rows are laid out, so a miss costs time and never a row.

Everything here is made of DataFrame functions.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farebox.staging import stage

BLANKS = " \t\n\x0b\f\r"
# Keys above one in HOT_ONE_IN lines count as hot; the sketch tracks five times as many.
HOT_ONE_IN = 2_000
HOT_KEYS, TRACKED_KEYS = HOT_ONE_IN, 5 * HOT_ONE_IN
WORD_BITS = 64
DOC, KEY = ["_doc", "_text1", "_text2"], ["_key1", "_key2"]
KEEP_TYPE = "array<struct<word:int,bits:bigint>>"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case."""
    ascii_only = F.octet_length(line) == F.length(line)  # then lower() changes A-Z alone
    lowered = F.when(ascii_only, F.lower(line)).otherwise(
        F.translate(line, string.ascii_uppercase, string.ascii_lowercase)
    )
    return F.trim(lowered, F.lit(BLANKS))


def lines_of(text: Column) -> Column:
    """The lines of a text, null taken as empty; an empty text has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def hashes(value: Column) -> list[Column]:
    """Two independent 64-bit hashes."""
    return [F.xxhash64(value), F.xxhash64(F.lit("second"), value)]


def doc_columns(docs: DataFrame, doc_id: str, text: str) -> list[Column]:
    """What tells documents apart: the id and 128 bits of the text."""
    first, second = hashes(F.coalesce(docs[text], F.lit("")))
    return [docs[doc_id].alias(DOC[0]), first.alias(DOC[1]), second.alias(DOC[2])]


def line_hashes(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """A row per line whose key has ``min_chars`` code points: document, position, key."""
    # hashes of a text are made before its lines are rows, once
    texts = docs.select(*doc_columns(docs, doc_id, text), lines_of(docs[text]).alias("_lines"))
    lines = texts.select(*DOC, F.posexplode("_lines").alias("_pos", "_line"))
    keyed = lines.withColumn("_line", line_key(F.col("_line")))
    first, second = hashes(F.col("_line"))
    return keyed.where(F.length("_line") >= min_chars).select(
        *DOC, "_pos", first.alias(KEY[0]), second.alias(KEY[1])
    )


def hot_keys(lines: DataFrame) -> list[int]:
    """First hashes of keys that hold more than one in ``HOT_ONE_IN`` lines, ``HOT_KEYS`` at most."""
    top = F.expr(f"approx_top_k({KEY[0]}, {HOT_KEYS}, {TRACKED_KEYS})")
    row = lines.agg(top.alias("top"), F.count("*").alias("n")).first()
    return [item["item"] for item in row["top"] if item["count"] * HOT_ONE_IN > row["n"]]


def dropped_lines(
    docs: DataFrame, doc_id: str, text: str, min_docs: int, min_chars: int, keep_first: bool
) -> DataFrame:
    """Document and position of every line to drop."""
    spark = docs.sparkSession
    lines = line_hashes(docs, doc_id, text, min_chars)
    hot = F.col(KEY[0]).isin(hot_keys(lines))
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = F.pmod(F.xxhash64(*DOC), F.when(hot, F.lit(blocks)).otherwise(F.lit(1))).cast("int")
    # Both windows below are met by this partitioning and share one sort.
    ranged = lines.withColumns({"_block": dealt, "_hot": hot}).repartitionByRange(*KEY, "_block")
    in_doc = Window.partitionBy(*KEY, "_block", *DOC).orderBy("_pos")
    in_key = Window.partitionBy(*KEY, "_block")
    found = (
        # repeated rows of one document share their first place, and each counts
        ranged.withColumn("_opens", F.rank().over(in_doc) == 1)
        .withColumn("_docs", F.sum(F.col("_opens").cast("int")).over(in_key))
        .withColumn("_first", F.rank().over(in_key.orderBy(*DOC, "_pos")) == 1)
        .where(F.col("_hot") | (F.col("_docs") >= min_docs))
    )
    found = stage(found.select(*DOC, "_pos", *KEY, "_hot", "_opens", "_first"), "line-places")
    cold = found.where(~F.col("_hot"))
    if keep_first:
        cold = cold.where(~F.col("_first"))
    # one row per hot key: broadcast by that bound
    totals = found.where("_hot").groupBy(*KEY).agg(
        F.sum(F.col("_opens").cast("long")).alias("_docs"), F.min(F.struct(*DOC, "_pos")).alias("_at")
    ).where(F.col("_docs") >= min_docs)
    hot_lines = found.where("_hot").join(F.broadcast(totals), KEY)
    if keep_first:
        hot_lines = hot_lines.where(~F.struct(*DOC, "_pos").eqNullSafe(F.col("_at")))
    return cold.select(*DOC, "_pos").unionByName(hot_lines.select(*DOC, "_pos"))


def bitmaps(dropped: DataFrame) -> DataFrame:
    """A row per document with lines to drop: its bitmap and the number of these lines.

    The bitmap has a bit for each line, 1 to keep it, in words of 64 lines. Words that keep
    all their lines are left out, the others stand in order with their number.
    """
    place = F.col("_pos")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place % WORD_BITS)
    words = dropped.groupBy(*DOC, (place / WORD_BITS).cast("int").alias("word")).agg(
        F.bitwise_not(F.bit_or(bit)).alias("bits")
    )
    return words.groupBy(*DOC).agg(
        F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("keep"),
        F.sum(F.lit(WORD_BITS) - F.bit_count("bits")).cast("long").alias("n_dropped"),
    )


def every_word(keep: Column) -> Column:
    """The words of a bitmap up to its last one, with those that were left out."""

    def with_gap(w: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(-1)).otherwise(F.get(keep, i - 1)["word"])
        gap = F.array_repeat(F.lit(-1).cast("long"), w["word"] - before - 1)
        return F.concat(gap, F.array(w["bits"]))

    return F.flatten(F.transform(keep, with_gap))


def kept_text(text: Column, keep: Column) -> Column:
    """The lines that the bitmap keeps, joined; linear in the length of the text."""

    def kept(s: Column) -> Column:
        def stays(line: Column, i: Column) -> Column:
            word = F.get(s["words"], (i / WORD_BITS).cast("int"))
            return word.isNull() | (F.getbit(word, i % WORD_BITS) == 1)

        return F.filter(s["lines"], stays)

    # an array of one struct: its fields are computed once for the whole text
    once = F.array(F.struct(lines_of(text).alias("lines"), every_word(keep).alias("words")))
    cut = F.array_join(F.transform(once, kept)[0], "\n")
    return F.when(F.size(keep) > 0, cut).otherwise(F.coalesce(text, F.lit("")))


def shared_line_bitmaps(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False,
    text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None,
) -> DataFrame:
    """``keep`` (default: all columns), ``n_lines``, ``n_dropped`` and the bitmap ``keep_lines``.

    A line is dropped where its key (``line_key``) has ``min_chars`` code points and stands
    in at least ``min_docs`` documents; with ``keep_first`` the first place by id and
    position stays. ``kept_text`` applies a bitmap. A null or empty text is one empty line,
    as is any line of blanks; an empty key is never dropped while ``min_chars`` is 1.
    Repeated rows are documents of their own for the count and share their bitmap. Rows
    without id are told apart by their text. Columns of ``docs`` named like a result give
    way to it; all other columns, whatever their name, stay.
    """
    made = ["n_lines", "n_dropped", "keep_lines"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    dropped = dropped_lines(docs, doc_id, text, min_docs, min_chars, keep_first)
    # written, so that a hot document row is split by the join below
    found = stage(bitmaps(dropped).withColumnRenamed("keep", "_keep"), "line-bitmaps")
    rows = docs.select(
        F.struct(*(docs[c] for c in keep)).alias("_row"), F.size(lines_of(docs[text])).alias("_lines"),
        *doc_columns(docs, doc_id, text),
    )
    same = rows["_text1"] == found["_text1"]
    same &= (rows["_text2"] == found["_text2"]) & rows["_doc"].eqNullSafe(found["_doc"])
    joined = rows.join(found, same, "left")
    return joined.select(
        "_row.*", F.col("_lines").cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce("_keep", F.array().cast(KEEP_TYPE)).alias("keep_lines"),
    )


ORACLE_SQL = r"""
WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
places AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM texts),
keyed AS (
  SELECT doc_id, pos, line,
         trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM places),
shared AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(s.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (s.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN shared s USING (key) GROUP BY doc_id
"""
