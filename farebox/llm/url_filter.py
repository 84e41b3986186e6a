"""URL filtering against dated lists.

A list is a log of dated entries: from a day on, a key is blocked, allowed, or taken off
the list. Entries of one key become validity intervals, each up to the next entry. A
capture looks up the keys of its URL (host, parent domains, first path segment) in the
intervals that hold on the day it was fetched; the most specific key found decides. A
later change of a list never changes the verdict on an earlier capture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farebox.staging import stage

# On one day the last of these wins, whatever the order of the rows.
ACTIONS = ["remove", "allow", "block"]


def host(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty for no absolute URL."""
    found = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), "^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    found = F.regexp_replace(F.regexp_replace(found, "^.*@", ""), ":[0-9]*$", "")
    return F.regexp_replace(found, r"\.+$", "")


def path_key(url: Column) -> Column:
    """``host/first-segment``, or null without a path segment."""
    segment = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), "^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)
    return F.when((segment != "") & (host(url) != ""), F.concat_ws("/", host(url), segment))


def lookup_keys(url: Column) -> Column:
    """Host, its parent domains of at least two labels, and the first path segment."""
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    cuts = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    domains = F.transform(cuts, lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    return F.array_distinct(F.array_compact(F.array_remove(F.concat(domains, F.array(path_key(url))), "")))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``key``, ``action`` (block or allow), ``valid_from`` and ``valid_to`` (exclusive, null: open).

    ``entries`` has ``key``, ``listed_on`` and ``action``. Rows with a null in any of them,
    or an unknown action, say nothing and are left out. Keys are compared in lower case.
    """
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.lower("action"))
    daily = (
        entries.select(F.lower("key").alias("key"), "listed_on", rank.alias("rank"))
        .where("key IS NOT NULL AND listed_on IS NOT NULL AND rank > 0")
        .groupBy("key", "listed_on").agg(F.max("rank").alias("rank"))
    )
    in_time = Window.partitionBy("key").orderBy("listed_on")
    return (
        daily.withColumn("valid_to", F.lead("listed_on").over(in_time))
        .where("rank > 1")
        .select("key", F.element_at(F.array(*map(F.lit, ACTIONS)), F.col("rank").cast("int")).alias("action"),
                F.col("listed_on").alias("valid_from"), "valid_to")
    )


def filter_captures(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_on") -> DataFrame:
    """All columns of ``captures``, ``matched_key``, ``action`` and ``kept``, a row for each row.

    ``kept`` is false if the deciding entry blocks. Captures without an active entry, a
    usable URL or a fetch day are kept, with null ``matched_key`` and ``action``. Columns
    named like a result give way to it. A host may hold most captures: the join is a plain
    equality with a range condition, whose large partitions Spark splits, and both sides
    are written tables or scans.
    """
    names = [c for c in captures.columns if c not in ("matched_key", "action", "kept")]
    rows = captures.select(*names).withColumn("_row", F.monotonically_increasing_id())
    rows = stage(rows, "url-captures")  # row numbers must not change when a task is run again
    intervals = stage(validity_intervals(entries), "url-intervals")
    looked = rows.select("_row", F.col(at).alias("_at"), F.explode(lookup_keys(F.col(url))).alias("_key"))
    active = (
        (F.col("_key") == F.col("key")) & (F.col("_at") >= F.col("valid_from"))
        & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to")))
    )
    best = (
        looked.join(intervals, active)
        .groupBy("_row").agg(F.max(F.struct(F.length("key").alias("n"), "key", "action")).alias("_best"))
    )
    return rows.join(best, "_row", "left").select(
        *names, F.col("_best.key").alias("matched_key"), F.col("_best.action").alias("action"),
        F.coalesce(F.col("_best.action") != "block", F.lit(True)).alias("kept"),
    )


def sample_list(pages: DataFrame) -> DataFrame:
    """A dated list over the keys of ``pages``: three entries a key, day and action by digest."""
    keys = pages.select(F.explode(lookup_keys(F.col("url"))).alias("key")).distinct()
    numbered = keys.select("key", F.explode(F.array(*map(F.lit, range(3)))).alias("i"))
    digest = F.md5(F.concat_ws(":", "key", F.col("i").cast("string")))
    day = F.conv(F.substring(digest, 1, 6), 16, 10).cast("int") % 730
    which = F.conv(F.substring(digest, 7, 2), 16, 10).cast("int") % 4
    return numbered.select(
        "key", F.date_add(F.lit("2023-01-01").cast("date"), day).alias("listed_on"),
        F.when(which == 0, "allow").when(which == 1, "remove").otherwise("block").alias("action"),
    )


def sample_captures(pages: DataFrame) -> DataFrame:
    """``pages`` with a fetch day made from the page id."""
    day = F.pmod(F.col("page_id") * 37, F.lit(730)).cast("int")
    return pages.select("page_id", "url", F.date_add(F.lit("2023-01-01").cast("date"), day).alias("fetched_on"))


ORACLE_SQL = r"""
WITH captures AS (
  SELECT page_id, url, CAST(DATE '2023-01-01' + CAST((page_id * 37) % 730 AS INTEGER) AS DATE) AS fetched_on,
         row_number() OVER () AS row_no,
         regexp_replace(regexp_replace(regexp_replace(regexp_extract(lower(coalesce(url, '')),
           '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\.+$', '') AS host,
         regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS segment
  FROM pages),
lookups AS (
  SELECT row_no, fetched_on, array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') AS key
  FROM (SELECT *, unnest(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1)) AS i FROM captures WHERE host <> '')
  UNION
  SELECT row_no, fetched_on, host || '/' || segment FROM captures WHERE host <> '' AND segment <> ''),
digests AS (
  SELECT key, md5(key || ':' || i) AS d FROM (SELECT DISTINCT key FROM lookups), (VALUES (0), (1), (2)) v(i)),
entries AS (
  SELECT key, DATE '2023-01-01' + CAST(CAST('0x' || substr(d, 1, 6) AS INTEGER) % 730 AS INTEGER) AS listed_on,
         CASE CAST('0x' || substr(d, 7, 2) AS INTEGER) % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 3 END AS rank
  FROM digests),
daily AS (SELECT key, listed_on, max(rank) AS rank FROM entries GROUP BY key, listed_on),
intervals AS (
  SELECT *, lead(listed_on) OVER (PARTITION BY key ORDER BY listed_on) AS valid_to FROM daily),
found AS (
  SELECT l.row_no, l.key, i.rank, row_number() OVER (PARTITION BY l.row_no ORDER BY length(l.key) DESC, l.key DESC) AS n
  FROM lookups l JOIN intervals i ON l.key = i.key AND i.rank > 1 AND l.fetched_on >= i.listed_on
    AND (i.valid_to IS NULL OR l.fetched_on < i.valid_to))
SELECT c.page_id, c.url, c.fetched_on, f.key AS matched_key,
       CASE f.rank WHEN 2 THEN 'allow' WHEN 3 THEN 'block' END AS action, coalesce(f.rank <> 3, true) AS kept
FROM captures c LEFT JOIN found f ON f.row_no = c.row_no AND f.n = 1
"""
