"""Registered queries of this folder: (spark, table folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.llm import (
    bpe,
    collocations,
    decontamination,
    html_extraction,
    jaccard_join,
    lexical_search,
    line_dedup,
    oracle,
    pii,
    quality_classifier,
    quality_rules,
    sharding,
    suffix_dedup,
    url_filter,
)
from farebox.llm.tables import table

VOCABULARY = "word_bpe_49k.json"


def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    found = html_extraction.extract_text(table(spark, folder, "pages"), keep=["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document under links of similar shingle sets."""
    return jaccard_join.similar_components(table(spark, folder, "documents"))


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without strings that also start earlier."""
    return suffix_dedup.remove_repeats(table(spark, folder, "documents"), keep=["doc_id"])


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of a document and a benchmark item that occurs in it."""
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return decontamination.find_leaks(docs, items, keep=["doc_id"], short_items=True)


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every page held against a dated list, as it stood on the day of the fetch."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    captures, entries = url_filter.sample_captures(pages), url_filter.sample_list(pages)
    return url_filter.filter_captures(captures, entries)


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Uniform shuffle into 24 shards under the law ``rows``."""
    text = F.col("text")
    rows = table(spark, folder, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
    )
    return sharding.shard_rows(rows, shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, folder, "documents")
    model = quality_classifier.fit(docs, table(spark, folder, "labels"))
    return quality_classifier.score(docs, model, keep=["doc_id"]).select(
        "doc_id", quality_classifier.is_held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts, divergence from the languages, and the verdict."""
    judged = quality_rules.judge(table(spark, folder, "documents"), keep=["doc_id"])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "char_distance", "word_distance",
    )


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every text."""
    found = pii.find_spans(table(spark, folder, "documents"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["kind"].isin(pii.BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}")
        for kind in pii.BASE
    ]
    return found.select(
        "doc_id", *counts, F.sha2(pii.spans_text(base), 256).alias("base_sha256"),
        pii.spans_text(F.col("spans")).alias("spans"),
    )


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every text and what they decode to, as digests."""
    return bpe.encode_texts(
        table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY),
        keep=["doc_id"], results=["n_tokens", "ids_sha256", "decoded_sha256"],
    )


def op11_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without lines that ten documents share."""
    docs = table(spark, folder, "documents")
    found = line_dedup.shared_line_bitmaps(docs, min_docs=10, min_chars=1, keep=["doc_id", "text"])
    kept = line_dedup.kept_text(F.col("text"), F.col("keep_lines"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(kept, 256).alias("kept_sha256"))


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return lexical_search.search(docs, items, top=20)


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The first 2,000 phrases of every language."""
    return collocations.collocations(table(spark, folder, "documents"), min_count=100, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_url_filter": op5_url_filter,
    "op6_sharding": op6_sharding,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_quality_rules": op8_quality_rules,
    "op9_pii": op9_pii,
    "op10_bpe": op10_bpe,
    "op11_line_dedup": op11_line_dedup,
    "op12_lexical_search": op12_lexical_search,
    "op13_collocations": op13_collocations,
}
# The others are beyond SQL: models, random draws, edit distances, token merges.
ORACLE_SQL: dict[str, str] = {
    "op2_jaccard_join": oracle.SIMILAR,
    "op3_suffix_dedup": oracle.REPEATS,
    "op5_url_filter": url_filter.ORACLE_SQL,
    "op11_line_dedup": line_dedup.ORACLE_SQL,
    "op12_lexical_search": lexical_search.ORACLE_SQL,
    "op13_collocations": collocations.ORACLE_SQL,
}
