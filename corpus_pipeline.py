"""A corpus pipeline of five stages over ``documents``.

Quality classifier, near-duplicate removal, benchmark decontamination, personal data and
tokens. Each stage is written as Parquet in the shared folder and read again by the next,
so a lost executor costs a part of one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.llm import bpe, decontamination, jaccard_join, pii, quality_classifier
from farebox.llm.tables import ship_code, table
from farebox.staging import stage

SHINGLE_WORDS, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score of one half or more)."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model).where("score >= 0.5").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of similar shingle sets: the one with the smallest id.

    Every row is compared, whatever its id. Rows without an id come last; of rows with one
    id the first by a hash of their other columns stays. Rows without words are equal to
    none and stay, but for full repeats of a row with an id.
    """
    ship_code(spark)
    others = F.xxhash64(*(c for c in docs.columns if c != "doc_id"))
    rows = docs.select("*", F.monotonically_increasing_id().alias("_row"), others.alias("_order"))
    rows = stage(rows, "pipeline-rows")  # row numbers hold once they are written
    found = jaccard_join.similar_components(
        rows.select(F.col("_row").alias("doc_id"), "text"), k=SHINGLE_WORDS, percent=PERCENT
    ).withColumnsRenamed({"doc_id": "_row"})
    wordless = F.col("n_shingles") == 0
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_order", "_row"))
    leading = (
        rows.select("_row", "doc_id", "_order").join(found, "_row")
        .groupBy(
            F.when(~wordless, F.col("component_id")), F.when(wordless, F.col("doc_id")),
            F.when(wordless, F.col("_order")), F.when(wordless & F.col("doc_id").isNull(), F.col("_row")),
        )
        .agg(first.alias("_first")).select("_first._row")
    )
    return rows.join(leading, "_row", "left_semi").select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"), short_items=True)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind; sizes follow."""
    found = pii.find_spans(docs)
    clean = pii.redact(F.col("text"), F.col("spans"))
    found = found.withColumn("_clean", clean)
    size = F.when(F.size("spans") > 0, F.length("_clean").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("text", F.col("_clean")).withColumn("n_chars", size).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids."""
    ship_code(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode_texts(docs, path, results=["n_tokens", "ids", "ids_sha256", "decoded_sha256"])


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("personal data", personal_data),
    ("BPE encoding and decoding", tokens),
]

# The classifier, the similarity join and the token ids are beyond SQL; tests hold the
# stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
