"""Tables the queries read, and the code that their tasks need."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


BATCH_ROWS = 1000


def ship_code(spark: SparkSession) -> None:
    """Make a session ready: the package for the executors, and small batches.

    Tasks import the package, and executors need not have it installed. Spark hands rows to
    Python in batches of a number of rows; texts are long, so it is held at ``BATCH_ROWS``.
    """
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(batch)) <= BATCH_ROWS:
        spark.conf.set(batch, BATCH_ROWS)
    app = spark.conf.get("spark.app.id")
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="farebox-code-")) / "farebox-code.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def text_last(docs: DataFrame, text: str, keep: list[str]) -> tuple[DataFrame, int]:
    """``keep`` and the text for a task, and the text's column; it travels once."""
    if text in keep:
        return docs.select(*keep), keep.index(text)
    return docs.select(*keep, docs[text].alias("__text")), len(keep)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
