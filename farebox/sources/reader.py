"""Purchases from CSV or Parquet, personas from text, results to Parquet."""

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.functions.cleaning import clean_purchases
from farebox.functions.fixed_values import (
    MISSING_TEXTS,
    PURCHASE_COLUMNS,
    TICKETS_COLUMN_NAMES,
)

# Analyses that need other columns are left out where a file lacks them.
REQUIRED_COLUMNS = ["nk_ota_localizer_id", "fk_contact", "date_purchase", "gmv_success"]


def _squeezed(name: str) -> str:
    """A name without what spellings differ in: letter case, spaces and underscores."""
    return "".join(c for c in name.casefold() if c not in " _")


def find_column(columns: list[str], wanted: list[str]) -> str | None:
    """The column that answers to one of the wanted names, or None.

    Exact names win; after that spelling is ignored. Earlier wanted names and earlier
    columns win. A part of a name is no match: ``total`` or ``quantity`` can be anything.
    """
    exact = [name for name in wanted if name in columns]
    if exact:
        return exact[0]
    by_short = {_squeezed(column): column for column in reversed(columns)}
    known = [by_short[short] for short in map(_squeezed, wanted) if short in by_short]
    return known[0] if known else None


def conform(raw: DataFrame) -> DataFrame:
    """Rename columns to the canonical names once; stop if a required one is missing."""
    renames = {}
    # Canonical columns may differ in case, spaces and underscores only; the tickets
    # column is looked up by its known spellings among what is left over.
    by_short = {_squeezed(column): column for column in reversed(raw.columns)}
    for name in PURCHASE_COLUMNS:
        source = name if name in raw.columns else by_short.get(_squeezed(name))
        if source is not None:
            renames[source] = name
    if "total_tickets_quantity_success" not in renames.values():
        rest = [column for column in raw.columns if column not in renames]
        source = find_column(rest, TICKETS_COLUMN_NAMES)
        if source is not None:
            renames[source] = "total_tickets_quantity_success"
    missing = [name for name in REQUIRED_COLUMNS if name not in renames.values()]
    if missing:
        raise ValueError(f"purchases lack the columns {', '.join(missing)}")
    return raw.withColumnsRenamed(renames)


def is_csv(path: str) -> bool:
    return path.rstrip("/").lower().endswith((".csv", ".csv.gz", ".csv.bz2", ".csv.zst"))


def _quotes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))


def files_with_broken_lines(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Files of a CSV path in which some line has an odd number of quotes, and the others.

    Such a line starts or ends a quoted value with a line break in it. These files can not
    be split at lines; each is read by one task, all others in splits.
    """
    lines = spark.read.text(path)
    odd = lines.where(_quotes(F.col("value")) % 2 == 1)
    broken = {row[0] for row in odd.select(F.input_file_name()).distinct().collect()}
    return sorted(broken), sorted(set(lines.inputFiles()) - broken)


def line_fault(line: Column, columns: int) -> Column:
    """Why a malformed line can not be a row: ``unclosed quote`` or ``surplus fields``, else
    null. A line with too few fields is a row that ends in nulls."""
    plain = F.regexp_replace(line, '"(?:[^"]|"")*+"', "")
    fields = F.length(plain) - F.length(F.replace(plain, F.lit(","), F.lit(""))) + 1
    return F.when(_quotes(line) % 2 == 1, "unclosed quote").when(fields > columns, "surplus fields")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every record of a CSV file with header, all columns as text, plus ``_fault`` and ``_line``.

    Records that can not be a row have the reason in ``_fault`` and their whole text in
    ``_line``; for all others both are null. Quoted values may hold commas and line breaks.
    Empty lines are no records. No record is dropped.
    """
    # Without inferSchema every column is text: no pass over the data for types, and
    # rejected values can be counted afterwards.
    given = spark.read.option("header", True).option("escape", '"')
    columns = given.csv(path).columns
    schema = ", ".join([f"`{c}` string" for c in columns] + ["_line string"])
    # all columns are parsed whatever is read of them, else malformed lines pass unseen
    given = given.schema(schema).option("columnNameOfCorruptRecord", "_line").option("columnPruning", False)
    broken, whole = files_with_broken_lines(spark, path)
    if not broken:
        text = given.csv(path)
    else:
        parts = [given.option("multiLine", multi).csv([unquote(f) for f in files])
                 for files, multi in ((broken, True), (whole, False)) if files]
        text = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    values = {c: F.col(f"`{c}`") for c in columns}
    # Spark refuses queries of the malformed text alone, so a value is always read with it
    nothing = F.left(F.coalesce(values[columns[0]], F.lit("")), F.lit(0))
    line = F.concat("_line", nothing)
    fault = line_fault(line, len(columns))
    return text.select(
        *[F.when(~value.isin(MISSING_TEXTS), value).alias(c) for c, value in values.items()],
        fault.alias("_fault"), F.when(fault.isNotNull(), line).alias("_line"),
    )


def good_rows(records: DataFrame) -> DataFrame:
    return records.where(F.col("_fault").isNull()).drop("_fault", "_line")


def rejected_lines(records: DataFrame) -> DataFrame:
    """``fault`` and ``line`` of the records that are no rows."""
    found = records.where(F.col("_fault").isNotNull())
    return found.select(F.col("_fault").alias("fault"), F.col("_line").alias("line"))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV file with header (every column as text) or of Parquet.

    ``read_csv`` also gives the lines that can not be rows. A path without suffix is Parquet.
    """
    if is_csv(path):
        return good_rows(read_csv(spark, path))
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    if name.endswith(".parquet") or "." not in name:
        return spark.read.parquet(path)
    raise ValueError(f"unsupported format: {path}; purchases are read from .csv, .parquet or a folder of Parquet files")


def read_purchases(spark: SparkSession, path: str) -> DataFrame:
    """Canonical, typed purchases with the derived columns."""
    return clean_purchases(conform(read_raw(spark, path)))


def read_personas(spark: SparkSession, path: str) -> DataFrame:
    """``segment: description`` lines, split at the first colon; blank lines are skipped,
    a line without colon has an empty description, the last line of a segment wins."""
    parts = F.split(F.trim("value"), ":", 2)
    return (
        spark.read.text(path)
        .where(F.trim("value") != "")
        .select(
            F.trim(F.get(parts, F.lit(0))).alias("Segment"),
            F.coalesce(F.trim(F.get(parts, F.lit(1))), F.lit("")).alias("persona"),
            F.monotonically_increasing_id().alias("line_no"),
        )
        .groupBy("Segment")
        .agg(F.max_by("persona", "line_no").alias("persona"))
    )


def write_result(result: DataFrame, path: str) -> None:
    """Write one result table as Parquet, replacing an earlier run's."""
    result.write.mode("overwrite").parquet(path)
