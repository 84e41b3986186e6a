"""Row-for-row comparison of a query with its SQL in DuckDB."""

from pathlib import Path

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        path = Path(folder) / f"{table}.parquet"
        if path.exists():
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return connection


SPARK_TYPES = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
    "date": "DATE", "boolean": "BOOLEAN",
}


def _key(row: tuple) -> tuple:
    return tuple((value is not None, str(type(value)), value if value is not None else 0) for value in row)


def differences(frame, connection, sql: str) -> list[str]:
    """What differs between a Spark frame and a DuckDB query: types, rows, values."""
    result = connection.execute(sql)
    sql_types = {column[0]: str(column[1]) for column in result.description}
    sql_rows = result.fetchall()
    sql_names = [column[0] for column in result.description]
    spark_types = {name: SPARK_TYPES.get(kind, kind) for name, kind in frame.dtypes}
    problems = []
    if sorted(spark_types) != sorted(sql_types):
        return [f"columns {sorted(spark_types)} and {sorted(sql_types)}"]
    for name in spark_types:
        if spark_types[name] != sql_types[name]:
            problems.append(f"type of {name}: {spark_types[name]} and {sql_types[name]}")
    names = sorted(spark_types)
    ours = sorted((tuple(row[name] for name in names) for row in frame.collect()), key=_key)
    position = [sql_names.index(name) for name in names]
    theirs = sorted((tuple(row[i] for i in position) for row in sql_rows), key=_key)
    if len(ours) != len(theirs):
        return problems + [f"rows {len(ours)} and {len(theirs)}"]
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        problems.append(f"{len(bad)} of {len(ours)} rows, first {bad[0]}")
    return problems
