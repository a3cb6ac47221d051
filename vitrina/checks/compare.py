"""Run registered queries and their SQL side by side."""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


# Spark type name to DuckDB type name.
TYPES = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def spark_rows(df: DataFrame) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def duck_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    relation = con.sql(sql)
    order = sorted(range(len(relation.columns)), key=lambda i: relation.columns[i])
    rows = [tuple(r[i] for i in order) for r in relation.fetchall()]
    return [relation.columns[i] for i in order], sorted(rows, key=repr)


def difference(spark: SparkSession, con, fn, sql: str | None, sf_dir: str) -> str:
    """Empty when equal, else a short description."""
    df = fn(spark, sf_dir)
    names, rows = spark_rows(df)
    if sql is None:
        return "" if rows else "no rows"
    ours = {name: TYPES.get(kind, kind) for name, kind in df.dtypes}
    theirs = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    if ours != theirs:
        return f"types {sorted(set(ours.items()) ^ set(theirs.items()))}"
    other_names, other = duck_rows(con, sql)
    if names != other_names:
        return f"columns {names} != {other_names}"
    if len(rows) != len(other):
        return f"{len(rows)} rows != {len(other)}"
    unequal = [(a, b) for a, b in zip(rows, other, strict=True) if repr(a) != repr(b)]
    if unequal:
        return f"{len(unequal)} of {len(rows)} rows differ, first: {str(unequal[0])[:600]}"
    return ""


def main() -> None:
    from vitrina.checks.oracle import oracle_sql
    from vitrina.checks.queries import REGISTRY
    from vitrina.session import drop_working_tables, local_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf_dir), oracle_sql()
    for name in wanted or REGISTRY:
        start = time.time()
        try:
            found = difference(spark, con, REGISTRY[name], sql.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001 - a report goes on with the next query
            found = f"{type(error).__name__}: {str(error)[:600]}"
        kind = "sql" if name in sql else "rows"
        print(f"{name:26s} {kind:4s} {time.time() - start:6.1f}s {found or 'ok'}", flush=True)
    drop_working_tables(spark)


if __name__ == "__main__":
    main()
