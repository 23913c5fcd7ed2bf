"""The table of queries, and helpers that write the same literals for Spark and for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The moment that takes the place of the clock.
NOW = "2024-01-31 00:00:00"


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) as a query, with its DuckDB SQL where there is one."""

    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: key, path (source/doc_id), ext (lang), content."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("key"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("ext"), F.col("text").alias("content"))


FILES_SQL = "files as (select doc_id as key, source || '/' || doc_id as path, lang as ext, text as content from documents)"


def quoted(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(quoted, value)) + "]" if value else "[]::varchar[]"
    return str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def values_sql(name: str, columns: str, rows: list[tuple]) -> str:
    """A common table expression of literal rows; columns is Spark DDL, whose names alone are used."""
    names = ", ".join(c.split()[0] for c in columns.split(", "))
    return f"{name}({names}) as (values {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)})"


def values(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, columns)


def _names(columns: str) -> list[str]:
    return [c.split()[0] for c in columns.split(", ")]


def per_supplier(spark: SparkSession, sf_dir: str, columns: str, rows: list[tuple], changes: dict[str, str] | None = None) -> DataFrame:
    """Literal rows as a template, once for every supplier (k); changes are SQL expressions, read by both engines, that put
    the supplier into columns. What comes of it grows with the table."""
    changes = changes or {}
    each = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")).crossJoin(F.broadcast(values(spark, columns, rows)))
    names = _names(columns)
    return each.select(*[F.expr(changes[c]).alias(c) if c in changes else F.col(c) for c in names], *[F.expr(e).alias(c) for c, e in changes.items() if c not in names])


def per_supplier_sql(name: str, columns: str, rows: list[tuple], changes: dict[str, str] | None = None) -> str:
    """per_supplier() as common table expressions; template columns that change are there as base_<column> as well."""
    changes = changes or {}
    kept = [f"{changes[c]} as {c}, {c} as base_{c}" if c in changes else c for c in _names(columns)]
    return f"{values_sql(name + '_template', columns, rows)}, {name} as (select k, {', '.join(kept)} from {name}_template, (select s_suppkey as k from supplier))"
