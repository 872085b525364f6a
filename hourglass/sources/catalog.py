"""Catalog helpers: name written tables so SQL users can query them.

The reference registered each written folder as a table (``CREATE TABLE ...
USING ... LOCATION``) inside its own database. These helpers do the same
through Spark's catalog API; the data stay where they were written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quote_name(name: str) -> str:
    return ".".join(f"`{part.replace('`', '``')}`" for part in name.split("."))


def register_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet",
                   database: str | None = None, replace: bool = True) -> DataFrame:
    """External table over existing files (``CREATE TABLE name USING fmt LOCATION path``)."""
    if database:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {quote_name(database)}")
    full = f"{database}.{name}" if database else name
    if replace:
        spark.sql(f"DROP TABLE IF EXISTS {quote_name(full)}")
    spark.catalog.createTable(full, path=path, source=fmt)
    return spark.table(full)


def create_table_as(df: DataFrame, name: str, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                    mode: str = "create") -> DataFrame:
    """``CREATE TABLE name USING fmt LOCATION path AS SELECT ...`` and the table.

    ``mode``: ``create`` raises where the name is taken, ``ignore`` keeps what
    is there, ``replace`` names the new files instead; as the data stay where
    they are, a replacement goes to a path of its own and readers of the old
    files are not disturbed. Rows are brought together by ``partition_by``
    before the write: a folder gets one file, or a few where it is large,
    and not one from every task.
    """
    spark = df.sparkSession
    if mode not in ("create", "ignore", "replace"):
        raise ValueError(f"mode is 'create', 'ignore' or 'replace', not {mode!r}")
    if mode == "ignore" and spark.catalog.tableExists(name):
        return spark.table(name)
    if mode == "replace":
        spark.sql(f"DROP TABLE IF EXISTS {quote_name(name)}")
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    writer = df.writeTo(quote_name(name)).using(fmt).option("path", path)
    if partition_by:
        writer = writer.partitionedBy(*[F.col(c) for c in partition_by])
    writer.create()
    return spark.table(name)


def create_view(spark: SparkSession, name: str, query: str | DataFrame, replace: bool = False) -> DataFrame:
    """A view and its rows: a SQL text makes a persistent one, over tables and views by
    name; a DataFrame a temporary one of this session. Raises where the name is taken unless ``replace``."""
    if isinstance(query, DataFrame):
        (query.createOrReplaceTempView if replace else query.createTempView)(name)
    else:
        spark.sql(f"CREATE {'OR REPLACE ' if replace else ''}VIEW {quote_name(name)} AS {query}")
    return spark.table(name)


def drop_view(spark: SparkSession, name: str) -> None:
    """``DROP VIEW IF EXISTS``: a temporary view of the name goes first, as it hides a persistent one."""
    if not spark.catalog.dropTempView(name):
        spark.sql(f"DROP VIEW IF EXISTS {quote_name(name)}")


def list_tables(spark: SparkSession, database: str) -> list[str]:
    """Names of the tables of a database, sorted (``SHOW TABLES``)."""
    return sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary)


def drop_database(spark: SparkSession, database: str) -> None:
    """``DROP DATABASE IF EXISTS ... CASCADE``: the database and its table entries."""
    spark.sql(f"DROP DATABASE IF EXISTS {quote_name(database)} CASCADE")
