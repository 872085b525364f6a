"""Writers: overwrite / create-if-absent tables, typed inserts, and upsert."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourglass.sources.catalog import quote_name


def write_table(df: DataFrame, path: str, mode: str = "overwrite",
                partition_by: list[str] | None = None,
                sort_within: list[str] | None = None) -> None:
    """Write parquet. ``mode='ignore'`` is CREATE TABLE IF NOT EXISTS ... AS:
    a second run leaves an existing table untouched.

    ``sort_within`` orders rows inside each file (for example by entity) so
    that later point filters skip row groups by their min/max statistics.
    """
    if sort_within:
        df = df.sortWithinPartitions(*sort_within)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def create_table(spark: SparkSession, name: str, schema_ddl: str, path: str) -> None:
    """``CREATE TABLE IF NOT EXISTS`` of a typed parquet table at ``path``."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {quote_name(name)} ({schema_ddl}) USING parquet LOCATION '{path}'")


def insert_into(df: DataFrame, name: str) -> DataFrame:
    """``INSERT INTO name SELECT ...``: append rows by position and return the table.

    Spark's store assignment casts to the declared types (a BIGINT count into
    an INTEGER column) and raises on overflow.
    """
    df.write.insertInto(name)
    return df.sparkSession.table(name)


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """MERGE ... WHEN MATCHED UPDATE SET * WHEN NOT MATCHED INSERT *.

    Result = every source row, plus the target rows whose key is not in the
    source. Like MERGE, a target row that several source rows match is an
    error; source rows that share a key without a match are all inserted. The
    check is a filter on every source row, which no optimisation can drop,
    and nothing is collected. NULL keys match nothing, as ``=`` does.
    """
    cols = target.columns
    if sorted(cols) != sorted(source.columns):
        raise ValueError("source and target must have the same columns")
    repeated = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    clash = repeated.join(target.select(*keys), keys, "left_semi").withColumn("__clash", F.lit(True)).drop("__n")
    checked = source.join(clash, keys, "left").filter(
        F.when(F.col("__clash"), F.raise_error(F.lit("upsert: several source rows match a target row")).cast("boolean"))
        .otherwise(F.lit(True)))
    kept = target.join(source.select(*keys).distinct(), keys, "left_anti").select(*cols)
    return checked.select(*cols).unionByName(kept)


def upsert_table(source: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Merge ``source`` into the parquet table at ``path`` and return the table.

    The merged rows are first written beside the table, so the files being
    read are never the ones being overwritten; a run that fails between the
    two writes leaves the staged rows whole.
    """
    spark = source.sparkSession
    staged = f"{path.rstrip('/')}__staged_{uuid.uuid4().hex}"
    upsert(spark.read.parquet(path), source, keys).write.parquet(staged)
    spark.read.parquet(staged).write.mode("overwrite").parquet(path)
    spark.catalog.refreshByPath(path)
    return spark.read.parquet(path)


def upsert_partitions(source: DataFrame, path: str, keys: list[str], partition_by: list[str]) -> DataFrame:
    """Merge ``source`` into the table at ``path``, partitioned by ``partition_by`` (some of ``keys``).

    A row can only match rows of its own partition, so only the partitions
    that ``source`` touches are read (pruned by a semi-join on the partition
    columns) and replaced (dynamic partition overwrite); the files of all
    others stay as they are. The merged rows are written beside the table
    first, and Spark puts them in place when the whole write has succeeded: a
    run that fails before that leaves the table as it was, and one that fails
    in the last step leaves the staged rows whole, from which it can be repeated.
    """
    if not set(partition_by) <= set(keys):
        raise ValueError("the partition columns must be among the keys")
    spark = source.sparkSession
    target = spark.read.parquet(path)
    touched = source.select(*[F.col(c).alias(f"__{c}") for c in partition_by]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in partition_by]
    merged = upsert(target.join(touched, same, "left_semi"), source.select(*target.columns), keys)
    staged = f"{path.rstrip('/')}__staged_{uuid.uuid4().hex}"
    merged.write.partitionBy(*partition_by).parquet(staged)
    (spark.read.schema(target.schema).parquet(staged).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path))
    spark.catalog.refreshByPath(path)
    return spark.read.schema(target.schema).parquet(path)


def write_by_month(rentals: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Hourly rentals partitioned by month (``rental_month``, yyyy-MM), each file sorted by station and hour."""
    by_month = rentals.withColumn("rental_month", F.date_format("hour", "yyyy-MM"))
    (by_month.repartition("rental_month", "station_id").sortWithinPartitions("rental_month", "station_id", "hour")
     .write.mode(mode).partitionBy("rental_month").parquet(path))


def read_lifespans(spark: SparkSession, path: str, spans: DataFrame) -> DataFrame:
    """The rentals of some stations within their life spans, from a table of ``write_by_month``.

    spans: ``(station_id, start_date, end_date)`` of a written table, one row
    a station. The join has the month as a key, so that Spark prunes the
    months that no span touches before it lists files; the station and the
    hours are the other conditions.
    """
    months = spans.filter("start_date <= end_date").select(
        F.col("station_id").alias("__station"), "start_date", "end_date", F.explode(F.sequence(
            F.trunc("start_date", "MM"), F.trunc("end_date", "MM"), F.make_ym_interval(F.lit(0), F.lit(1)))).alias("__from"))
    months = months.select("__station", "start_date", "end_date", F.date_format("__from", "yyyy-MM").alias("rental_month"))
    rentals = spark.read.parquet(path)
    return (rentals.join(months, "rental_month").filter((F.col("station_id") == F.col("__station"))
                                                        & F.col("hour").between(F.col("start_date"), F.col("end_date")))
            .select("station_id", "hour", "rentals"))


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int, path: str,
                   sort_by: list[str] | None = None, mode: str = "overwrite") -> DataFrame:
    """Save ``df`` as a parquet table bucketed (and optionally sorted) by ``keys``.

    Joins and aggregations on ``keys`` (for example the rentals by
    station_id in the sparsity and panel plans) then read this side already
    hash-partitioned: Spark skips its shuffle. The files live at ``path``
    (an external table), e.g. under the cluster's shared warehouse.
    """
    w = df.write.mode(mode).format("parquet").option("path", path).bucketBy(buckets, *keys)
    if sort_by:
        w = w.sortBy(*sort_by)
    w.saveAsTable(table)
    return df.sparkSession.table(table)
