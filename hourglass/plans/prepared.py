"""Base tables of the registered queries, written by an explicit build step.

Without it every query computes its inputs from the given tables. ``build``
writes the base tables (hourly rentals, weather, transitions ...) once below
the shared checkpoint folder, as the reference's preparation step does, and
later queries of the session over the same folder read the written rows;
``release`` goes back to computing. Nothing is kept unless ``build`` is
called.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hourglass.session import ensure_checkpoint_dir

_BUILT: dict[tuple[str, str], dict[str, DataFrame]] = {}


def _key(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    return spark.sparkContext.applicationId, sf_dir.rstrip("/")


def base_table(spark: SparkSession, sf_dir: str, name: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The built table of that name, or its plan where none is built."""
    built = _BUILT.get(_key(spark, sf_dir), {}).get(name)
    return compute() if built is None else built


def build(spark: SparkSession, sf_dir: str, tables: dict[str, Callable[[SparkSession, str], DataFrame]]) -> None:
    """Compute and write the named base tables of ``sf_dir``, in order; earlier ones serve later ones."""
    release(spark, sf_dir)
    built = _BUILT.setdefault(_key(spark, sf_dir), {})
    for name, compute in tables.items():
        path = shared_folder(spark, name)
        compute(spark, sf_dir).write.parquet(path)
        built[name] = spark.read.parquet(path)


def release(spark: SparkSession, sf_dir: str) -> None:
    _BUILT.pop(_key(spark, sf_dir), None)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for files a query writes (under the cluster's checkpoint
    directory, i.e. shared storage; never a local temp folder)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/hourglass_files/{name}-{uuid.uuid4().hex}"
