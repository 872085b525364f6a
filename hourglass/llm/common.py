"""Helpers the operators of this subpackage share: tables, written intermediates, Arrow maps."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from hourglass.session import ensure_checkpoint_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Scratch:
    """Tables written as Parquet below the cluster's shared checkpoint folder.

    ``put`` writes a frame and returns a frame that reads the written files:
    the lineage is cut, a lost executor costs no recomputation, and only the
    columns a later step needs are read. The folder is named by a fresh uuid.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        base = ensure_checkpoint_dir(spark).rstrip("/")
        self.path = f"{base}/hourglass-{label}-{uuid.uuid4().hex}"
        self._n = 0

    def put(self, df: DataFrame, name: str = "t") -> DataFrame:
        self._n += 1
        path = f"{self.path}/{self._n:03d}-{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


# Rows and bytes of a record batch that a function gets at once.
SLICE_ROWS = 1000
SLICE_BYTES = 8 << 20


def slices_of(batch: pa.RecordBatch, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows`` rows and about ``SLICE_BYTES`` bytes, one row at least:
    what a task holds besides its batch does not follow the batch's size."""
    if batch.num_rows:
        step = max(1, min(rows, int(batch.num_rows * SLICE_BYTES / max(batch.nbytes, 1))))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, rows: int = SLICE_ROWS) -> DataFrame:
    """``mapInArrow`` for a function from a slice of a record batch to a dict of columns.

    ``schema`` is a DDL string; the columns returned may be Python lists,
    numpy arrays or Arrow arrays, and are cast to the declared types.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_of(batch, rows):
                yield to_batch(fn(part), target)
        release_memory()

    return df.mapInArrow(run, schema)


def release_memory() -> None:
    """Give back what a finished task has freed: its worker process lives on, and counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # of glibc
    if trim is not None:
        trim(0)


def to_batch(columns: dict, target: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for field in target:
        col = columns[field.name]
        if not isinstance(col, (pa.Array, pa.ChunkedArray)):
            col = pa.array(col, type=field.type, from_pandas=False)
        elif col.type != field.type:
            col = col.cast(field.type)
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        arrays.append(col)
    return pa.RecordBatch.from_arrays(arrays, schema=target)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


class Generations:
    """A bounded memory of computed values in two generations.

    ``fetch`` returns a dict that holds every key asked for; what it lacks
    comes from the old generation or is computed, in one call. A full young
    generation becomes the old one, so keys in use stay and the rest goes.
    """

    def __init__(self, kept: int, compute: Callable[[list], list]):
        self.kept, self.compute = kept, compute
        self.young: dict = {}
        self.old: dict = {}

    def fetch(self, keys) -> dict:
        if len(self.young) > self.kept:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        missing = set(keys).difference(young)
        if missing:
            new = []
            for k in missing:
                v = old.get(k)
                if v is None:
                    new.append(k)
                else:
                    young[k] = v
            if new:
                young.update(zip(new, self.compute(new)))
        return young


def one_thread() -> None:
    """Keep the tokenizers library to the task's own core: for the small batches of new
    pieces its threads cost more time than they share."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings; null becomes the empty string."""
    return [t if t is not None else "" for t in batch.column(name).to_pylist()]
