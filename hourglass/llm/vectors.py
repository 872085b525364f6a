"""Helpers for vector operators: checked vectors as packed doubles, equal vectors as classes."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourglass.llm.common import map_batches


def packed_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vec binary, cls long): vectors as little-endian doubles, ``cls`` the number of an
    equal vector's class. Both are null for a vector that is null, empty, zero or not finite."""
    def run(batch):
        vec, cls = [], []
        for v in batch.column("v").to_pylist():
            x = None if v is None or any(c is None for c in v) else np.array(v, np.float64) + 0.0
            if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
                vec.append(None)
                cls.append(None)
            else:
                vec.append(x.tobytes())
                cls.append(int.from_bytes(hashlib.sha256(vec[-1]).digest()[:8], "little", signed=True))
        return {"vec_id": batch.column("vec_id"), "vec": vec, "cls": cls}

    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return map_batches(rows, run, "vec_id long, vec binary, cls long")


def matrices(blobs: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Packed vectors by dimension: (places in the list, matrix)."""
    sizes = np.array([len(b) // 8 for b in blobs])
    return {int(d): (np.flatnonzero(sizes == d),
                     np.frombuffer(b"".join(b for b in blobs if len(b) == d * 8), np.float64).reshape(-1, int(d)))
            for d in np.unique(sizes)}


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that nothing overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
