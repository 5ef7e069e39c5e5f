"""Vectors as binary columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors to bytes, null where they take no part. Holds one Arrow batch twice."""
    for batch in batches:
        col = batch.column(1)
        ends, values = col.offsets.to_numpy(), col.values
        bad = np.r_[0, np.cumsum(~np.isfinite(values.fill_null(np.nan).to_numpy(zero_copy_only=False)))]
        flat = values.fill_null(0).to_numpy(zero_copy_only=False)
        ok = np.asarray(col.is_valid()) & (bad[ends[1:]] == bad[ends[:-1]]) & (np.diff(ends) > 0)
        live = np.r_[0, np.cumsum(flat != 0)]
        ok &= live[ends[1:]] > live[ends[:-1]]
        raw = pa.array([flat[ends[k] : ends[k + 1]].tobytes() if ok[k] else None for k in range(len(col))], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), raw, batch.column(2)], names=["vec_id", "vec", "label"])


def packed(df: DataFrame, id_col: str, vec_col: str, label_col: str | None = None) -> tuple[DataFrame, str]:
    """(vec_id, vec binary, label string) and numpy's type of a component: float32 where the column holds floats, float64 otherwise.

    vec is null for vectors that are null, empty, all zero, or hold null or non-finite components.
    """
    kind = df.schema[vec_col].dataType.elementType.simpleString()
    name = "float" if kind == "float" else "double"
    label = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")
    plain = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{name}>").alias("vec"), label.alias("label"))
    return plain.mapInArrow(_pack, "vec_id long, vec binary, label string"), "<f4" if name == "float" else "<f8"


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows in double precision at length 1; scaled first, so that squares neither overflow nor vanish."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
