"""Adding up fixed-size arrays that many tasks yield, without gathering them in one place; and names of columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Parts that an array travels in, and tasks that add them up.
PARTS, TASKS = 64, 16


def free(name: str, columns: list[str]) -> str:
    """A column name like ``name`` that no column has, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts_of(total: np.ndarray) -> pa.RecordBatch:
    """Rows (part, data) of an array of float64."""
    parts = np.array_split(total, PARTS)
    return pa.RecordBatch.from_arrays(
        [pa.array(range(PARTS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "data"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = np.frombuffer(data)
            total[part] = total[part] + data if part in total else data
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "data"])


def added(rows: DataFrame) -> np.ndarray:
    """The sum of the arrays whose parts ``rows`` (part, data) holds; empty without rows. One array reaches the driver."""
    found = {r["part"]: r["data"] for r in rows.repartition(TASKS, "part").mapInArrow(_added, "part int, data binary").collect()}
    return np.concatenate([np.frombuffer(found[p]) for p in sorted(found)]) if found else np.zeros(0)
