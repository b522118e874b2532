"""Vectors of a table as classes of equal vectors, and their rotation to principal axes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintageline.llm.common import materialize, slices


def usable(vector: str) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    moves = F.exists(vector, lambda x: x != 0)
    return F.coalesce(F.col(vector).isNotNull() & ~bad & moves, F.lit(False))


def as_matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles; shorter vectors are filled with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return values.reshape(-1, width).astype(np.float64)
    out = np.zeros((len(sizes), width))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    places = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[rows, places] = values
    return out


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by their largest component first, so that no square overflows."""
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def vector_rows(table: DataFrame, key: str, vector: str) -> DataFrame:
    """row, id, vector, ok: the rows of a vector table, numbered and written once."""
    return materialize(
        table.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(key).alias("id"),
            F.col(vector).cast("array<double>").alias("vector"),
        ).withColumn("ok", usable("vector")),
        "vectors",
    )


def width_of(rows: DataFrame) -> int:
    return rows.where("ok").agg(F.max(F.size("vector"))).first()[0] or 0


def principal_axes(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Axes (columns) of the unit vectors' second moments and the moment along each, largest first.

    Every task sums its own moments; width x width sums reach the driver.
    """

    def moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in slices(batches, 4096):
            rows = unit(as_matrix(batch.column(0), width))
            total += rows.T @ rows
        cells = np.arange(width * width)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel())], names=["cell", "moment"])

    sums = rows.where("ok").select("vector").mapInArrow(moments, "cell long, moment double")
    table = sums.groupBy("cell").agg(F.sum("moment").alias("moment")).toPandas()
    matrix = np.zeros(width * width)
    matrix[table["cell"]] = table["moment"]
    energy, axes = np.linalg.eigh(matrix.reshape(width, width))
    return axes[:, ::-1].copy(), np.maximum(energy[::-1], 0.0)
