"""NumPy functions of the spectra matrix over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

from . import shared

ARROW = {"double": pa.float64(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}


SPARK = {"double": DoubleType(), "string": StringType(), "array<double>": ArrayType(DoubleType())}


def matrix_of(column) -> np.ndarray:
    """Rows of equal length as a matrix."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(float) if n else np.zeros((0, 0))


def collected(df: DataFrame, *more: str) -> tuple[np.ndarray, ...]:
    """sample_idx, the matrix of x and further columns, in sample order; collected as Arrow, without a Python object per cell."""
    table = df.select("sample_idx", "x", *more).orderBy("sample_idx").toArrow().combine_chunks()
    return table["sample_idx"].to_numpy(), matrix_of(table["x"].combine_chunks()), *(table[c].to_pandas().to_numpy() for c in more)


def with_columns(df: DataFrame, f: Callable[[np.ndarray], dict], kinds: dict[str, str], x: str = "x") -> DataFrame:
    """df with the columns that f makes of the matrix of x; a column of the same name is replaced."""
    schema = StructType([c for c in df.schema.fields if c.name not in kinds])
    for name, kind in kinds.items():
        schema = schema.add(name, SPARK[kind])
    kept = [c.name for c in df.schema.fields if c.name not in kinds]

    def run(batches):
        for batch in batches:
            at = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            made = f(matrix_of(at(x))) if batch.num_rows else {}
            new = [pa.array(list(made[c]) if batch.num_rows else [], ARROW[k]) for c, k in kinds.items()]
            yield pa.RecordBatch.from_arrays([*map(at, kept), *new], [*kept, *kinds])

    shared.ship(df.sparkSession)
    return df.mapInArrow(run, schema)
