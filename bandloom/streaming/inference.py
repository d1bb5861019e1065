"""Streaming inference: new spectra from a folder, row-wise preprocessing, a fitted model. Map-only, no state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import require
from ..operators.preprocess import FITTED, METHODS, normalise


def chain(methods: list[str], **p) -> Callable[[Column], Column]:
    """A row-wise chain as one expression; fitted methods need their statistics and are refused."""
    order, _ = normalise(methods)
    for m in order:
        require(m not in FITTED and (METHODS[m] is not None or m == "none"), "NOT_ROW_WISE", f"{m} isn't row-wise")

    def apply(x: Column) -> Column:
        for m in order:
            x = METHODS[m](x, p) if METHODS[m] else x
        return x

    return apply


def score_stream(spark: SparkSession, path: str, schema: str, methods: list[str], model=None, *, x: str = "x", files_per_trigger: int = 100, **p) -> DataFrame:
    """A streaming frame of the files that arrive under path, preprocessed and, with a model, scored."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    out = rows.withColumn("x", chain(methods, **p)(F.col(x).cast("array<double>")))
    return model.predict(out) if model else out
