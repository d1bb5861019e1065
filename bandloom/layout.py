"""Spectra as DataFrames: one row per sample with an array of bands, or one row per cell.

Array layout: ``sample_idx, x array<double>`` and whatever else a sample carries. Long layout:
``sample_idx, band, v``. Work along a spectrum stays in the array layout (no shuffle); work down a
band goes over the long layout, where sums combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import require

#: Texts that mean a missing cell, in readers and in later stages.
READER_MISSING = ("", "na", "n/a", "nan", "null", "none", "missing", "--", "-", ".")
STAGE_MISSING = ("", "na", "nan", "null", "none", "missing")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table as spectra: sample_idx, label, role and x."""
    df = table(spark, sf_dir, "embeddings")
    return df.select(F.col("vec_id").alias("sample_idx"), "label", role(F.col("vec_id")).alias("role"), F.col("embedding").cast("array<double>").alias("x"))


def role(idx: Column) -> Column:
    """A fixed train, val or test role by position: seven, one and two of each ten."""
    return F.when(idx % 10 <= 6, "train").when(idx % 10 == 7, "val").otherwise("test")


def to_long(df: DataFrame, *keep: str, x: str = "x") -> DataFrame:
    """One row per cell: the kept columns, band (from 0) and v."""
    return df.select(*keep, F.posexplode(x).alias("band", "v"))


def to_array(df: DataFrame, *keys: str, v: str = "v") -> DataFrame:
    """One row per key with x in band order."""
    cells = F.array_sort(F.collect_list(F.struct("band", v)))
    return df.groupBy(*keys).agg(F.transform(cells, lambda c: c[v]).alias("x"))


def number(text: Column, missing=READER_MISSING, decimal_comma: bool = True) -> Column:
    """A cell as double: missing texts, non-finite and unreadable ones give null; a comma is a decimal point if there is no other."""
    t = F.trim(text)
    if decimal_comma:
        t = F.when((F.instr(t, ",") > 0) & (F.instr(t, ".") == 0), F.replace(t, F.lit(","), F.lit("."))).otherwise(t)
    v = F.when(F.lower(F.trim(text)).isin(*missing), None).otherwise(t).try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def unreadable(text: Column, missing=READER_MISSING) -> Column:
    """A cell that is neither missing nor a number."""
    return text.isNotNull() & ~F.lower(F.trim(text)).isin(*missing) & number(text, missing).isNull()


def require_unique(df: DataFrame, key: str) -> None:
    twice = df.groupBy(key).count().where(F.col("count") > 1).limit(1).collect()
    require(not twice, "DUPLICATE_ID", f"{key} isn't unique", example=[r[key] for r in twice])


def require_rectangular(df: DataFrame, x: str = "x") -> None:
    row = df.agg(F.min(F.size(x)).alias("lo"), F.max(F.size(x)).alias("hi")).first()
    require(row.lo == row.hi, "RAGGED_MATRIX", "samples have different numbers of bands", least=row.lo, most=row.hi)


def require_finite(df: DataFrame, x: str = "x") -> None:
    bad = df.where(F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))).limit(1).count()
    require(not bad, "NON_FINITE", "a matrix for this stage must hold finite numbers only")
