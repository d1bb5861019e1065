"""Standard packages: a folder with the spectra, the band axis and a contract as Parquet and JSON; splits, runs and sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import require
from ..layout import STAGE_MISSING, number, require_finite, require_rectangular, require_unique


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """One JSON document, replaced as a whole by the file system's rename."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, temp = hadoop.Path(path), hadoop.Path(path + ".tmp")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(temp, True)
    out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=1).encode()))
    out.close()
    fs.delete(target, False)
    require(fs.rename(temp, target), "WRITE_FAILED", "the document couldn't be put in place", path=path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0].lstrip("﻿"))


def write_package(df: DataFrame, axis: list[float], path: str, *, unit: str = "", task: str | None = None, overwrite: bool = False) -> dict:
    """Spectra, axis and contract; a folder that exists is refused unless overwritten. The axis keeps its unit."""
    spark = df.sparkSession
    require(overwrite or not exists(spark, path), "EXISTS", "the folder exists", path=path)
    mode = "overwrite" if overwrite else "errorifexists"
    df.write.mode(mode).parquet(f"{path}/X")
    spark.createDataFrame([(i, float(v), unit) for i, v in enumerate(axis)], "band_idx int, value double, unit string").coalesce(1).write.mode(mode).parquet(f"{path}/band_axis")
    written = spark.read.parquet(f"{path}/X")
    contract = {"shape": {"n_samples": written.count(), "n_bands": len(axis)}, "task_hint": task, "band_axis": {"unit": unit}, "columns": written.columns}
    write_json(spark, f"{path}/data_contract.json", contract)
    return contract


def read_package(spark: SparkSession, path: str, *, strict: bool = True) -> tuple[DataFrame, DataFrame, dict]:
    """(spectra, band axis, contract); strict: ids unique, one width, finite cells, counts as in the contract."""
    df, axis, contract = spark.read.parquet(f"{path}/X"), spark.read.parquet(f"{path}/band_axis"), read_json(spark, f"{path}/data_contract.json")
    require(df.count() == contract["shape"]["n_samples"] and axis.count() == contract["shape"]["n_bands"], "CONTRACT_SHAPE", "counts differ from the contract")
    if strict:
        require_unique(df, "sample_idx")
        require_rectangular(df)
        require_finite(df)
    return df, axis, contract


def repair_contract(spark: SparkSession, path: str) -> bool:
    """Set the contract's counts to those of the files; whether anything changed."""
    contract = read_json(spark, f"{path}/data_contract.json")
    shape = {"n_samples": spark.read.parquet(f"{path}/X").count(), "n_bands": spark.read.parquet(f"{path}/band_axis").count()}
    if contract["shape"] == shape:
        return False
    write_json(spark, f"{path}/data_contract.json", contract | {"shape": shape})
    return True


def nullable_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns of a later stage to x, missing texts as nulls."""
    return df.withColumn("x", F.transform(F.array(*(F.col(f"`{c}`") for c in columns)), lambda t: number(t, STAGE_MISSING, decimal_comma=False)))


def parse_split_contract(df: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(iteration_id, iteration_type, role, sample_idx) from contract texts in column ``contract``.

    Accepts role -> positions, role -> sample ids (with ids: sample_id, sample_idx), folds and repeats.
    """
    roles = "struct<train:array<long>,val:array<long>,test:array<long>>"
    schema = f"indices {roles}, sample_ids struct<train:array<string>,val:array<string>,test:array<string>>, folds array<struct<fold_id:int,train_indices:array<long>,val_indices:array<long>>>, repeats array<struct<repeat_id:int,train_indices:array<long>,val_indices:array<long>,test_indices:array<long>>>"
    c = df.select(F.from_json("contract", schema).alias("c")).select("c.*")

    def long(frame, it, kind, parts):
        rows = [frame.select(it.alias("iteration_id"), F.lit(kind).alias("iteration_type"), F.lit(role).alias("role"), F.explode(col).alias("at")) for role, col in parts.items()]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out

    hold = long(c.where("indices is not null"), F.lit("holdout"), "holdout", {r: F.col(f"indices.{r}") for r in ("train", "val", "test")})
    f = c.select(F.explode("folds").alias("f"))
    folds = long(f, F.format_string("fold_%d", F.col("f.fold_id")), "fold", {"train": F.col("f.train_indices"), "val": F.col("f.val_indices")})
    r = c.select(F.explode("repeats").alias("r"))
    repeats = long(r, F.format_string("repeat_%d", F.col("r.repeat_id")), "repeat", {x: F.col(f"r.{x}_indices") for x in ("train", "val", "test")})
    out = hold.unionByName(folds).unionByName(repeats).withColumnRenamed("at", "sample_idx")
    if ids is not None:
        named = long(c.where("indices is null and sample_ids is not null"), F.lit("holdout"), "holdout", {x: F.col(f"sample_ids.{x}") for x in ("train", "val", "test")}).withColumnRenamed("at", "sample_id")
        require(not named.join(ids, "sample_id", "left_anti").limit(1).count(), "UNKNOWN_SAMPLE", "a split names an unknown sample")
        out = out.unionByName(named.join(ids.select("sample_id", "sample_idx"), "sample_id").select("iteration_id", "iteration_type", "role", "sample_idx"))
    return out


def write_iterations(df: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """Rows of all iterations, partitioned so that reading one iteration or role prunes the rest."""
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("iteration_id", "role").parquet(path)


def read_iterations(spark: SparkSession, path: str, iteration_id=None, role: str | None = None) -> DataFrame:
    """Rows that write_iterations wrote, of one iteration or role if named: partitions prune the rest."""
    df = spark.read.parquet(path)
    require({"iteration_id", "role", "sample_idx"} <= set(df.columns), "ITERATION_PACKAGE", "this isn't a package of iterations", columns=df.columns)
    for name, value in (("iteration_id", iteration_id), ("role", role)):
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
            require(bool(df.limit(1).count()), "NO_SUCH_PART", f"the package has no rows of this {name}", value=value)
    return df


def write_split(df: DataFrame, path: str, *, overwrite: bool = False) -> dict:
    """A split (iteration_id, role, sample_idx) as a table, with a contract that counts its roles."""
    spark = df.sparkSession
    require(overwrite or not exists(spark, path), "EXISTS", "the folder exists", path=path)
    df.select("iteration_id", "role", "sample_idx").write.mode("overwrite").parquet(f"{path}/split")
    roles = spark.read.parquet(f"{path}/split").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("iteration_id").alias("iterations")).collect()
    contract = {"roles": {r["role"]: r["n"] for r in roles}, "iterations": max((r["iterations"] for r in roles), default=0)}
    write_json(spark, f"{path}/split_contract.json", contract)
    return contract


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """A split whose counts still agree with its contract."""
    df, contract = spark.read.parquet(f"{path}/split"), read_json(spark, f"{path}/split_contract.json")
    have = {r["role"]: r["n"] for r in df.groupBy("role").agg(F.count(F.lit(1)).alias("n")).collect()}
    require(have == contract["roles"], "SPLIT_CONTRACT", "the split differs from its contract", have=have, contract=contract["roles"])
    return df


def upsert_run(index: DataFrame, row: DataFrame, key: str = "run_id") -> DataFrame:
    """The run index with the row put in place of the one with its key, or added."""
    return index.join(row.select(key), key, "left_anti").unionByName(row)
