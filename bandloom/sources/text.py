"""Delimited text, whitespace tables, transposed tables and folders with one file per sample.

Lines are numbered over the splits of a file: each line's place in its split plus the lines of the
splits before it, so a preamble, a header row or a row range can be cut by number while a large file is
read by many tasks. Files are read by Spark alone, never by open().
"""

from __future__ import annotations

import csv
import io
import re
import statistics

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NeedsConfirmation, require
from ..layout import number


def lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(n, value): the lines of one file with their number from 0. Encodings other than UTF-8 are read as a whole."""
    if encoding.lower() not in ("utf-8", "utf8"):
        raw = spark.read.format("binaryFile").load(path).select(F.decode("content", encoding).alias("value"))
        body = F.regexp_replace(F.regexp_replace("value", "^\ufeff", ""), "\r\n?", "\n")
        return raw.select(F.posexplode(F.split(F.regexp_replace(body, "\n$", ""), "\n")).alias("n", "value"))
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    # a row per split of the file
    splits = raw.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("lines")).orderBy("file", "block").collect()
    shift, before = [], 0
    for r in splits:
        shift.append((r["file"], r["block"], before - r["first"]))
        before += r["lines"]
    if len(shift) < 2:
        numbered = raw.select((F.col("id") + (shift[0][2] if shift else 0)).alias("n"), "value")
    else:
        known = spark.createDataFrame(shift, "file string, block long, shift long")
        numbered = raw.join(F.broadcast(known), ["file", "block"]).select((F.col("id") + F.col("shift")).alias("n"), "value")
    return numbered.select("n", F.when(F.col("n") == 0, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value")).alias("value"))


def preview(spark: SparkSession, path: str, limit: int = 30, encoding: str = "utf-8") -> list[str]:
    """The first lines; the limit is pushed to the scan."""
    if encoding.lower() in ("utf-8", "utf8"):
        return [r["value"].lstrip("﻿") for r in spark.read.text(path).limit(limit).collect()]
    return [r["value"] for r in lines(spark, path, encoding).orderBy("n").limit(limit).collect()]


def sniff_delimiter(sample: list[str]) -> str | None:
    """Comma, tab, semicolon or pipe: the one that divides most lines, then the most fields."""
    best = None
    for d in ",\t;|":
        fields = [len(r) for r in csv.reader(io.StringIO("\n".join(sample)), delimiter=d) if len(r) > 1]
        if fields and (best is None or (len(fields), statistics.median(fields)) > best[0]):
            best = ((len(fields), statistics.median(fields)), d)
    return best[1] if best else None


def header_row(sample: list[str], delimiter: str) -> int:
    """The line that most looks like a header: fields, names, bands and ids count; comment lines lose."""
    from ..operators.project import ID_NAMES, LABEL_NAMES, is_band

    def score(line: str) -> float:
        cells = [c.strip() for c in next(csv.reader([line], delimiter=delimiter), [])]
        names = sum(1 for c in cells if c and not re.fullmatch(r"[-+]?\d+(\.\d+)?([eE][-+]?\d+)?", c))
        return len(cells) + names + 3 * sum(map(is_band, cells)) + 4 * any(c.lower() in ID_NAMES for c in cells) + 2 * any(c.lower() in LABEL_NAMES for c in cells) - 8 * line.lstrip().startswith("#")

    return max(range(len(sample)), key=lambda i: (score(sample[i]), -i))


def flatten_header(rows: list[list[str]], join: bool = False) -> list[str]:
    """One name per column from several header rows: the last non-empty part, or all joined; repeats are numbered."""
    out: dict[str, None] = {}
    for i in range(max(map(len, rows))):
        parts = [r[i].strip() for r in rows if i < len(r) and r[i].strip()]
        name = ("_".join(parts) if join else parts[-1]) if parts else f"column_{i}"
        k, base = 2, name
        while name in out:
            name, k = f"{base}_{k}", k + 1
        out[name] = None
    return list(out)


def read_delimited(spark: SparkSession, path: str, *, delimiter: str | None = None, encoding: str = "utf-8", skiprows: int = 0, header_rows: list[int] | None = None, data_start: int | None = None, data_end: int | None = None, join_header: bool = False) -> DataFrame:
    """A table of texts with ``_row`` (data row from 0). Header and data rows are absolute line numbers; data_end is inclusive."""
    if delimiter is None:
        require(path.lower().endswith(".tsv"), "DELIMITER", "the delimiter of this file must be declared", path=path)
        delimiter = "\t"
    header_rows = [skiprows] if header_rows is None else header_rows
    require(all(h >= skiprows for h in header_rows), "HEADER_BEFORE_SKIP", "a header row lies before the skipped rows end")
    first = data_start if data_start is not None else (max(header_rows) + 1 if header_rows else skiprows)
    rows = lines(spark, path, encoding)
    keep = (F.col("n") >= first) & (F.trim("value") != "")
    if data_end is not None:
        keep = keep & (F.col("n") <= data_end)
    if header_rows:
        head = {r["n"]: r["value"] for r in rows.where(F.col("n").isin(header_rows)).collect()}
        names = flatten_header([next(csv.reader([head[n]], delimiter=delimiter)) for n in header_rows], join_header)
    else:
        line = rows.where(keep).orderBy("n").limit(1).collect()
        names = [f"column_{i}" for i in range(len(next(csv.reader([line[0]["value"]], delimiter=delimiter))) if line else 0)]
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    # guarded by keep: a later check that raises may be moved before the filter, and must not meet the header there
    parsed = F.when(keep, F.from_csv("value", F.lit(schema), {"sep": delimiter, "mode": "PERMISSIVE"}))
    return rows.where(keep).select((F.col("n") - first).alias("_row"), parsed.alias("r")).select("_row", "r.*")


def read_whitespace(spark: SparkSession, path: str, names: list[str] | None = None, skiprows: int = 0) -> DataFrame:
    """A table divided by runs of white space."""
    rows = lines(spark, path).where((F.col("n") >= skiprows) & (F.trim("value") != "")).select("n", F.split(F.trim("value"), r"\s+").alias("c"))
    if names is None:
        head = rows.orderBy("n").limit(1).collect()[0]
        names, rows = list(head["c"]), rows.where(F.col("n") > head["n"])
    return rows.select("n", *(F.get("c", F.lit(i)).alias(name) for i, name in enumerate(names))).withColumnRenamed("n", "_row")


def read_transposed(df: DataFrame, axis: str) -> DataFrame:
    """Samples as columns, one row per band -> (sample_id, x) with bands in axis order."""
    samples = [c for c in df.columns if c not in (axis, "_row")]
    long = df.unpivot([axis], samples, "sample_id", "v").select("sample_id", F.col(f"`{axis}`").cast("double").alias("axis"), number(F.col("v").cast("string")).alias("v"))
    cells = F.array_sort(F.collect_list(F.struct("axis", "v")))
    return long.groupBy("sample_id").agg(F.transform(cells, lambda c: c["v"]).alias("x"), F.transform(cells, lambda c: c["axis"]).alias("axis"))


def read_transposed_text(spark: SparkSession, path: str, *, delimiter: str = ",", encoding: str = "utf-8") -> DataFrame:
    """A text file with samples as columns -> (sample_id, x, axis); the first line names the samples, the first column is the axis.

    Samples are rows of a table of cells here, not columns of a frame, so there may be any number of them.
    """
    def parse(batches):
        for batch in batches:
            cells = [next(csv.reader([v], delimiter=delimiter), []) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.list_(pa.string()))], ["n", "cells"])

    rows = lines(spark, path, encoding)
    head = rows.where("n = 0").first()
    names = flatten_header([next(csv.reader([head["value"]], delimiter=delimiter))])[1:]
    samples = spark.createDataFrame(pa.table({"at": pa.array(range(len(names)), pa.int64()), "sample_id": pa.array(names, pa.string())}))
    body = rows.where((F.col("n") > 0) & (F.trim("value") != "")).mapInArrow(parse, "n long, cells array<string>")
    count = F.lit(len(names))
    # a short line lacks its last cells; they are missing, as in a table of columns
    full = F.transform(F.sequence(F.lit(1), count), lambda i: F.get("cells", i.cast("int"))) if names else F.array().cast("array<string>")
    long = body.select(F.get("cells", F.lit(0)).cast("double").alias("axis"), F.posexplode(full).alias("at", "v")).select("at", "axis", number(F.col("v")).alias("v"))
    cells = F.array_sort(F.collect_list(F.struct("axis", "v")))
    got = long.groupBy("at").agg(F.transform(cells, lambda c: c["v"]).alias("x"), F.transform(cells, lambda c: c["axis"]).alias("axis"))
    return samples.join(got, "at").select("sample_id", "x", "axis")


def read_folder(spark: SparkSession, path: str, *, pattern: str = "*.csv", delimiter: str = ",", label: str | None = None) -> DataFrame:
    """One two-column file per sample -> (sample_id, label, x, axis); all files must share the axis.

    label: None, ``folder`` (the first folder below the path) or ``prefix`` (of the name, before ``_``).
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("header", True).option("sep", delimiter).csv(path)
    require(len(raw.columns) >= 2, "FOLDER_COLUMNS", "a sample's file needs an axis and a value column")
    axis, value = raw.columns[:2]
    file = F.col("_metadata.file_path")
    cells = raw.select(file.alias("file"), F.col(f"`{axis}`").cast("double").alias("axis"), number(F.col(f"`{value}`")).alias("v"))
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    got = F.array_sort(F.collect_list(F.struct("axis", "v")))
    out = cells.groupBy("file").agg(F.transform(got, lambda c: c["v"]).alias("x"), F.transform(got, lambda c: c["axis"]).alias("axis"))
    same = out.agg(F.count_distinct("axis").alias("n")).first()
    require(same.n <= 1, "FOLDER_AXIS", "the files of a folder have different axes", axes=same.n)
    below = F.regexp_replace("file", "^.*" + re.escape(path.rstrip("/").split("://")[-1].lstrip("/")) + "/", "")
    name = {"folder": F.element_at(F.split(below, "/"), 1), "prefix": F.element_at(F.split(stem, "_"), 1), None: F.lit(None).cast("string")}[label]
    return out.select(stem.alias("sample_id"), name.alias("label"), "x", "axis")


def read_axis(spark: SparkSession, path: str, width: int, column: str | None = None) -> list[float]:
    """A band axis from its own file: the named or the only column; its length must fit."""
    df = spark.read.option("header", True).csv(path)
    if column is None and len(df.columns) != 1:
        raise NeedsConfirmation("AXIS_COLUMN", "which column holds the axis?", columns=df.columns)
    values = [float(r[0]) for r in df.select(f"`{column or df.columns[0]}`").collect()]
    require(len(values) == width, "AXIS_LENGTH", "the axis has another length than the spectra", axis=len(values), bands=width)
    return values


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(_row, sample_id) from its own file: column sample_id or the only one."""
    df = read_delimited(spark, path, delimiter=",")
    names = [c for c in df.columns if c != "_row"]
    require("sample_id" in names or len(names) == 1, "ID_COLUMN", "the ids' column can't be told", columns=names)
    return df.select("_row", F.col(f"`{'sample_id' if 'sample_id' in names else names[0]}`").alias("sample_id"))
