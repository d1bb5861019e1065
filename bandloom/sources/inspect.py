"""Looking before reading: layouts, roles of a folder's files, paths, read plans, and checks of what was read."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NeedsConfirmation, require
from ..layout import READER_MISSING, number, unreadable
from ..operators import project as P
from . import text

#: Parts of file names that suggest a role, in the order in which they are tried.
ROLE_TOKENS = (
    ("label", ("label", "labels", "target", "targets", "class", "classes", "y")),
    ("metadata", ("metadata", "meta", "sample_info", "sample-info", "sampleinfo")),
    ("band_axis", ("band", "bands", "wavelength", "wavelengths", "wavenumber", "wavenumbers")),
)
#: Suffixes of files that can be read.
SUFFIXES = ("csv", "tsv", "txt", "dat", "asc", "xlsx", "xls", "xlsm", "ods", "npy", "npz", "mat", "h5", "hdf5", "nc", "json")
TEXT_SUFFIXES = ("csv", "tsv", "txt", "dat", "asc")
#: Fields of a read plan that must be given, and what each mode needs besides.
PLAN_FIELDS = ("source_path", "mode", "read_plan_status")
MODE_FIELDS = {"samples_as_rows": ("band_columns",), "samples_as_columns": ("band_axis_column",), "external_label_file": ("band_columns", "label_file", "join_key"), "one_file_per_sample": ()}


def samples_as_columns(names: list[str], rows: list[list[str]]) -> dict:
    """Whether a table has bands down and samples across: its first column and its other cells are four fifths numbers."""
    value = lambda t: number_or_none(t)
    first = [r[0] for r in rows if r]
    numbers = [v for v in map(value, first) if v is not None]
    cells = [c for r in rows for c in r[1:]]
    shares = [len(numbers) / len(first) if first else 0.0, sum(value(c) is not None for c in cells) / len(cells) if cells else 0.0]
    steps = [b - a for a, b in zip(numbers, numbers[1:])]
    found = min(shares) >= 0.8 and len(names) > 2
    return {"candidate": found, "band_axis_column": names[0] if names else None, "first_numeric": round(shares[0], 3), "cells_numeric": round(shares[1], 3), "monotonic": bool(steps) and (all(s > 0 for s in steps) or all(s < 0 for s in steps))}


def number_or_none(cell: str) -> float | None:
    t = str(cell).strip()
    if t.lower() in READER_MISSING:
        return None
    try:
        return float(t.replace(",", ".") if "," in t and "." not in t else t)
    except ValueError:
        return None


def listing(spark: SparkSession, path: str) -> list[str]:
    """The files below a folder, by name."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True)
    out = []
    while files.hasNext():
        out.append(files.next().getPath().toString())
    return sorted(out)


def folder_roles(spark: SparkSession, path: str, limit: int = 50) -> dict[str, list[str]]:
    """Files of a folder by the role that their names or, for spectra, their headers suggest. The first ``limit`` text files are looked into."""
    out: dict[str, list[str]] = {"spectra": [], "label": [], "metadata": [], "band_axis": []}
    seen = 0
    for file in listing(spark, path):
        name = file.rsplit("/", 1)[-1].lower()
        suffix = name.rsplit(".", 1)[-1]
        if suffix not in SUFFIXES:
            continue
        role = next((r for r, tokens in ROLE_TOKENS if any(t in name for t in tokens)), None)
        if role is None and suffix in TEXT_SUFFIXES and seen < limit:
            seen += 1
            role = "spectra" if _has_spectra(text.preview(spark, file)) else None
        if role:
            out[role].append(file)
    return out


def _has_spectra(sample: list[str]) -> bool:
    delimiter = text.sniff_delimiter(sample)
    if delimiter is None:
        return False
    at = text.header_row(sample, delimiter)
    names, *rows = csv.reader(sample[at:], delimiter=delimiter)
    found = P.evidence(names)
    numeric = sum(1 for i in range(len(names)) if [r for r in rows if i < len(r)] and sum(number_or_none(r[i]) is not None for r in rows if i < len(r)) >= 0.8 * sum(i < len(r) for r in rows))
    return bool(found["band"]) or samples_as_columns(names, rows)["candidate"] or (bool(found["id"]) and numeric >= 2) or numeric >= 3


def choose_files(roles: dict[str, list[str]], **named: str | None) -> dict[str, str | None]:
    """One file per role: the named one or the only one; several spectra or label files must be chosen from."""
    out = {}
    for role, files in roles.items():
        if named.get(role) is None and len(files) > 1 and role in ("spectra", "label"):
            raise NeedsConfirmation("FILE_ROLE", f"which file holds the {role}?", candidates=files)
        out[role] = named.get(role) or (files[0] if len(files) == 1 else None)
    require(out["spectra"] is not None, "NO_SPECTRA_FILE", "no file of the folder looks like spectra")
    return out


def resolve_path(spark: SparkSession, path: str | None, *, source_dir: str | None = None, plan_dir: str | None = None, working_dir: str | None = None) -> dict:
    """The first that exists of: the path itself if absolute, below the source's folder, below the plan's, below the working folder."""
    from .package import exists

    if not path:
        return {"resolved": None, "base": None, "exists": False, "attempted": []}
    if re.match(r"^(/|[a-z][a-z0-9+.-]*:)", path):
        return {"resolved": path, "base": "absolute", "exists": exists(spark, path), "attempted": [path]}
    attempted = []
    for base, folder in (("source_dir", source_dir), ("plan_dir", plan_dir), ("working_dir", working_dir or spark._jvm.java.lang.System.getProperty("user.dir"))):
        if folder is None:
            continue
        attempted.append(f"{folder.rstrip('/')}/{path}")
        if exists(spark, attempted[-1]):
            return {"resolved": attempted[-1], "base": base, "exists": True, "attempted": attempted}
    return {"resolved": attempted[-1], "base": base, "exists": False, "attempted": attempted}


@dataclass
class PlanCheck:
    """What a read plan lacks; it may run if it is confirmed and nothing is left."""

    missing: list[str] = field(default_factory=list)
    confirmations: list[str] = field(default_factory=list)
    blocking: list[str] = field(default_factory=list)
    path: dict = field(default_factory=dict)
    ready: bool = False


def check_plan(spark: SparkSession, plan: dict, *, plan_dir: str | None = None) -> PlanCheck:
    """Fields, mode, confirmations that are still asked for, and whether the source exists."""
    out = PlanCheck([f for f in PLAN_FIELDS if not plan.get(f)], [c if isinstance(c, str) else c.get("field", "") for c in plan.get("required_confirmations") or []])
    mode = str(plan.get("mode") or "").rsplit(".", 1)[-1]
    if mode and mode not in MODE_FIELDS:
        out.blocking.append("UNSUPPORTED_MODE")
    out.missing += [f for f in MODE_FIELDS.get(mode, ()) if not plan.get(f)]
    if plan.get("read_plan_status") not in ("confirmed", "provisional", "blocked"):
        out.blocking.append("STATUS_INVALID")
    if plan.get("label_column") and plan.get("target_columns"):
        out.blocking.append("LABEL_AND_TARGET")
    out.path = resolve_path(spark, plan.get("source_path"), source_dir=plan.get("source_base_dir"), plan_dir=plan_dir)
    if not out.path["exists"] and plan.get("read_plan_status") == "confirmed":
        out.blocking.append("SOURCE_PATH_NOT_FOUND")
    out.ready = plan.get("read_plan_status") == "confirmed" and not (out.missing or out.confirmations or out.blocking)
    return out


# Checks of what was read: each raises a typed error. Counting is done in Spark.


def require_rows(df: DataFrame) -> None:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("p")).first()
    require(bool(row.n and row.p), "EMPTY_X", "the spectra have no rows or no bands", rows=row.n, bands=row.p)


def require_numeric(df: DataFrame, columns: list[str]) -> None:
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns))).alias("c")).select("c.*")
    bad = cells.where(unreadable(F.col("value"))).limit(1).collect()
    require(not bad, "X_NON_NUMERIC", "a cell of the spectra is no number", example=[tuple(r) for r in bad])


def require_aligned(df: DataFrame, other: DataFrame, code: str) -> None:
    """Labels, ids or metadata in row order: as many rows as samples."""
    n, m = df.count(), other.count()
    require(n == m, code, "a file doesn't have one row for each sample", samples=n, rows=m)


def require_axis(df: DataFrame, axis: list) -> None:
    width = df.agg(F.max(F.size("x")).alias("p")).first().p
    require(width == len(axis), "BAND_AXIS_LENGTH_MISMATCH", "the band axis has another length than the spectra", bands=width, axis=len(axis))


def require_status(status: str | None) -> None:
    require(status in ("confirmed", "blocked", "provisional"), "STATUS_INVALID", "a status is confirmed, provisional or blocked", status=status)


def require_axis_column(columns: list[str], column: str | int | None) -> None:
    require(column is not None, "BAND_AXIS_COLUMN_MISSING", "samples as columns need a band axis column")
    known = 0 <= column < len(columns) if isinstance(column, int) else column in columns
    require(known, "BAND_AXIS_COLUMN_INVALID", "the band axis column doesn't exist", column=column, columns=columns)


def require_join_key(columns: list[str], key: str | None) -> None:
    require(bool(key), "JOIN_KEY_MISSING", "the column to join labels on must be named")
    require(key in columns, "JOIN_KEY_NOT_FOUND", "the column to join labels on doesn't exist", key=key, columns=columns)


def require_labels(df: DataFrame, labels: DataFrame, key: str = "sample_id") -> None:
    """Every sample has a label, and no key has two."""
    twice = labels.groupBy(key).count().where("count > 1").limit(5).collect()
    require(not twice, "DUPLICATE_LABEL_KEYS", "a label file names a sample more than once", example=[r[key] for r in twice])
    lost = df.join(labels, key, "left_anti").select(key).limit(5).collect()
    require(not lost, "LABEL_ALIGNMENT_FAILED", "a sample has no label", example=[r[key] for r in lost])


def require_refs(spark: SparkSession, base: str, refs: dict, keys: list[str]) -> None:
    from .package import exists

    for key in keys:
        require(bool(refs.get(key)), "DATA_REF_MISSING", f"{key} is missing", key=key)
        path = refs[key] if re.match(r"^(/|[a-z][a-z0-9+.-]*:)", refs[key]) else f"{base.rstrip('/')}/{refs[key]}"
        require(exists(spark, path), "DATA_REF_NOT_FOUND", f"{key} doesn't exist", key=key, path=path)


def numeric_share(df: DataFrame, column: str) -> float:
    return df.agg(F.avg(number(F.col(f"`{column}`").cast("string")).isNotNull().cast("double")).alias("s")).first().s or 0.0
