"""Roles and layout: which columns are ids, labels, metadata and bands, and reading them strictly."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NeedsConfirmation, require
from ..layout import number, unreadable

#: Column names that suggest a role, parts of names that suggest a target, and headers of bands.
ID_NAMES = ("sample_id", "sampleid", "sample", "id", "name", "unnamed: 0", "样本编号", "样品编号", "编号")
ID_TOKENS = ("sample", "样本")
LABEL_NAMES = ("label", "class", "category", "type", "group", "类别", "等级", "分类", "品种", "产地")
TARGET_TOKENS = ("target", "value", "content", "concentration", "amount", "含量", "浓度", "指标")
METADATA_NAMES = ("remark", "remarks", "note", "notes", "no.", "no", "index", "batch", "date", "operator", "备注", "序号", "批次", "日期", "仪器")
BAND_HEADER = r"(?i)^\s*(?:wl_|band_)?\d+(?:\.\d+)?\s*(?:nm|cm-?1|cm⁻¹)?\s*$"


@dataclass
class Layout:
    """Resolved roles of the columns of a wide table."""

    bands: list[str]
    id: str | None = None
    label: str | None = None
    targets: list[str] = field(default_factory=list)
    metadata: list[str] = field(default_factory=list)


def is_band(name: str) -> bool:
    return re.match(BAND_HEADER, name.strip()) is not None


def evidence(columns: list[str]) -> dict[str, list[str]]:
    """Columns by the role that their names suggest."""
    low = {c: c.strip().lower() for c in columns}
    return {
        "id": [c for c in columns if low[c] in ID_NAMES or any(t in low[c] for t in ID_TOKENS)], "label": [c for c in columns if low[c] in LABEL_NAMES],
        "target": [c for c in columns if any(t in low[c] for t in TARGET_TOKENS)],
        "metadata": [c for c in columns if low[c] in METADATA_NAMES], "band": [c for c in columns if is_band(c)],
    }


def infer(columns: list[str]) -> Layout:
    """A layout by names alone; ambiguous roles must be confirmed by the caller."""
    e = evidence(columns)
    for role in ("id", "label"):
        if len(e[role]) > 1:
            raise NeedsConfirmation("ROLE_AMBIGUOUS", f"several columns could be the {role}", columns=e[role])
    require(bool(e["band"]), "NO_BANDS", "no column looks like a band")
    require(not (e["label"] and e["target"]), "LABEL_AND_TARGET", "a label and a target can't both be taken", label=e["label"], target=e["target"])
    return Layout(e["band"], next(iter(e["id"]), None), next(iter(e["label"]), None), e["target"], e["metadata"])


def axis_value(name: str) -> float | None:
    """The first signed number in a header."""
    found = re.search(r"[-+]?\d+(?:\.\d+)?", name)
    return float(found[0]) if found else None


def column_range(columns: list[str], spec: str) -> list[str]:
    """``start..end``, inclusive: by name, then by number (900 = 900.0), then by position from 1."""
    ends = [s.strip() for s in spec.split("..")]
    require(len(ends) == 2, "COLUMN_RANGE", "a range is written start..end", spec=spec)

    def find(end: str) -> int:
        if end in columns:
            return columns.index(end)
        try:
            value = float(end)
        except ValueError:
            value = None
        if value is not None:
            for i, c in enumerate(columns):
                if is_band(c) and axis_value(c) == value:
                    return i
            if value == int(value) and 1 <= value <= len(columns):
                return int(value) - 1
        require(False, "COLUMN_RANGE", "a range end doesn't exist", end=end)

    a, b = find(ends[0]), find(ends[1])
    require(a <= b, "COLUMN_RANGE", "the range ends before it starts", spec=spec)
    return columns[a : b + 1]


def band_indices(spec: str, width: int, base: int = 0) -> list[int]:
    """``1,3:5,7-6``: inclusive runs, up or down, each position once in the order named."""
    out: list[int] = []
    for part in spec.split(","):
        found = re.fullmatch(r"\s*(\d+)\s*(?:[:-]\s*(\d+)\s*)?", part)
        require(found is not None, "BAND_INDEX", "a position or a run of positions is expected", text=part)
        a, b = int(found[1]), int(found[2] or found[1])
        for i in range(a, b + (1 if b >= a else -1), 1 if b >= a else -1):
            require(0 <= i - base < width, "BAND_INDEX", "a position is outside the bands", position=i)
            if i - base not in out:
                out.append(i - base)
    return out


def numeric_block(columns: list[str], least: int = 50) -> tuple[list[str], str | None]:
    """The longest strictly monotonic run of numeric headers, and a guess of its unit."""
    best: list[str] = []
    run: list[str] = []
    sign = 0
    for c in [*columns, ""]:
        v = axis_value(c) if is_band(c) else None
        last = axis_value(run[-1]) if run else None
        step = 0 if v is None or last is None else (v > last) - (v < last)
        if v is not None and run and step and sign in (0, step):
            run.append(c)
            sign = step
        else:
            best = max(best, run, key=len)
            run, sign = ([run[-1], c], step) if v is not None and run and step else (([c], 0) if v is not None else ([], 0))
    if len(best) < least:
        return [], None
    a, b = axis_value(best[0]), axis_value(best[-1])
    unit = "cm-1" if a > b and 100 <= b and a <= 10000 else "nm" if a < b and 100 <= a and b <= 20000 else None
    return best, unit


def project(df: DataFrame, layout: Layout, *, key: str = "_row") -> DataFrame:
    """sample_idx, sample_id, label, targets, meta and x from a wide table of texts; a cell that is no number is an error.

    Cells go into one array, not one expression per column, so the plan stays small for thousands of bands.
    """
    require(not (layout.label and layout.targets), "LABEL_AND_TARGET", "a label and a target can't both be taken")
    cells = F.array(*(F.col(f"`{c}`").cast("string") for c in layout.bands))
    ids = generated_ids(F.col(key)) if layout.id is None else F.col(f"`{layout.id}`").cast("string")
    pairs = lambda names, f: F.map_from_arrays(F.array(*(F.lit(c) for c in names)), F.array(*(f(F.col(f"`{c}`")) for c in names))) if names else F.lit(None)
    strict = lambda c: F.when(unreadable(c), F.raise_error(F.concat(F.lit("NON_NUMERIC_CELL: "), c)).cast("double")).otherwise(number(c))
    return df.select(
        F.col(key).cast("long").alias("sample_idx"), ids.alias("sample_id"), (F.col(f"`{layout.label}`").cast("string") if layout.label else F.lit(None).cast("string")).alias("label"),
        pairs(layout.targets, lambda c: number(c.cast("string"))).cast("map<string,double>").alias("targets"), pairs(layout.metadata, lambda c: c.cast("string")).cast("map<string,string>").alias("meta"), F.transform(cells, strict).alias("x"),
    )


def generated_ids(position, width: int = 3):
    """sample_001, ... by position from 1."""
    return F.concat(F.lit("sample_"), F.when(F.length((position + 1).cast("string")) >= width, (position + 1).cast("string")).otherwise(F.lpad((position + 1).cast("string"), width, "0")))


def fill_ids(df: DataFrame) -> DataFrame:
    """Missing sample ids become generated ones that no sample has yet."""
    own = F.when(F.trim("sample_id") != "", F.trim("sample_id"))
    out = df.withColumn("sample_id", own)
    made = out.where("sample_id is null").select("sample_idx", generated_ids(F.col("sample_idx")).alias("made"))
    taken = made.join(out.select(F.col("sample_id").alias("made")), "made", "left_semi").select("sample_idx").withColumn("clash", F.lit(True))
    both = out.join(taken, "sample_idx", "left")
    name = F.when(F.col("clash"), F.concat(generated_ids(F.col("sample_idx")), F.lit("_gen"))).otherwise(generated_ids(F.col("sample_idx")))
    return both.withColumn("sample_id", F.coalesce("sample_id", name)).drop("clash")


def column_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, share of numbers, numeric): a column of texts is numeric if four fifths are."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("t")) for c in columns))).alias("s")).select("s.*")
    share = F.avg(number(F.col("t")).isNotNull().cast("double"))
    return long.groupBy("column").agg(share.alias("share"), (share >= 0.8).alias("numeric"))


def task_type(df: DataFrame, y: str, hint: str | None = None) -> str:
    """classification or regression: by the hint, else by whether every value is a number."""
    if hint:
        return "regression" if "regress" in hint.lower() else "classification"
    row = df.agg(F.bool_and(F.col(y).cast("string").try_cast("double").isNotNull()).alias("n")).first()
    return "regression" if row.n else "classification"


def group_column(columns: list[str]) -> str | None:
    from .split import GROUP_COLUMNS

    return next((c for c in GROUP_COLUMNS if c in columns), None)


def audit(df: DataFrame, axis: list[float], forbidden: list[str]) -> list[str]:
    """Warnings after reading: lengths, axis order, role columns among the bands, suspicious sizes."""
    out = []
    row = df.agg(F.min(F.size("x")).alias("lo"), F.max(F.size("x")).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if row.lo != row.hi or row.lo != len(axis):
        out.append("FEATURE_LENGTH")
    steps = [b - a for a, b in zip(axis, axis[1:])]
    if steps and not (all(s > 0 for s in steps) or all(s < 0 for s in steps)):
        out.append("AXIS_NOT_MONOTONIC")
    if forbidden:
        out.append("ROLE_COLUMN_IN_X")
    if len(axis) < 3 or (row.n and len(axis) > 100 * row.n):
        out.append("SUSPICIOUS_FEATURE_COUNT")
    return out
