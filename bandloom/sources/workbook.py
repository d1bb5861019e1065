"""Workbooks by the standard library: xlsx and ods files are zipped XML. One workbook is one task."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BandloomError, require

#: Repeats of a cell or row that can only be padding.
PADDING = 10_000


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _children(node, name: str):
    return [c for c in node.iter() if _local(c.tag) == name]


def _attribute(node, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if _local(k) == name), None)


def _column(ref: str) -> int:
    """A1 -> 0, AB7 -> 27."""
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _plain(value: str | None) -> str | None:
    """Numbers without a needless fraction, as a reader would write them."""
    if value is not None and re.fullmatch(r"-?\d+\.0+", value):
        return value.split(".")[0]
    return value


def _xlsx(z: zipfile.ZipFile) -> dict[str, list[list[str | None]]]:
    part = lambda name: ElementTree.fromstring(z.read(name))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in _children(si, "t")) for si in part("xl/sharedStrings.xml") if _local(si.tag) == "si"]
    targets = {_attribute(r, "Id"): _attribute(r, "Target") for r in part("xl/_rels/workbook.xml.rels")}
    sheets = {}
    for sheet in _children(part("xl/workbook.xml"), "sheet"):
        target = targets[_attribute(sheet, "id")].lstrip("/")
        rows: list[list[str | None]] = []
        for row in _children(part(target if target.startswith("xl/") else f"xl/{target}"), "row"):
            at = int(row.get("r") or len(rows) + 1) - 1
            rows += [[] for _ in range(at - len(rows))]
            cells: list[str | None] = []
            for c in row:
                k = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (k - len(cells))
                v = next((x.text for x in c if _local(x.tag) == "v"), None)
                if c.get("t") == "s" and v is not None:
                    v = shared[int(v)]
                elif c.get("t") == "inlineStr":
                    v = "".join(t.text or "" for t in _children(c, "t"))
                cells.append(_plain(v))
            rows.append(cells)
        sheets[sheet.get("name")] = rows
    return sheets


def _ods(z: zipfile.ZipFile) -> dict[str, list[list[str | None]]]:
    sheets = {}
    for table in _children(ElementTree.fromstring(z.read("content.xml")), "table"):
        rows: list[list[str | None]] = []
        for row in _children(table, "table-row"):
            cells: list[str | None] = []
            for c in row:
                if _local(c.tag) not in ("table-cell", "covered-table-cell"):
                    continue
                v = _attribute(c, "value")
                if v is None:
                    v = "\n".join("".join(p.itertext()) for p in c if _local(p.tag) == "p") or None
                times = int(_attribute(c, "number-columns-repeated") or 1)
                cells += [_plain(v)] * (times if v is not None or times < PADDING else 0)
            times = int(_attribute(row, "number-rows-repeated") or 1)
            rows += [list(cells) for _ in range(times if any(v is not None for v in cells) or times < PADDING else 0)]
        sheets[_attribute(table, "name")] = rows
    return sheets


def sheets(content: bytes, path: str) -> dict[str, list[list[str | None]]]:
    """Rows of texts by sheet, in the workbook's order."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in ("xlsx", "xlsm"):
        return _xlsx(zipfile.ZipFile(io.BytesIO(content)))
    if suffix == "ods":
        return _ods(zipfile.ZipFile(io.BytesIO(content)))
    raise BandloomError("WORKBOOK_KIND", "this kind of workbook can't be read without its library; save it as xlsx", path=path)


def choose(names: list[str], sheet: str | int | None) -> str:
    """The named sheet, the one at a position, or the only one."""
    if sheet is None:
        require(len(names) == 1, "SHEET", "which sheet?", sheets=names)
        return names[0]
    if isinstance(sheet, int):
        require(0 <= sheet < len(names), "SHEET", "no such sheet", sheets=names)
        return names[sheet]
    require(sheet in names, "SHEET", "no such sheet", sheets=names)
    return sheet


def read_workbook(spark: SparkSession, path: str, sheet: str | int | None = None, *, header: int = 0) -> DataFrame:
    """A worksheet as a table of texts with ``_row``; empty rows and columns go, the header names the columns."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")

    def head(batches):
        import pandas as pd

        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                rows = _table(bytes(c), p, sheet)
                names = [str(v) if v is not None else f"column_{i}" for i, v in enumerate(rows[header])] if len(rows) > header else []
                yield pd.DataFrame({"names": [names]})

    def body(batches):
        import pandas as pd

        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                rows = _table(bytes(c), p, sheet)[header + 1 :]
                yield pd.DataFrame({"_row": range(len(rows)), "cells": rows})

    found = raw.mapInPandas(head, "names array<string>").first()
    require(found is not None and bool(found["names"]), "EMPTY_SHEET", "the sheet has no rows", path=path)
    names = list(found["names"])
    require(len(set(names)) == len(names), "DUPLICATE_COLUMN", "two columns have one name", columns=names)
    rows = raw.mapInPandas(body, "_row long, cells array<string>")
    return rows.select("_row", *(F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)))


def _table(content: bytes, path: str, sheet: str | int | None) -> list[list[str | None]]:
    book = sheets(content, path)
    rows = [r for r in book[choose(list(book), sheet)] if any(v not in (None, "") for v in r)]
    width = max(map(len, rows), default=0)
    rows = [r + [None] * (width - len(r)) for r in rows]
    full = [i for i in range(width) if any(r[i] not in (None, "") for r in rows)]
    return [[r[i] for i in full] for r in rows]
