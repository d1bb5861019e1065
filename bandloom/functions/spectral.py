"""Functions along one spectrum, as expressions over an array column; they need no shuffle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F



def r6(c: Column) -> Column:
    """Six places, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def r6_column(c: Column) -> Column:
    """r6 of a plain column, for tables of very many rows: by a division where the seventh place decides, else by way of decimals."""
    scaled = c * F.lit(1e6)
    plain = (F.abs(c) < F.lit(1e6)) & (F.abs(scaled - F.floor(scaled) - F.lit(0.5)) > F.lit(1e-3))
    return F.when(plain, F.floor(scaled + F.lit(0.5)) / F.lit(1e6)).otherwise(r6(c))


def let(body, **values: Column) -> Column:
    """body(v) with v.name bound to each value once: a lambda evaluates what it captures for every element."""
    return F.element_at(F.transform(F.array(F.struct(*(c.alias(k) for k, c in values.items()))), body), 1)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def var0(x: Column) -> Column:
    """Population variance (divisor n)."""
    return F.aggregate(x, F.struct(F.lit(0.0).alias("m"), F.lit(0.0).alias("s"), F.lit(0.0).alias("n")), lambda a, v: F.struct((a["m"] + (v - a["m"]) / (a["n"] + 1)).alias("m"), (a["s"] + (v - a["m"]) * (v - (a["m"] + (v - a["m"]) / (a["n"] + 1)))).alias("s"), (a["n"] + 1).alias("n")), lambda a: a["s"] / a["n"])


def std0(x: Column) -> Column:
    return F.sqrt(var0(x))


def std1(x: Column) -> Column:
    """Sample standard deviation (divisor n - 1, at least 1)."""
    return F.sqrt(var0(x) * F.size(x) / F.greatest(F.size(x) - 1, F.lit(1)))


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def diff(x: Column) -> Column:
    """First differences."""
    return F.zip_with(F.slice(x, 2, F.size(x) - 1), F.slice(x, 1, F.size(x) - 1), lambda b, a: b - a)


def over(x: Column, scale: Column, code: str) -> Column:
    """x / scale, an error where the scale is zero."""
    safe = F.when(scale == 0, F.raise_error(F.lit(code)).cast("double")).otherwise(scale)
    return let(lambda r: F.transform(r["x"], lambda v: v / r["s"]), x=x, s=safe)


def matvec(matrix: np.ndarray, x: Column) -> Column:
    """matrix @ x for a fixed matrix, row by row over the non-zero entries."""
    rows = []
    for row in matrix:
        at = np.flatnonzero(row)
        lo, hi = (int(at[0]), int(at[-1]) + 1) if len(at) else (0, 1)
        rows.append(F.struct(F.lit(lo + 1).alias("lo"), F.array(*(F.lit(float(w)) for w in row[lo:hi])).alias("w")))
    return let(lambda t: F.transform(F.array(*rows), lambda r: total(F.zip_with(F.slice(t["x"], r["lo"], F.size(r["w"])), r["w"], lambda v, w: v * w))), x=x)
