"""Work on pairs of rows, block against block: exact at any size, a task never holds more than two blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df as a table with ``_row``, a number per row that stays the same however often it is read."""
    return shared.stored(df.withColumn("_row", F.monotonically_increasing_id()), name)


def count(n: int, size: int) -> int:
    return max(1, -(-n // size))


def cut(df: DataFrame, parts: int, block: str, key: str = "_row") -> DataFrame:
    """df with the number of its block, dealt by a hash of the key."""
    return df.withColumn(block, F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))


def against(left: DataFrame, right: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """f of every block of left (column ``_a``) with every block of right (column ``_b``); blocks are the numbers from 0."""
    n_left, n_right = (df.agg(F.max(c)).first()[0] for df, c in ((left, "_a"), (right, "_b")))
    if n_left is None or n_right is None:
        return left.sparkSession.createDataFrame([], schema)
    a = left.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n_right))))
    b = right.withColumn("_a", F.explode(F.sequence(F.lit(0), F.lit(n_left))))
    b = b.select(*(F.col(c).alias(c) for c in b.columns))  # both sides may come from one table
    tasks = min((n_left + 1) * (n_right + 1), 2000)
    shared.ship(left.sparkSession)
    return a.repartition(tasks, "_a", "_b").groupBy("_a", "_b").cogroup(b.repartition(tasks, "_a", "_b").groupBy("_a", "_b")).applyInArrow(f, schema)


def slack(q: np.ndarray, t: np.ndarray) -> float:
    """A bound on the rounding error of squared distances that are found by a matrix product."""
    return 8 * (q.shape[1] + 4) * np.finfo(float).eps * float((q**2).sum(axis=1).max(initial=0) + (t**2).sum(axis=1).max(initial=0))


def squares(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Squared distances by a matrix product, right up to slack()."""
    g = q @ (-2 * t.T)
    g += (q**2).sum(axis=1)[:, None]
    g += (t**2).sum(axis=1)
    return g


def nearest(q: np.ndarray, t: np.ndarray, k: int, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and distances of the k nearest rows of t to each row of q, nearest first, ties by order (else by index).

    A matrix product tells which rows can be among them; those are measured term by term.
    """
    k = min(k, len(t))
    at, near = np.empty((len(q), k), np.int64), np.empty((len(q), k))
    order = np.arange(len(t)) if order is None else order
    spare = 2 * slack(q, t)
    step = max(1, int(2e6 // max(1, len(t))))
    for i in range(0, len(q), step):
        g = squares(q[i : i + step], t)
        last = np.partition(g, k - 1, axis=1)[:, k - 1] + spare
        for r in range(len(g)):
            can = np.flatnonzero(g[r] <= last[r])
            d = np.sqrt(((q[i + r] - t[can]) ** 2).sum(axis=1))
            best = np.lexsort((order[can], d))[:k]
            at[i + r], near[i + r] = can[best], d[best]
    return at, near
