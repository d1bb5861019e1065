"""Pieces of DuckDB SQL that several queries share."""

from __future__ import annotations


def solved(source: str, n: int, key: str = "c") -> str:
    """CTE ``g``: Gauss-Jordan elimination of the cells (key, i, j, v) of source, n rows from 0; at k = n the columns from n on hold the solution.

    The pivot of step k is the cell (k, k) at that k, so the product of those is the determinant.
    """
    return f"""g AS (SELECT 0 AS k, {key}, i, j, v FROM {source} UNION ALL SELECT k + 1, {key}, i, j, CASE WHEN i = k THEN r / p ELSE v - f * r / p END FROM (SELECT *,
        max(v) FILTER (WHERE i = k AND j = k) OVER (PARTITION BY {key}) AS p, max(v) FILTER (WHERE i = k) OVER (PARTITION BY {key}, j) AS r, max(v) FILTER (WHERE j = k) OVER (PARTITION BY {key}, i) AS f FROM g WHERE k < {n}))"""
