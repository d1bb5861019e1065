"""Queries by name with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

#: DuckDB: the spectra table as array and long layouts.
LONG = "spec AS (SELECT vec_id AS sample_idx, label, CASE WHEN vec_id % 10 <= 6 THEN 'train' WHEN vec_id % 10 = 7 THEN 'val' ELSE 'test' END AS role, embedding FROM embeddings), cells AS (SELECT sample_idx, label, role, unnest(range(len(embedding)))::INT AS band, unnest(embedding)::DOUBLE AS v FROM spec)"


def query(name: str, sql: str | None = None):
    """Register a query; in the SQL, ``$LONG`` stands for the layouts and ``R(...)`` rounds to six places."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = rounded(sql.replace("$LONG", LONG))
        return f

    return add


def rounded(sql: str) -> str:
    """``R(expression)`` -> rounded to six places, without a negative zero."""
    while (i := sql.find("R(")) >= 0:
        if i and (sql[i - 1].isalnum() or sql[i - 1] == "_"):
            sql = sql[:i] + "\0" + sql[i + 1 :]
            continue
        depth, j = 1, i + 2
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        sql = f"{sql[:i]}(round({sql[i + 2 : j - 1]}, 6) + 0e0){sql[j:]}"
    return sql.replace("\0", "R")
