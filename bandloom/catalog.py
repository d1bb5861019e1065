"""Every query of the spectra engine by name, with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import functools

from . import registry
from .functions import shared
from .plans import q_model, q_preprocess, q_quality, q_read, q_search, q_split  # noqa: F401  (they register their queries)


def _shipped(f):
    @functools.wraps(f)
    def run(spark, sf_dir):
        shared.ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _shipped(f) for name, f in registry.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
