"""All registered queries of the analytics operators, each with its DuckDB oracle where SQL can express it."""

from __future__ import annotations

from .queries import bundles, chains, forecasts, kernels, levels, models, paths, posterior, reports, series, tables  # noqa: F401  (registers)
from .queries.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
