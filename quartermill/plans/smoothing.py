"""Trend filtering per series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def trend(values: np.ndarray, smoothing: float = 1600.0) -> np.ndarray:
    """The x that minimises sum (y - x)^2 + smoothing * sum (second differences of x)^2.

    Missing ends stay missing; a gap inside makes all missing. The system is banded with
    two bands either side and solved by elimination in place, in time linear in the series.
    """
    out = np.full(len(values), np.nan)
    known = np.flatnonzero(np.isfinite(values))
    if not len(known):
        return out
    a, b = known[0], known[-1] + 1
    if b - a != len(known):
        return out
    y = values[a:b].astype(float)
    n = len(y)
    if n < 3 or smoothing == 0:
        out[a:b] = y
        return out
    d = np.full(n, 6.0)
    d[[0, -1]], d[[1, -2]] = 1, 5
    if n == 3:
        d[:] = (1, 4, 1)
    e = np.full(n - 1, -4.0)
    e[[0, -1]] = -2
    d, e, f, x = 1 + smoothing * d, smoothing * e, np.full(n - 2, smoothing), y.copy()
    # symmetric elimination of a five-band matrix
    for i in range(n - 1):
        m1 = e[i] / d[i]
        d[i + 1] -= m1 * e[i]
        x[i + 1] -= m1 * x[i]
        if i + 2 < n:
            m2 = f[i] / d[i]
            e[i + 1] -= m1 * f[i]
            d[i + 2] -= m2 * f[i]
            x[i + 2] -= m2 * x[i]
    for i in range(n - 1, -1, -1):
        if i + 1 < n:
            x[i] -= e[i] * x[i + 1]
        if i + 2 < n:
            x[i] -= f[i] * x[i + 2]
        x[i] /= d[i]
    out[a:b] = x
    return out


def trends(df: DataFrame, keys: Sequence[str], order: str, value: str, smoothing: float = 1600.0) -> DataFrame:
    """df's series with a `trend` column, one group a series."""
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{order} {kinds[order]}", f"{value} double", "trend double"])

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pdf.assign(trend=trend(pdf[value].astype(float).to_numpy(), smoothing))[[*keys, order, value, "trend"]]

    return df.select(*keys, order, value).groupBy(*keys).applyInPandas(kernel, schema)
