"""Kalman likelihoods of many systems at once: the same data under many parameters, one leading axis."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Data go with every task: periods times observables that they may have.
MAX_DATA = 1_000_000


class Systems(NamedTuple):
    """Systems of one size, stacked: s = T s(-1) + R e + C, e ~ N(0, Q); y = Z s + D + u, u ~ N(0, E)."""

    T: np.ndarray
    R: np.ndarray
    C: np.ndarray
    Q: np.ndarray
    Z: np.ndarray
    D: np.ndarray
    E: np.ndarray

    def rows(self, at: np.ndarray) -> Systems:
        return Systems(*(x[at] for x in self))

    def noise(self) -> np.ndarray:
        return self.R @ self.Q @ self.R.transpose(0, 2, 1)

    def start(self, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stationary moments, by doubling for all rows at once; C and a wide covariance where T has a root on or outside the unit circle."""
        rows, n = self.C.shape
        s, p = self.C.copy(), np.broadcast_to(1e6 * np.eye(n), self.T.shape).copy()
        inside = np.flatnonzero(np.abs(np.linalg.eigvals(self.T)).max(axis=1, initial=0.0) < 1)
        if len(inside) and n:
            s[inside] = np.linalg.solve(np.eye(n) - self.T[inside], self.C[inside][..., None])[..., 0]
            a, v = self.T[inside].copy(), noise[inside].copy()
            for _ in range(60):
                step = a @ v @ a.transpose(0, 2, 1)
                v = v + step
                if (np.abs(step).max(axis=(1, 2)) <= 1e-15 * np.maximum(1, np.abs(v).max(axis=(1, 2)))).all():
                    break
                a = a @ a
            p[inside] = (v + v.transpose(0, 2, 1)) / 2
        return s, p

    def filtered(self, y: np.ndarray, noise: np.ndarray | None = None, start: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log likelihood of each period and row, and the last states and covariances; a row whose innovations' covariance isn't positive definite has minus infinity from there.

        Observables of y that are missing in a period are left out of it for all rows at
        once. noise: a state covariance for each period and all rows, if it isn't R Q R'.
        """
        fixed = self.noise() if noise is None else None
        if start is None:
            s, p = self.start(fixed if noise is None else np.broadcast_to(noise[0], self.T.shape) if len(y) else self.noise())
        else:
            s, p = (np.broadcast_to(x, shape).copy() for x, shape in zip(start, (self.C.shape, self.T.shape)))
        turned, like, lost = self.T.transpose(0, 2, 1), np.zeros((len(y), len(self.C))), np.zeros(len(self.C), bool)
        for t, row in enumerate(y):
            s = (self.T @ s[..., None])[..., 0] + self.C
            p = self.T @ p @ turned + (fixed if noise is None else noise[t])
            p = (p + p.transpose(0, 2, 1)) / 2
            seen = np.flatnonzero(~np.isnan(row))
            if len(seen):
                z = self.Z[:, seen]
                gap = row[seen] - (z @ s[..., None])[..., 0] - self.D[:, seen]
                f = z @ p @ z.transpose(0, 2, 1) + self.E[:, seen[:, None], seen]
                lost |= ~(np.linalg.eigvalsh(f)[:, 0] > 0)
                f[lost] = np.eye(len(seen))
                gain = np.linalg.solve(f, z @ p).transpose(0, 2, 1)
                like[t] = -0.5 * (len(seen) * np.log(2 * np.pi) + np.linalg.slogdet(f)[1] + (gap * np.linalg.solve(f, gap[..., None])[..., 0]).sum(axis=1))
                s, p = s + (gain @ gap[..., None])[..., 0], p - gain @ z @ p
                p = (p + p.transpose(0, 2, 1)) / 2
            like[t, lost] = -np.inf
        return like, s, p

    def loglik(self, y: np.ndarray, noise: np.ndarray | None = None, start: tuple[np.ndarray, np.ndarray] | None = None, count_from: int = 0) -> np.ndarray:
        if not 0 <= count_from <= len(y):
            raise ValueError("count_from lies outside the periods")
        return self.filtered(y, noise, start)[0][count_from:].sum(axis=0)


def collected(data: DataFrame, order: str, columns: Sequence[str]) -> np.ndarray:
    """Periods x observables in order, null as NaN; the data's size is checked before they are collected."""
    if data.limit(MAX_DATA // max(1, len(columns)) + 1).count() > MAX_DATA // max(1, len(columns)):
        raise ValueError(f"data of one likelihood have at most {MAX_DATA} values")
    rows = data.select(order, *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)]).collect()
    rows.sort(key=lambda r: r[0])
    return np.array([[np.nan if v is None else v for v in r[1:]] for r in rows], float).reshape(len(rows), len(columns))
