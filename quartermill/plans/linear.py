"""Dense linear algebra for one small system; runs inside a task or, once, on the driver."""

from __future__ import annotations

import numpy as np

from .schur import solved


class NoStableSolution(ValueError):
    """The equations have no stable solution, or more than one."""


def stationary_covariance(t: np.ndarray, v: np.ndarray, tolerance: float = 1e-15, turns: int = 60) -> np.ndarray:
    """P = T P T' + V by doubling: each turn squares T and adds as many terms as there are already."""
    p, a = v.copy(), t.copy()
    for _ in range(turns):
        step = a @ p @ a.T
        p = p + step
        if np.abs(step).max(initial=0.0) <= tolerance * max(1.0, np.abs(p).max(initial=0.0)):
            return (p + p.T) / 2
        a = a @ a
    raise NoStableSolution("covariance doesn't settle")


def initial_state(t: np.ndarray, c: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stationary moments, or c and a wide covariance where T has a root on or outside the unit circle."""
    n = len(t)
    if n == 0 or np.abs(np.linalg.eigvals(t)).max() < 1:
        return np.linalg.solve(np.eye(n) - t, c), stationary_covariance(t, v)
    return c.copy(), 1e6 * np.eye(n)


def rational_expectations(g0: np.ndarray, g1: np.ndarray, c: np.ndarray, psi: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """T, R, C of s = T s(-1) + R e + C from g0 s = g1 s(-1) + c + psi e + pi eta, the one stable solution."""
    found = solved(g0, g1, c, psi, pi)
    if found.codes != (1, 1):
        raise NoStableSolution("no stable solution" if found.codes[0] != 1 else "more than one stable solution")
    return found.t, found.r, found.c
