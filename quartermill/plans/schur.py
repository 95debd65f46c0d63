"""Ordered generalised Schur forms, and linear systems with expectations solved through them.

For a pencil (a, b) and a combination m = a + w b that is not singular, a unitary z that makes
inv(m) b upper triangular makes q' a z and q' b z so too, with q from the QR form of m z. One
triangular form of one matrix is therefore all that is needed; numpy has none, so it is made
here by Hessenberg reduction and QR steps with shifts. Roots are ordered by rotations that
swap neighbours on the diagonal. Repeated and defective roots do no harm. Systems of one size
are stacked and worked on together, so that a system costs no Python of its own.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

EPS = 1e-6
#: A root of the pencil would have to be -1 / w for the combination to be singular.
WEIGHTS = (0.6 + 0.8j, -0.28 + 0.96j, 0.8 - 0.6j)
STEPS = 60  # QR steps for a root
METHODS = ("auto", "direct", "expectations")
#: Cells of one matrix of all systems that are worked on together.
BLOCK = 1 << 17

#: Codes of existence and uniqueness beyond 0 and 1: equations that say nothing; no triangular form.
COINCIDENT, FAILED = (-2, -2), (-3, -3)


class Solution(NamedTuple):
    """s = t s(-1) + r e + c, and whether a stable solution exists and is the only one (or a code below 0, without matrices)."""

    t: np.ndarray
    r: np.ndarray
    c: np.ndarray
    codes: tuple[int, int]


class Solutions(NamedTuple):
    """The same of stacked systems: a leading axis of rows; without a solution, zeros or what says nothing."""

    t: np.ndarray
    r: np.ndarray
    c: np.ndarray
    codes: np.ndarray


def _turned(x: np.ndarray) -> np.ndarray:
    """Conjugate transposes of stacked matrices."""
    return x.conj().swapaxes(-1, -2)


def triangular(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """u, z with m = z u z', u upper triangular, z unitary."""
    u, z, failed = triangular_many(m[None])
    if failed[0]:
        raise np.linalg.LinAlgError("no triangular form")
    return u[0], z[0]


def triangular_many(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """u, z of stacked matrices, and which of them no form was found for; each goes through the steps that it would take alone."""
    rows, n = m.shape[:2]
    h, z = np.array(m, complex), np.tile(np.eye(n, dtype=complex), (rows, 1, 1))
    for k in range(n - 2):
        x = h[:, k + 1 :, k].copy()
        x[:, 0] += np.exp(1j * np.angle(x[:, 0])) * np.linalg.norm(x, axis=1)
        size = np.linalg.norm(x, axis=1)
        v = (x / np.where(size > 0, size, 1)[:, None])[..., None]  # a column of zeros stays as it is
        h[:, k + 1 :] -= 2 * v @ (_turned(v) @ h[:, k + 1 :])
        h[:, :, k + 1 :] -= 2 * (h[:, :, k + 1 :] @ v) @ _turned(v)
        z[:, :, k + 1 :] -= 2 * (z[:, :, k + 1 :] @ v) @ _turned(v)
        h[:, k + 2 :, k] = 0
    eps = np.finfo(float).eps
    tiny = eps * np.maximum(np.linalg.norm(h.reshape(rows, -1), axis=1), np.finfo(float).tiny)
    hi, steps, failed, place = np.full(rows, n - 1), np.zeros(rows, int), np.zeros(rows, bool), np.arange(n - 1)
    while len(at := np.flatnonzero((hi > 0) & ~failed)):
        size, below = np.abs(np.diagonal(h[at], axis1=1, axis2=2)), np.abs(np.diagonal(h[at], -1, 1, 2))
        small = (below <= np.maximum(tiny[at, None], eps * (size[:, :-1] + size[:, 1:]))) & (place < hi[at, None])
        lo = np.where(small, place + 1, 0).max(axis=1)
        found = lo == hi[at]
        done = at[found]
        h[done, hi[done], hi[done] - 1] = 0
        hi[done], steps[done] = hi[done] - 1, 0
        at, lo, below = at[~found], lo[~found], below[~found]
        stuck = steps[at] == STEPS
        failed[at[stuck]] = True
        at, lo, below = at[~stuck], lo[~stuck], below[~stuck]
        steps[at] += 1
        # the shift: the last two rows' root next to the last, now and then something else
        end = hi[at]
        p, q, r, s = h[at, end - 1, end - 1], h[at, end - 1, end], h[at, end, end - 1], h[at, end, end]
        half = np.sqrt(((p - s) / 2) ** 2 + q * r)
        one, other = (p + s) / 2 + half, (p + s) / 2 - half
        shift = np.where(np.abs(one - s) <= np.abs(other - s), one, other)
        shift = np.where(steps[at] % 10 == 0, s + below[np.arange(len(at)), end - 1] * (0.7 + 0.4j), shift)
        for span in np.unique(lo * n + end):  # parts of one place and size at once
            same, first, last = lo * n + end == span, span // n, span % n
            i, part = at[same], slice(span // n, span % n + 1)
            x = h[i]
            if first:
                x[:, first, first - 1] = 0
            g, _ = np.linalg.qr(x[:, part, part] - shift[same, None, None] * np.eye(last + 1 - first))
            x[:, part] = _turned(g) @ x[:, part]
            x[:, :, part] = x[:, :, part] @ g
            z[i, :, part] = z[i][:, :, part] @ g
            h[i] = np.triu(x, -1)
    return np.triu(h), z, failed


def swapped(u: np.ndarray, z: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Moves the roots marked in first to the front of u and z, in place, each side in its order; returns the marks in the new order."""
    return swapped_many(u[None], z[None], first[None])[0]


def swapped_many(u: np.ndarray, z: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The same of stacked forms."""
    marks = first.copy()
    n = marks.shape[1]
    for end in range(n):
        for k in range(end - 1, -1, -1):
            at = np.flatnonzero(~marks[:, k] & marks[:, k + 1])
            if not len(at):
                continue
            x, y = u[at, k, k + 1], u[at, k + 1, k + 1] - u[at, k, k]
            size = np.hypot(np.abs(x), np.abs(y))
            turn = size > 0  # equal roots that nothing joins are in place
            i, x, y = at[turn], x[turn] / size[turn], y[turn] / size[turn]
            g = np.stack([np.stack([x, -y.conj()], axis=-1), np.stack([y, x.conj()], axis=-1)], axis=-2)
            u[i, :, k : k + 2] = u[i, :, k : k + 2] @ g
            u[i, k : k + 2] = _turned(g) @ u[i, k : k + 2]
            z[i, :, k : k + 2] = z[i, :, k : k + 2] @ g
            u[i, k + 1, k] = 0
            marks[at, k], marks[at, k + 1] = True, False
    return marks


def _solve(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x of a x = b for stacked systems, and which a are not singular; x of the others says nothing."""
    sound = np.linalg.slogdet(a)[0] != 0  # by the same factors as the solution
    return np.linalg.solve(np.where(sound[:, None, None], a, np.eye(a.shape[-1])), b), sound


def pencils(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """alpha, beta, u, z of stacked pencils b x = root a x, with roots beta / alpha; which have definite roots; and for which no form was found."""
    conditions = np.stack([np.linalg.cond(a + w * b) for w in WEIGHTS])
    m = a + np.array(WEIGHTS)[conditions.argmin(axis=0), None, None] * b
    definite = conditions.min(axis=0) < 1 / np.finfo(float).eps
    m[~definite] = np.eye(a.shape[-1])
    x, sound = _solve(m, b.astype(complex))
    u, z, failed = triangular_many(x)
    q, _ = np.linalg.qr(m @ z)
    alpha, beta = (np.diagonal(_turned(q) @ y @ z, axis1=1, axis2=2) for y in (a, b))
    return alpha, beta, u, z, definite, definite & (failed | ~sound)


def edges_between(alpha: np.ndarray, beta: np.ndarray, eps: float = EPS) -> np.ndarray:
    """What parts stable from explosive roots, of every row: 1.01, or half way to 1 from the least root between the two."""
    size = np.divide(np.abs(beta), np.abs(alpha), out=np.full(alpha.shape, np.inf), where=np.abs(alpha) > 0)
    least = np.where((size > 1 + eps) & (size <= 1.01), size, np.inf).min(axis=1, initial=np.inf)
    return np.where(np.isfinite(least), (1 + least) / 2, 1.01)


def without_expectations(g0: np.ndarray, g1: np.ndarray, c: np.ndarray, psi: np.ndarray) -> Solutions:
    """The systems as they are where no expectation errors enter; FAILED where g0 is singular."""
    n = g1.shape[-1]
    x, sound = _solve(g0, np.concatenate([g1, psi, c[..., None]], axis=2))
    return Solutions(x[:, :, :n], x[:, :, n:-1], x[:, :, -1], np.where(sound[:, None], (1, 1), FAILED))


def _span(m: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the rows of stacked matrices span (columns; zeros beyond it), their pseudo-inverses, and how many dimensions they span."""
    rows, i, j = m.shape
    if not m.size:
        return np.zeros((rows, j, 0), complex), np.zeros((rows, j, i), complex), np.zeros(rows, int)
    w, d, v = np.linalg.svd(m, full_matrices=False)
    keep = d > eps
    basis = _turned(v) * keep[:, None]
    return basis, (basis * np.divide(1, d, out=np.zeros_like(d), where=keep)[:, None]) @ _turned(w), keep.sum(axis=1)


def with_expectations(g0: np.ndarray, g1: np.ndarray, c: np.ndarray, psi: np.ndarray, pi: np.ndarray, edge: float | None = None, eps: float = EPS) -> Solutions:
    """Of stacked g0 s = g1 s(-1) + c + psi e + pi eta, the solutions that don't explode (Sims 2002).

    A stable solution exists if the errors eta can move every explosive direction, and is
    the only one if what they do to the others follows from that. Rows of the equations that
    span the explosive directions then hold those at rest, the others have eta taken out.
    Systems with as many stable roots are worked on together.
    """
    rows, n = c.shape
    out = Solutions(np.zeros(g0.shape), np.zeros(psi.shape), np.zeros(c.shape), np.tile(FAILED, (rows, 1)))
    if not rows or not n:
        return out
    alpha, beta, u, z, definite, failed = pencils(g0, g1)
    silent = ~definite | (~failed & (np.maximum(np.abs(alpha), np.abs(beta)) < eps).any(axis=1))
    out.codes[silent] = COINCIDENT
    edges = edges_between(alpha, beta, eps) if edge is None else np.full(rows, edge)
    many = swapped_many(u, z, np.abs(beta) <= edges[:, None] * np.abs(alpha)).sum(axis=1)
    for stable in np.unique(many[~silent & ~failed]):
        at = np.flatnonzero((many == stable) & ~silent & ~failed)
        found, sound = _stacked(g0[at], g1[at], c[at], psi[at], pi[at], z[at], int(stable), eps)
        for x, y in zip(out, found):
            x[at[sound]] = y[sound]
    return out


def _stacked(g0: np.ndarray, g1: np.ndarray, c: np.ndarray, psi: np.ndarray, pi: np.ndarray, z: np.ndarray, stable: int, eps: float) -> tuple[Solutions, np.ndarray]:
    """Solutions of systems that all have so many stable roots, first in z; and which of them could be worked out."""
    rows, n = c.shape
    # columns of z up to `stable` span what stays bounded; rows orthogonal to both its images are the explosive equations
    images = np.concatenate([g0 @ z[:, :, :stable], g1 @ z[:, :, :stable]], axis=2)
    left = _turned(np.linalg.svd(images)[0] if stable else np.tile(np.eye(n, dtype=complex), (rows, 1, 1)))
    q1, q2 = left[:, :stable], left[:, stable:]
    tied, inverse, held = _span(q2 @ pi, eps)
    moved, _, _ = _span(q1 @ pi, eps)
    loose = moved - tied @ (_turned(tied) @ moved)
    exists = held >= n - stable
    unique = ~(np.linalg.svd(loose, compute_uv=False) > eps * n).any(axis=1) if loose.size else np.ones(rows, bool)
    free = q1 - q1 @ pi @ inverse @ q2
    system = np.concatenate([free @ g0, q2 @ g0], axis=1)
    known = np.concatenate([free @ np.concatenate([g1, psi, c[..., None]], axis=2), np.zeros((rows, n - stable, n + psi.shape[2] + 1))], axis=1)
    still, sound = _solve(system, known)
    const = still[:, :, -1]
    if n > stable:  # the explosive part rests where its own constants put it
        block = z[:, :, stable:]
        rest, definite = _solve(q2 @ (g0 - g1) @ block, q2 @ c[..., None])
        target = np.concatenate([np.zeros((rows, stable, 1)), q2 @ g0 @ block @ rest], axis=1)
        const, sound = const + _solve(system, target)[0][:, :, 0], sound & definite
    return Solutions(still[:, :, :n].real, still[:, :, n:-1].real, const.real, np.stack([exists, unique], axis=1).astype(int)), sound


def solved_many(g0: np.ndarray, g1: np.ndarray, c: np.ndarray, psi: np.ndarray, pi: np.ndarray, method: str = "auto") -> Solutions:
    """Solutions of stacked systems of finite values, as `solved` finds each; FAILED where it would raise.

    Systems are worked on in blocks that bound memory. Should a factorisation of one not
    settle, its block is halved until it stands alone.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    rows, n = c.shape
    out = Solutions(np.zeros(g0.shape), np.zeros(psi.shape), np.zeros(c.shape), np.tile(FAILED, (rows, 1)))
    size = max(1, BLOCK // max(1, n * n))
    todo = [np.arange(i, min(i + size, rows)) for i in range(0, rows, size)]
    while todo:
        at = todo.pop()
        try:
            found = _by_method(*(x[at] for x in (g0, g1, c, psi, pi)), method)
        except np.linalg.LinAlgError:
            if len(at) > 1:
                todo += np.array_split(at, 2)
            continue
        for x, y in zip(out, found):
            x[at] = y
    return out


def _by_method(g0: np.ndarray, g1: np.ndarray, c: np.ndarray, psi: np.ndarray, pi: np.ndarray, method: str) -> Solutions:
    free = np.isclose(pi, 0.0).reshape(len(c), -1).all(axis=1) & (method != "expectations")
    out = without_expectations(g0, g1, c, psi) if free.any() else Solutions(np.zeros(g0.shape), np.zeros(psi.shape), np.zeros(c.shape), np.tile(FAILED, (len(c), 1)))
    out.codes[~free] = FAILED
    if method != "direct" and len(at := np.flatnonzero(out.codes[:, 0] < 0)):  # errors enter, or g0 is singular
        for x, y in zip(out, with_expectations(g0[at], g1[at], c[at], psi[at], pi[at])):
            x[at] = y
    return out


def solved(g0: np.ndarray, g1: np.ndarray, c: np.ndarray, psi: np.ndarray, pi: np.ndarray, method: str = "auto") -> Solution:
    """By method: direct (no expectations), expectations, or auto, which asks whether errors enter and g0 can be inverted."""
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    shapes = {"g0": (g0, (len(g0), len(g0))), "g1": (g1, g0.shape), "c": (c, (len(g0),)), "psi": (psi, (len(g0), psi.shape[-1])), "pi": (pi, (len(g0), pi.shape[-1]))}
    if bad := [k for k, (x, shape) in shapes.items() if x.shape != shape or not np.isfinite(x).all()]:
        raise ValueError(f"wrong shape or values that aren't finite: {bad}")
    t, r, const, codes = (x[0] for x in solved_many(g0[None], g1[None], c[None], psi[None], pi[None], method))
    if method == "direct" and codes[0] < 0:
        raise ValueError("no direct solution: g0 is singular" if np.allclose(pi, 0.0) else "no direct solution: expectation errors enter")
    if codes[0] < 0:
        none = np.zeros((0, 0))
        return Solution(none, none, np.zeros(0), tuple(codes.tolist()))
    return Solution(t, r, const, tuple(codes.tolist()))
