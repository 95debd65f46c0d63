"""Posterior work over tables of points: Hessians, optimisers and chains, many rows at once.

An objective takes points (rows x parameters) and the other columns of their rows, by name,
and gives one value a row; nothing of it comes from the driver but its code. Rows are spread
by Spark, and what a batch of rows needs is evaluated in whole arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .equations import Model, kinds, likelihoods, log_likelihoods

Objective = Callable[[np.ndarray, dict[str, np.ndarray]], np.ndarray]
FAULTS = (np.linalg.LinAlgError, FloatingPointError, ValueError, OverflowError, ZeroDivisionError)


def safe(objective: Objective) -> Objective:
    """Numerical failures of a row, and values that aren't numbers, give minus infinity; other errors are errors."""

    def value(x: np.ndarray, row: dict[str, np.ndarray]) -> np.ndarray:
        with np.errstate(all="ignore"):
            try:
                out = np.asarray(objective(x, row), float)
            except FAULTS:
                if len(x) == 1:
                    return np.full(1, -np.inf)
                out = np.concatenate([value(x[k : k + 1], {n: v[k : k + 1] for n, v in row.items()}) for k in range(len(x))])
        return np.where(np.isnan(out), -np.inf, out)

    return value


def posterior(model: Model, names: Sequence[str], data: np.ndarray, log_prior: Objective | None = None, count_from: int = 0) -> Objective:
    """The objective of a model: Kalman log likelihood of data where `names` have the point's values and other parameters their row's, plus a prior's."""

    def value(x: np.ndarray, row: dict[str, np.ndarray]) -> np.ndarray:
        at = model.values({**row, **{n: x[:, k] for k, n in enumerate(names)}})
        out = likelihoods(model, at, data, count_from=count_from)[1]
        return out if log_prior is None else out + log_prior(x, row)

    return value


def _points(pdf: pd.DataFrame, context: Sequence[str], x: str = "x") -> tuple[np.ndarray, dict[str, np.ndarray]]:
    return np.stack([np.asarray(v, float) for v in pdf[x]]), {c: pdf[c].to_numpy(float) for c in context}


def _selected(points: DataFrame, keys: Sequence[str], context: Sequence[str], *more: str) -> DataFrame:
    return points.select(*keys, *more, *[F.col(c).cast("double").alias(c) for c in context if c not in keys])


def evaluated(points: DataFrame, keys: Sequence[str], objective: Objective, context: Sequence[str] = ()) -> DataFrame:
    """keys and the objective's `value` at x of every row."""
    f = safe(objective)

    def run(parts):
        for pdf in parts:
            if len(pdf):
                yield pdf[list(keys)].assign(value=f(*_points(pdf, context)))

    return _selected(points, keys, context, "x").mapInPandas(run, f"{kinds(points, keys)}, value double")


def hessians(points: DataFrame, keys: Sequence[str], objective: Objective, size: int, context: Sequence[str] = (), step: float = 1e-4) -> DataFrame:
    """(keys, i, j, value) of a finite-difference Hessian at x of every row: a row a stencil point, combined by a sum.

    A pair (i, j) takes three points on the diagonal and four corners off it; steps are
    step * max(1, |x|). A cell one of whose points has no finite value is null.
    """
    f = safe(objective)
    stencil = [(i, i, a, 0, w) for i in range(size) for a, w in ((1, 1), (0, -2), (-1, 1))] + [(i, j, a, b, a * b / 4) for i in range(size) for j in range(i + 1, size) for a in (1, -1) for b in (1, -1)]
    table = F.array(*[F.struct(*[F.lit(v if k < 2 else float(v)).alias(n) for k, (n, v) in enumerate(zip(("_i", "_j", "_a", "_b", "_w"), point))]) for point in stencil])
    spread = _selected(points, keys, context, "x", F.explode(table).alias("_s")).select(*keys, *[c for c in context if c not in keys], "x", "_s.*")

    def run(parts):
        for pdf in parts:
            if not len(pdf):
                continue
            x, row = _points(pdf, context)
            h, at = step * np.maximum(1, np.abs(x)), np.arange(len(x))
            i, j, a, b, w = (pdf[c].to_numpy() for c in ("_i", "_j", "_a", "_b", "_w"))
            moved = x.copy()
            moved[at, i] += a * h[at, i]
            moved[at, j] += b * h[at, j]
            yield pdf[list(keys)].assign(i=i, j=j, part=w * f(moved, row) / (h[at, i] * h[at, j]))

    parts = spread.mapInPandas(run, f"{kinds(points, keys)}, i int, j int, part double")
    upper = parts.groupBy(*keys, "i", "j").agg(F.sum("part").alias("value"))
    upper = upper.withColumn("value", F.when(F.abs("value") < F.lit(float("inf")), F.col("value")))
    return upper.unionByName(upper.where("i <> j").select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "value"))


def proposal_covariance(hessian_matrix: np.ndarray, jitter: float = 0.0) -> np.ndarray:
    """Inverse of minus the log density's Hessian, symmetrised; it must be finite and positive definite."""
    h = -(hessian_matrix + hessian_matrix.T) / 2 + jitter * np.eye(len(hessian_matrix))
    out = np.linalg.inv(h)
    out = (out + out.T) / 2
    if not np.isfinite(out).all():
        raise ValueError("covariance isn't finite")
    np.linalg.cholesky(out)
    return out


# Optimisers ----------------------------------------------------------------------------


def simplexes(f: Objective, x: np.ndarray, row: dict[str, np.ndarray], turns: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The highest points that Nelder and Mead's simplexes reach from x, one a row, all moved at once: x, value, turns taken, settled."""
    rows, n = x.shape

    def at(points: np.ndarray, which: np.ndarray) -> np.ndarray:
        return -f(points, {k: v[which] for k, v in row.items()})

    corner = np.repeat(x[:, None, :], n + 1, axis=1)
    for k in range(n):
        corner[:, k + 1, k] = np.where(x[:, k] != 0, 1.05 * x[:, k], 0.00025)
    value = np.stack([at(corner[:, k], np.arange(rows)) for k in range(n + 1)], axis=1)
    took, settled = np.zeros(rows, int), np.zeros(rows, bool)
    for _ in range(turns):
        order = np.argsort(value, axis=1, kind="stable")
        value, corner = np.take_along_axis(value, order, 1), np.take_along_axis(corner, order[..., None], 1)
        with np.errstate(invalid="ignore"):
            settled = (np.abs(corner[:, 1:] - corner[:, :1]).max(axis=(1, 2)) <= tolerance) & (np.abs(value[:, 1:] - value[:, :1]).max(axis=1) <= tolerance)
        live = np.flatnonzero(~settled)
        if not len(live):
            break
        took[live] += 1
        best, bad, worst, last = value[live, 0], value[live, -2], value[live, -1], corner[live, -1]
        centre = corner[live, :-1].mean(axis=1)
        reflected = 2 * centre - last
        fr = at(reflected, live)
        grow, outer = fr < best, (fr >= bad) & (fr < worst)
        inner = fr >= worst
        second = np.where(grow[:, None], 3 * centre - 2 * last, np.where(outer[:, None], 1.5 * centre - 0.5 * last, 0.5 * (centre + last)))
        fs, ask = np.full(len(live), np.inf), np.flatnonzero(grow | outer | inner)
        if len(ask):
            fs[ask] = at(second[ask], live[ask])
        take_second = (grow & (fs < fr)) | (outer & (fs <= fr)) | (inner & (fs < worst))
        shrink = (outer | inner) & ~take_second
        new, fn = np.where(take_second[:, None], second, reflected), np.where(take_second, fs, fr)
        corner[live[~shrink], -1], value[live[~shrink], -1] = new[~shrink], fn[~shrink]
        low = live[shrink]
        for k in range(1, n + 1) if len(low) else ():
            corner[low, k] = (corner[low, 0] + corner[low, k]) / 2
            value[low, k] = at(corner[low, k], low)
    best = value.argmin(axis=1)
    return corner[np.arange(rows), best], -value[np.arange(rows), best], took, settled


GOLDEN = (5**0.5 - 1) / 2


def along(f: Objective, x: np.ndarray, d: np.ndarray, row: dict[str, np.ndarray], reach: float, turns: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """The highest point of every row's line x + t d, |t| <= reach: the best of a grid, then golden sections around it; never below x."""
    grid = np.concatenate([-np.geomspace(reach, reach * 1e-4, 9), [0.0], np.geomspace(reach * 1e-4, reach, 9)])
    values = np.stack([-f(x + t * d, row) for t in grid], axis=1)
    k = values.argmin(axis=1)
    lo, hi = grid[np.maximum(k - 1, 0)], grid[np.minimum(k + 1, len(grid) - 1)]
    a, b = hi - GOLDEN * (hi - lo), lo + GOLDEN * (hi - lo)
    fa, fb = -f(x + a[:, None] * d, row), -f(x + b[:, None] * d, row)
    for _ in range(turns):
        left = fa <= fb
        lo, hi = np.where(left, lo, a), np.where(left, b, hi)
        na, nb = np.where(left, hi - GOLDEN * (hi - lo), b), np.where(left, a, lo + GOLDEN * (hi - lo))
        new = -f(x + np.where(left, na, nb)[:, None] * d, row)
        fa, fb, a, b = np.where(left, new, fb), np.where(left, fa, new), na, nb
    t, ft = np.where(fa <= fb, a, b), np.minimum(fa, fb)
    best = values[np.arange(len(x)), k]
    t, ft = np.where(ft < best, t, grid[k]), np.minimum(ft, best)
    return x + t[:, None] * d, -ft


def directions(f: Objective, x: np.ndarray, row: dict[str, np.ndarray], turns: int, tolerance: float, reach: float = 10.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Powell's search from x, one a row: lines along each row's own directions, of which the one that gained most gives way to the way gone."""
    rows, n = x.shape
    d, here = np.broadcast_to(np.eye(n), (rows, n, n)).copy(), f(x, row)
    took, settled = np.zeros(rows, int), np.zeros(rows, bool)
    for _ in range(turns):
        live = np.flatnonzero(~settled)
        if not len(live):
            break
        part = {k: v[live] for k, v in row.items()}
        start, first, now, at = x[live].copy(), here[live].copy(), here[live].copy(), x[live].copy()
        gain, which = np.full(len(live), -np.inf), np.zeros(len(live), int)
        for k in range(n):
            at, value = along(f, at, d[live, k], part, reach)
            more = value - now > gain
            gain, which, now = np.where(more, value - now, gain), np.where(more, k, which), value
        way = at - start
        beyond = f(2 * at - start, part)
        with np.errstate(invalid="ignore"):
            bend = 2 * (2 * now - first - beyond) * (now - first - gain) ** 2 < gain * (beyond - first) ** 2
            turn = np.flatnonzero((beyond > first) & bend & (np.abs(way).max(axis=1) > 0))
        if len(turn):
            at[turn], now[turn] = along(f, at[turn], way[turn], {k: v[turn] for k, v in part.items()}, reach)
            d[live[turn], which[turn]] = d[live[turn], -1]
            d[live[turn], -1] = way[turn]
        x[live], here[live] = at, now
        took[live] += 1
        with np.errstate(invalid="ignore"):
            settled[live] = (2 * np.abs(now - first) <= tolerance * (np.abs(now) + np.abs(first)) + 1e-20) | (np.abs(at - start).max(axis=1) <= tolerance * 1e-2)
    return x, here, took, settled


METHODS = {"simplex": simplexes, "directions": directions}


def optima(points: DataFrame, keys: Sequence[str], objective: Objective, context: Sequence[str] = (), method: str = "simplex", turns: int = 2_000, tolerance: float = 1e-8) -> DataFrame:
    """keys, x, value, turns and settled: where a search for the objective's maximum ends from x of every row.

    A start without a finite value fails the query, as no search from there can mean anything.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    f, search = safe(objective), METHODS[method]

    def run(parts):
        for pdf in parts:
            if not len(pdf):
                continue
            x, row = _points(pdf, context)
            if not np.isfinite(f(x, row)).all():
                raise ValueError("the objective isn't finite at a start")
            at, value, took, settled = search(f, x.copy(), row, turns, tolerance)
            yield pdf[list(keys)].assign(x=list(at), value=value, turns=took.astype("int32"), settled=settled)

    return _selected(points, keys, context, "x").mapInPandas(run, f"{kinds(points, keys)}, x array<double>, value double, turns int, settled boolean")


# Chains --------------------------------------------------------------------------------


def normal_log_density(x: np.ndarray, mean: np.ndarray, covariance: np.ndarray) -> float:
    if not len(x):
        return 0.0
    low = np.linalg.cholesky(covariance)
    z = np.linalg.solve(low, x - mean)
    return float(-0.5 * (len(x) * np.log(2 * np.pi) + z @ z) - np.log(np.diag(low)).sum())


def mixture(x: np.ndarray, mean: np.ndarray, centre: np.ndarray, covariance: np.ndarray, alpha: float) -> float:
    """Log density of x under alpha N(mean, covariance) + (1 - alpha) / 2 of N(mean, its diagonal) and N(centre, covariance) each."""
    terms = [(alpha, normal_log_density(x, mean, covariance)), ((1 - alpha) / 2, normal_log_density(x, mean, np.diag(np.clip(np.diag(covariance), 1e-16, None)))), ((1 - alpha) / 2, normal_log_density(x, centre, covariance))]
    return float(np.logaddexp.reduce([np.log(w) + v for w, v in terms if w > 0]))


def correction(proposal: np.ndarray, current: np.ndarray, covariance: np.ndarray, alpha: float, c: float) -> float:
    """What the mixture of proposals adds to the log acceptance ratio: the way back over the way there, both centred on the proposal; 0 for alpha 0."""
    wide = covariance * c * c
    return mixture(current, proposal, proposal, wide, alpha) - mixture(proposal, current, proposal, wide, alpha) if alpha else 0.0


@dataclass(frozen=True)
class Sampler:
    """Random-walk chains in rounds of draws * thin sweeps over random blocks of parameters.

    With target, a round starts by moving the proposal's scale by how far the last round's
    acceptance lay from it, and the ratio is corrected for a mixture of proposals (alpha, c).
    Everything random of a sweep is drawn from (seed, chain, sweep) alone: a chain is the same
    whatever its batch, however often it is run again, and wherever it is resumed.
    """

    covariance: np.ndarray
    draws: int
    seed: int
    rounds: int = 1
    burn_rounds: int = 0
    burn: int = 0
    thin: int = 1
    blocks: int = 1
    scale: float = 1.0
    target: float | None = None
    alpha: float = 1.0
    c: float = 0.5

    def __post_init__(self):
        n = len(self.covariance)
        np.linalg.cholesky(self.covariance)
        if self.covariance.shape != (n, n) or not np.allclose(self.covariance, self.covariance.T):
            raise ValueError("covariance isn't symmetric")
        if min(self.draws, self.rounds, self.thin) < 1 or self.burn < 0 or not 0 <= self.burn_rounds <= self.rounds or not 1 <= self.blocks <= n:
            raise ValueError("draws, rounds, thin and blocks are positive, no more blocks than parameters, no more burnt rounds than rounds")
        if not 0 < self.scale or not 0 <= self.alpha <= 1 or not 0 < self.c or not 0 <= (self.target or 0) <= 1:
            raise ValueError("scale and c are positive, alpha and target between 0 and 1")

    @property
    def per_round(self) -> int:
        return self.draws * self.thin

    @property
    def sweeps(self) -> int:
        return self.rounds * self.per_round

    def kept(self, sweep: int) -> bool:
        return (sweep + 1) % self.thin == 0 and sweep >= self.burn and sweep // self.per_round >= self.burn_rounds


STATE = "sweep long, x array<double>, logpost double, accepted boolean, scale double, tried long, rejected long, kept boolean"


def _advance(s: Sampler, f: Objective, keys: Sequence[str], context: Sequence[str], until: int, parts):
    """Chains of a batch from the sweep after their state's to `until`, all moved at once; a row a kept sweep and one for the last."""
    for pdf in parts:
        if not len(pdf):
            continue
        x, row = _points(pdf, context)
        here = pdf["logpost"].to_numpy(float).copy()
        fresh = np.isnan(here)
        if fresh.any():
            here[fresh] = f(x[fresh], {k: v[fresh] for k, v in row.items()})
        if not np.isfinite(here).all():
            raise ValueError("the objective isn't finite at a chain's start")
        chain, names = pdf["_chain"].to_numpy(), pdf[list(keys)]
        scale, tried, rejected = (pdf[c].to_numpy().copy() for c in ("scale", "tried", "rejected"))
        n, whole = x.shape[1], np.linalg.cholesky(s.covariance)
        cut = -(-n // s.blocks)
        for sweep in range(int(pdf["sweep"].iloc[0]) + 1, until):
            if s.target is not None and sweep % s.per_round == 0:
                rate = np.where(tried > 0, 1 - rejected / np.maximum(tried, 1), s.target)
                scale = scale * (0.95 + 0.10 / (1 + np.exp(-16.0 * (rate - s.target))))
            if sweep % s.per_round == 0:
                tried[:], rejected[:] = 0, 0
            rngs = [np.random.default_rng([s.seed, int(k), sweep]) for k in chain]
            groups = [[np.arange(n)] if s.blocks == 1 else [np.sort(p[k : k + cut]) for k in range(0, n, cut)] for p in (r.permutation(n) if s.blocks > 1 else None for r in rngs)]
            moved = np.zeros(len(x), bool)
            for b in range(len(groups[0])):
                to, add = x.copy(), np.zeros(len(x))
                for k, rng in enumerate(rngs):
                    at = groups[k][b]
                    block = s.covariance[np.ix_(at, at)]
                    low = whole if s.blocks == 1 else np.linalg.cholesky(block)
                    to[k, at] += scale[k] * (low @ rng.standard_normal(len(at)))
                    if s.target is not None:
                        add[k] = correction(to[k, at], x[k, at], block, s.alpha, s.c)
                there = f(to, row)
                luck = np.log([r.random() for r in rngs])
                take = np.isfinite(there) & (luck < there - here + np.where(np.isfinite(add), add, 0.0))
                x, here = np.where(take[:, None], to, x), np.where(take, there, here)
                tried, rejected, moved = tried + 1, rejected + ~take, moved | take
            if s.kept(sweep) or sweep == until - 1:
                yield names.assign(sweep=sweep, x=list(x), logpost=here, accepted=moved, scale=scale, tried=tried, rejected=rejected, kept=s.kept(sweep))


def chains(starts: DataFrame, key: str, objective: Objective, sampler: Sampler, context: Sequence[str] = (), every: int | None = None, state: DataFrame | None = None) -> DataFrame:
    """A chain from x of every row of starts (key is a whole number, one row each), as rows of STATE; draws are those that are kept.

    The chains' state is written to the shared folder every `every` sweeps, so that a lost
    executor costs no more than that; state, the rows of an earlier call, resumes it there.
    """
    f = safe(objective)
    base = starts.select(key, F.col(key).cast("long").alias("_chain"), *[F.col(c).cast("double").alias(c) for c in context if c != key])
    if state is None:
        now = starts.select(key, "x", F.lit(-1).cast("long").alias("sweep"), F.lit(None).cast("double").alias("logpost"), F.lit(float(sampler.scale)).alias("scale"), *[F.lit(0).cast("long").alias(c) for c in ("tried", "rejected")])
        done, out = -1, None
    else:
        done = state.agg(F.max("sweep")).first()[0]
        now, out = state.where(F.col("sweep") == done).drop("accepted", "kept"), state
    every, parts = every or sampler.sweeps, starts.sparkSession.sparkContext.defaultParallelism
    while done + 1 < sampler.sweeps:
        until = min(sampler.sweeps, done + 1 + every)
        rows = base.join(now, key).repartition(parts, key).mapInPandas(partial(_advance, sampler, f, (key,), tuple(context), until), f"{kinds(starts, [key])}, {STATE}")
        part = written(rows, "chains")
        out = part if out is None else out.unionByName(part)
        done, now = until - 1, part.where(F.col("sweep") == until - 1).drop("accepted", "kept")
    return out


def draws_of(states: DataFrame, key: str) -> DataFrame:
    """The kept draws of chains, numbered from 0: key, draw, x, logpost, accepted."""
    kept = states.where("kept")
    return kept.select(key, F.expr(f"cast(row_number() over (partition by `{key}` order by sweep) - 1 as long)").alias("draw"), "x", "logpost", "accepted")


# Orchestration --------------------------------------------------------------------------


def refreshed(rows: DataFrame, keys: Sequence[str], model: Model, names: Sequence[str], data: np.ndarray, log_prior: Objective | None = None, method: str = "directions", tolerance: float = 1e-8) -> DataFrame:
    """rows' parameters with the named ones moved to where the posterior given the others is highest; value and settled beside them."""
    rest = [p for p in model.parameters if p not in names]
    points = rows.select(*keys, F.array(*[F.col(n).cast("double") for n in names]).alias("x"), *rest)
    out = optima(points, keys, posterior(model, names, data, log_prior), rest, method, tolerance=tolerance)
    return out.join(rows.select(*keys, *rest), list(keys)).select(*keys, *[F.col("x")[i].alias(n) for i, n in enumerate(names)], *rest, "value", "settled")


def replayed(trace: DataFrame, keys: Sequence[str], model: Model, data: np.ndarray, log_prior: Column, count_from: int = 0) -> DataFrame:
    """A trace's rows (keys, the model's parameters, recorded) with the log posterior computed anew, its two parts, and how far it lies from what was recorded."""
    like = log_likelihoods(trace, [*keys, "recorded", *[p for p in model.parameters if p not in keys]], model, data, count_from=count_from)
    both = like.select(*keys, "recorded", "loglik", log_prior.alias("log_prior"))
    total = F.col("loglik") + F.col("log_prior")
    return both.withColumn("replay", total).withColumn("offset", total - F.col("recorded"))


def replay_report(replays: DataFrame, by: Sequence[str], atol: float, rtol: float) -> DataFrame:
    """by, rows, mean and deviation of the finite offsets, the largest, and whether all are close, by the replayed value's size."""
    finite = F.when(F.abs("offset") < F.lit(float("inf")), F.col("offset"))
    close = F.coalesce((F.col("replay") == F.col("recorded")) | (F.abs("offset") <= atol + rtol * F.abs("replay")), F.lit(False))
    return replays.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(finite).alias("offset_mean"), F.stddev_pop(finite).alias("offset_sd"), F.max(F.abs("offset")).alias("max_abs"), F.min(close.cast("int")).cast("boolean").alias("passed"))


class Estimate(NamedTuple):
    """The mode (key, x, value), the Hessian there (key, i, j, value) and covariance, and chains from it, as far as they were asked for."""

    mode: DataFrame
    hessian: DataFrame | None
    covariance: np.ndarray | None
    states: DataFrame | None


def estimate(starts: DataFrame, key: str, objective: Objective, size: int, context: Sequence[str] = (), method: str | None = None, mode: DataFrame | None = None, step: float | None = None, jitter: float = 0.0, covariance: np.ndarray | None = None, draws: int = 0, seed: int | None = None, **sampling) -> Estimate:
    """From starts (key, x and the context) to a mode, the proposal's covariance and chains.

    The mode is either searched for by a method or given (key, x, value), never both. The
    covariance is either given or taken from the Hessian at the highest mode, of which only
    the size x size cells reach the driver. Chains, one a start's key, begin at the highest mode.
    """
    if (method is None) == (mode is None):
        raise ValueError("either a method searches for the mode or it is given")
    if covariance is not None and step is not None:
        raise ValueError("either a covariance is given or a Hessian's step")
    if draws < 0 or (draws and covariance is None and step is None):
        raise ValueError("draws need a covariance or a Hessian's step")
    if draws and seed is None:
        raise ValueError("draws need a seed")
    if not draws and sampling:
        raise ValueError(f"without draws there is nothing to set: {sorted(sampling)}")
    if mode is None:
        mode = written(optima(starts, [key], objective, context, method).select(key, "x", "value"), "mode")
    best = mode.orderBy(F.col("value").desc(), key).limit(1)
    hessian = None
    if step is not None:
        at = best.select(key, "x").join(starts.select(key, *[c for c in context if c != key]), key)
        hessian = written(hessians(at, [key], objective, size, context, step), "hessian")
        cells = np.full((size, size), np.nan)
        for r in hessian.collect():  # size x size cells of one mode
            cells[r.i, r.j] = np.nan if r.value is None else r.value
        covariance = proposal_covariance(cells, jitter)
    states = None
    if draws:
        x = best.first().x
        from_best = starts.drop("x").withColumn("x", F.array(*map(F.lit, x)))
        states = chains(from_best, key, objective, Sampler(covariance, draws, seed, **sampling), context)
    return Estimate(mode, hessian, covariance, states)
