"""State-space analytics: kernels for one ordered group, fanned out by Spark over groups.

s = T s(-1) + R e + C, e ~ N(0, Q);  y = Z s + D + u, u ~ N(0, E). Missing observations are
null (NaN inside a kernel). A group is one key: a series set, a draw or a scenario.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .linear import initial_state


@dataclass(frozen=True)
class System:
    T: np.ndarray
    R: np.ndarray
    C: np.ndarray
    Q: np.ndarray
    Z: np.ndarray
    D: np.ndarray
    E: np.ndarray

    @staticmethod
    def of(T, R, Q, Z, E=None, C=None, D=None) -> System:
        a = lambda x: np.atleast_2d(np.asarray(x, float))
        T, R, Q, Z = a(T), a(R), a(Q), a(Z)
        out = System(T, R, np.zeros(len(T)) if C is None else np.asarray(C, float), Q, Z, np.zeros(len(Z)) if D is None else np.asarray(D, float), np.zeros((len(Z), len(Z))) if E is None else a(E))
        n, k, m = len(T), R.shape[1], len(Z)
        shapes = {"T": (T, (n, n)), "R": (R, (n, k)), "C": (out.C, (n,)), "Q": (Q, (k, k)), "Z": (Z, (m, n)), "D": (out.D, (m,)), "E": (out.E, (m, m))}
        if bad := [x for x, (value, shape) in shapes.items() if value.shape != shape or not np.isfinite(value).all()]:
            raise ValueError(f"wrong shape or values that aren't finite: {bad}")
        return out


def filtered(m: System, y: np.ndarray, start: tuple[np.ndarray, np.ndarray] | None = None, noise: Sequence[np.ndarray] | None = None, count_from: int = 0) -> dict[str, np.ndarray]:
    """Kalman filter over rows of y; a period updates on what it observes, none observed only predicts."""
    v = [m.R @ m.Q @ m.R.T] * len(y) if noise is None else list(noise)
    s, p = start if start is not None else initial_state(m.T, m.C, v[0] if len(y) else m.R @ m.Q @ m.R.T)
    keep = {x: [] for x in ("state", "cov", "pred", "pred_cov", "loglik")}
    for t, row in enumerate(y):
        s, p = m.T @ s + m.C, m.T @ p @ m.T.T + v[t]
        p = (p + p.T) / 2
        keep["pred"].append(s)
        keep["pred_cov"].append(p)
        seen = ~np.isnan(row)
        like = 0.0
        if seen.any():
            z = m.Z[seen]
            gap = row[seen] - z @ s - m.D[seen]
            f = z @ p @ z.T + m.E[np.ix_(seen, seen)]
            sign, logdet = np.linalg.slogdet(f)
            if sign <= 0:
                raise np.linalg.LinAlgError("innovation covariance isn't positive definite")
            gain = np.linalg.solve(f, z @ p).T
            like = -0.5 * (seen.sum() * np.log(2 * np.pi) + logdet + gap @ np.linalg.solve(f, gap))
            s, p = s + gain @ gap, p - gain @ z @ p
            p = (p + p.T) / 2
        keep["state"].append(s)
        keep["cov"].append(p)
        keep["loglik"].append(like)
    out = {k: np.array(x) for k, x in keep.items()}
    out["total"] = out["loglik"][count_from:].sum()
    return out


def gain_back(cov: np.ndarray, t: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """Smoother gain; small eigenvalues of the predicted covariance count as zero."""
    value, vector = np.linalg.eigh(ahead)
    small = value <= 1e-10 * max(value.max(initial=0.0), 0.0)
    inverse = np.where(small, 0.0, 1 / np.where(small, 1.0, value))
    return cov @ t.T @ (vector * inverse) @ vector.T


def smoothed(m: System, f: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Backward pass over a filter's output: states and covariances given all periods."""
    s, p = f["state"].copy(), f["cov"].copy()
    for t in range(len(s) - 2, -1, -1):
        j = gain_back(f["cov"][t], m.T, f["pred_cov"][t + 1])
        s[t] = f["state"][t] + j @ (s[t + 1] - f["pred"][t + 1])
        p[t] = f["cov"][t] + j @ (p[t + 1] - f["pred_cov"][t + 1]) @ j.T
    return s, p


def simulated(m: System, s0: np.ndarray, shocks: np.ndarray) -> np.ndarray:
    """States of the periods that the rows of shocks (or of a batch of them, leading axis, with one start or a batch of these) make."""
    s, out = np.broadcast_to(s0, (*shocks.shape[:-2], np.shape(s0)[-1])), []
    for h in range(shocks.shape[-2]):
        s = s @ m.T.T + shocks[..., h, :] @ m.R.T + m.C
        out.append(s)
    return np.stack(out, axis=-2) if out else np.zeros((*shocks.shape[:-2], 0, np.shape(s0)[-1]))


def responses(m: System, horizon: int, one_sd: bool = True) -> np.ndarray:
    """Observables' responses: horizon x observables x shocks; constants cancel."""
    scale = np.sqrt(np.clip(np.diag(m.Q), 0, None)) if one_sd else np.ones(len(m.Q))
    s, out = m.R * scale, []
    for _ in range(horizon):
        out.append(m.Z @ s)
        s = m.T @ s
    return np.array(out).reshape(horizon, len(m.Z), len(m.Q))


def conditioned(m: System, s0: np.ndarray, targets: np.ndarray, allowed: Sequence[int] | None = None) -> np.ndarray:
    """The smallest shocks (in squares, over all periods at once) that put observables on their targets; NaN is free."""
    horizon, k = len(targets), m.R.shape[1]
    use = list(range(k)) if allowed is None else list(allowed)
    path = simulated(m, s0, np.zeros((horizon, k))) @ m.Z.T + m.D
    block = [m.Z @ np.linalg.matrix_power(m.T, j) @ m.R[:, use] for j in range(horizon)]
    design = np.zeros((horizon, len(m.Z), horizon, len(use)))
    for t in range(horizon):
        for u in range(t + 1):
            design[t, :, u] = block[t - u]
    want = ~np.isnan(targets)
    x = np.linalg.lstsq(design[want].reshape(want.sum(), -1), (targets - path)[want], rcond=None)[0]
    out = np.zeros((horizon, k))
    out[:, use] = x.reshape(horizon, len(use))
    return out


def decomposed(m: System, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Baseline path and each shock's contribution (period x observable x shock) to smoothed states.

    The path is anchored on the first state; shocks are those that R can explain of the
    rest, so what R cannot reach stays unexplained and shows when parts are added up.
    """
    t, k = len(states), m.R.shape[1]
    gaps = states[1:] - states[:-1] @ m.T.T - m.C
    shocks = gaps @ np.linalg.pinv(m.R).T
    part, parts, base, bases = np.zeros((len(m.T), k)), [], states[0], [states[0]]
    parts.append(part)
    for i in range(t - 1):
        part = m.T @ part + m.R * shocks[i]
        base = m.T @ base + m.C
        parts.append(part)
        bases.append(base)
    return np.array(bases) @ m.Z.T + m.D, np.einsum("oi,tik->tok", m.Z, np.array(parts))


def _matrix(pdf: pd.DataFrame, columns: Sequence[str]) -> np.ndarray:
    return pdf[list(columns)].astype(float).to_numpy()


def filter_groups(df: DataFrame, key: str, order: str, columns: Sequence[str], system: System, smooth: bool = False, noise: DataFrame | None = None) -> DataFrame:
    """Filtered (and smoothed) states of every group: key, t, loglik, state, cov[, smooth_state].

    noise has cells (order, i, j, value) of the shocks' covariance of periods where it isn't
    the system's own; a period's cells are bounded by the system and travel with its rows.
    """
    kind, timed = dict(df.dtypes)[key], noise is not None
    if timed:
        own = noise.groupBy(order).agg(F.collect_list(F.struct(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("value").cast("double").alias("value"))).alias("_q"))
        df = df.join(own, order, "left")

    def variances(pdf: pd.DataFrame) -> list[np.ndarray] | None:
        if not timed:
            return None
        out = []
        for cells in pdf["_q"]:
            q = system.Q if cells is None else np.zeros_like(system.Q)
            for c in cells if cells is not None else ():
                q[c["i"], c["j"]] = c["value"]
            out.append(system.R @ q @ system.R.T)
        return out

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        f = filtered(system, _matrix(pdf, columns), noise=variances(pdf))
        out = pd.DataFrame({key: pdf[key].to_numpy(), "t": np.arange(len(pdf)), "loglik": f["loglik"], "state": list(f["state"]), "cov": [x.ravel() for x in f["cov"]]})
        out["smooth_state"] = list(smoothed(system, f)[0]) if smooth else None
        return out

    return df.groupBy(key).applyInPandas(kernel, f"{key} {kind}, t int, loglik double, state array<double>, cov array<double>, smooth_state array<double>")


def sampled_forecasts(spark: SparkSession, system: System, s0: np.ndarray, horizon: int, draws: int, seed: int, partitions: int | None = None) -> DataFrame:
    """(draw, h, variable, value): each draw's shocks depend on (seed, draw) alone, not on partitions."""
    root = np.linalg.cholesky(system.Q + 1e-300 * np.eye(len(system.Q))) if system.Q.any() else np.zeros_like(system.Q)

    def kernel(parts):
        for pdf in parts:
            ids = pdf["id"].to_numpy()
            e = np.stack([np.random.default_rng([seed, int(i)]).normal(size=(horizon, len(root))) for i in ids]) @ root.T
            y = simulated(system, s0, e) @ system.Z.T + system.D
            d, h, v = np.meshgrid(ids, np.arange(horizon), np.arange(len(system.Z)), indexing="ij")
            yield pd.DataFrame({"draw": d.ravel(), "h": h.ravel(), "variable": v.ravel(), "value": y.ravel()})

    return spark.range(draws, numPartitions=partitions).mapInPandas(kernel, "draw long, h int, variable int, value double")


def decompose_groups(df: DataFrame, key: str, order: str, columns: Sequence[str], system: System) -> DataFrame:
    """(key, t, variable, driver, value): baseline, shocks and residual of each observable, long."""
    kind = dict(df.dtypes)[key]

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        y = _matrix(pdf, columns)
        states, _ = smoothed(system, filtered(system, y))
        base, parts = decomposed(system, states)
        stack = np.concatenate([base[:, :, None], parts, (y - base - parts.sum(axis=2))[:, :, None]], axis=2)
        t, v, d = np.meshgrid(np.arange(len(y)), np.arange(y.shape[1]), np.arange(-1, stack.shape[2] - 1), indexing="ij")
        return pd.DataFrame({key: pdf[key].iloc[0], "t": t.ravel(), "variable": v.ravel(), "driver": d.ravel(), "value": stack.ravel()})

    out = df.groupBy(key).applyInPandas(kernel, f"{key} {kind}, t int, variable int, driver int, value double")
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def condition_groups(targets: DataFrame, key: str, system: System, s0: np.ndarray) -> DataFrame:
    """(key, h, shock, value) of the shocks that meet each group's targets (key, h, variable, value); null is free."""
    kind = dict(targets.dtypes)[key]
    m, k = len(system.Z), system.R.shape[1]

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        want = np.full((int(pdf["h"].max()) + 1, m), np.nan)
        want[pdf["h"], pdf["variable"]] = pdf["value"].astype(float)
        e = conditioned(system, s0, want)
        h, j = np.meshgrid(np.arange(len(want)), np.arange(k), indexing="ij")
        return pd.DataFrame({key: pdf[key].iloc[0], "h": h.ravel(), "shock": j.ravel(), "value": e.ravel()})

    return targets.groupBy(key).applyInPandas(kernel, f"{key} {kind}, h int, shock int, value double")


def forecast_groups(df: DataFrame, key: str, order: str, columns: Sequence[str], system: System, horizon: int, method: str = "filtered") -> DataFrame:
    """Per group: observables forecast from the end of its history, whose last state is the filtered or the smoothed one (key, h, variable, value)."""
    if method not in ("filtered", "smoothed"):
        raise ValueError(f"unknown history method: {method}")
    kind = df.schema[key].dataType.simpleString()

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        f = filtered(system, _matrix(pdf, columns))
        last = (smoothed(system, f)[0] if method == "smoothed" else f["state"])[-1]
        states = simulated(system, last, np.zeros((horizon, system.R.shape[1])))
        y = states @ system.Z.T + system.D
        h, v = np.indices(y.shape)
        return pd.DataFrame({key: pdf[key].iloc[0], "h": h.ravel(), "variable": v.ravel(), "value": y.ravel()})

    return df.select(key, order, *columns).groupBy(key).applyInPandas(kernel, f"{key} {kind}, h int, variable int, value double")


def scenario_paths(shocks: DataFrame, key: str, names: Sequence[str], system: System, s0: np.ndarray, horizon: int) -> DataFrame:
    """Per scenario: observables with its shocks (key, h, shock, value) and without (key, h, variable, value, baseline, deviation); a shock that isn't named fails the query."""
    kind, place = shocks.schema[key].dataType.simpleString(), {n: i for i, n in enumerate(names)}

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        e = np.zeros((2, horizon, system.R.shape[1]))
        inside = pdf[pdf["h"] < horizon]
        np.add.at(e, (1, inside["h"].to_numpy(int), [place[s] for s in inside["shock"]]), inside["value"].to_numpy(float))
        base, y = simulated(system, s0, e) @ system.Z.T + system.D
        h, v = np.indices(y.shape)
        return pd.DataFrame({key: pdf[key].iloc[0], "h": h.ravel(), "variable": v.ravel(), "value": y.ravel(), "baseline": base.ravel(), "deviation": (y - base).ravel()})

    return shocks.select(key, "h", "shock", "value").groupBy(key).applyInPandas(kernel, f"{key} {kind}, h int, variable int, value double, baseline double, deviation double")
