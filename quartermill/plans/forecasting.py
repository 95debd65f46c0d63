"""Forecasts of models over rows of parameters: one draw or all, conditioned on data or not, under tables of shocks; and scenario runs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .equations import Model, kinds, per_batch, spread
from .likelihood import Systems
from .statespace import System, conditioned, simulated

#: How data beyond history count: not at all, as further observations, or as a path that shocks must meet exactly.
CONDITIONS = ("none", "semi", "full")


def conditioned_many(s: Systems, s0: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States and the smallest shocks that put every system's observables on the same targets (NaN is free), for all at once."""
    periods, (rows, n, k) = len(targets), s.R.shape
    free, _ = paths(s, s0, np.zeros((rows, periods, k)))
    block, power = [], s.R
    for _ in range(periods):
        block.append(s.Z @ power)
        power = s.T @ power
    m = s.Z.shape[1]
    design = np.zeros((rows, periods, m, periods, k))
    for t in range(periods):
        for u in range(t + 1):
            design[:, t, :, u] = block[t - u]
    want = np.flatnonzero(~np.isnan(targets.ravel()))
    gap = targets.ravel()[want] - free.reshape(rows, -1)[:, want]
    e = (np.linalg.pinv(design.reshape(rows, periods * m, periods * k)[:, want]) @ gap[..., None]).reshape(rows, periods, k)
    return paths(s, s0, e)[1], e


def paths(s: Systems, s0: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Observables and states (rows x periods) from starts and shocks of every row."""
    states, at = [], s0
    for h in range(e.shape[1]):
        at = (s.T @ at[..., None])[..., 0] + (s.R @ e[:, h, :, None])[..., 0] + s.C
        states.append(at)
    states = np.stack(states, axis=1) if states else np.zeros((len(s0), 0, s0.shape[1]))
    return states @ s.Z.transpose(0, 2, 1) + s.D[:, None], states


def responses_many(s: Systems, horizon: int) -> np.ndarray:
    """Observables' responses to one deviation of each shock: rows x periods x observables x shocks."""
    at, out = s.R * np.sqrt(np.clip(np.diagonal(s.Q, axis1=1, axis2=2), 0, None))[:, None], []
    for _ in range(horizon):
        out.append(s.Z @ at)
        at = s.T @ at
    return np.stack(out, axis=1) if out else np.zeros((len(at), 0, s.Z.shape[1], at.shape[2]))


def _long(values: np.ndarray, head: pd.DataFrame, part: str, first: int = 0) -> pd.DataFrame:
    """rows x periods x variables as a table, each row's head repeated."""
    rows, periods, m = values.shape
    r, h, v = (x.ravel() for x in np.indices(values.shape))
    return head.iloc[r].reset_index(drop=True).assign(part=part, h=(h + first).astype("int32"), variable=v.astype("int32"), value=values.ravel())


def split(data: np.ndarray, cond: str, conditional: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What is filtered, history, and what of the data lies beyond it."""
    if cond not in CONDITIONS:
        raise ValueError(f"unknown condition: {cond}")
    if not 0 <= conditional <= len(data):
        raise ValueError("conditional periods lie within the data")
    if cond == "none":
        return data, data, data[:0]
    history, beyond = data[: len(data) - conditional], data[len(data) - conditional :]
    return history if cond == "full" else data, history, beyond


def _origin(model: Model, at: dict, data: np.ndarray, cond: str, conditional: int, method: str):
    """Systems, codes, states where forecasts start, and the conditional periods' observables (full only)."""
    used, _, beyond = split(data, cond, conditional)
    s, codes = model.systems(at, method)
    good = (codes == 1).all(axis=1)
    s = s.rows(good)
    like, state, _ = s.filtered(used)
    met = np.zeros((len(state), 0, s.Z.shape[1]))
    if cond == "full" and len(beyond):
        states, _ = conditioned_many(s, state, beyond)
        met, state = states @ s.Z.transpose(0, 2, 1) + s.D[:, None], states[:, -1]
    return s, codes, good, state, met, like.sum(axis=0)


def forecasts(rows: DataFrame, keys: Sequence[str], model: Model, data: np.ndarray, horizon: int, cond: str = "none", conditional: int = 0, shocks: DataFrame | None = None, method: str = "auto") -> DataFrame:
    """keys, draw, part, h, variable, value: every parameter row's forecast from the end of the data, under no shocks or under each draw of its own.

    data are periods x observables; the last `conditional` of them lie in the forecast, whose
    horizon counts them (part `conditional` with cond full, whose path they are). shocks
    (keys, draw, h, shock, value) has a row for each shock that isn't 0, h from the first
    period after the conditional ones; a draw is one row's group, bounded by the horizon. A
    row without the one stable solution gives one row whose part is `no solution`.
    """
    beyond = split(data, cond, conditional)[2]
    if len(beyond) > horizon:
        raise ValueError("conditional periods exceed the horizon")
    left, names = horizon - len(beyond), list(keys)
    k, m = model.sizes.get("shocks", 0), model.sizes.get("observables", 0)
    first = 0 if cond == "full" else len(beyond)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            given = np.column_stack([batch.column(p).to_numpy(zero_copy_only=False).astype(float) for p in model.parameters])
            e = _shocks(batch.column("_e"), left, k) if "_e" in batch.schema.names else np.zeros((batch.num_rows, left, k))
            y, found = drawn(model, given, e, data, cond, conditional, method)
            ends = np.concatenate([[0], np.cumsum(found)]) * (y.shape[1] * m)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(y.ravel()), mask=pa.array(~found))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in [*names, "_draw"]), lists], names=[*names, "_draw", "_y"])

    given = [F.col(p).cast("double").alias(p) for p in model.parameters if p not in names]
    if shocks is None:
        rows = spread(rows.select(*names, *given, F.lit(0).cast("long").alias("_draw")))
    else:
        inside = shocks.where((F.col("h") >= 0) & (F.col("h") < left))
        cell = F.struct(F.col("h").cast("int").alias("h"), F.col("shock").cast("int").alias("shock"), F.col("value").cast("double").alias("value"))
        cube = inside.groupBy(*names, F.col("draw").cast("long").alias("_draw")).agg(F.collect_list(cell).alias("_e"))
        rows = rows.select(*names, *given).join(cube, names)
    out = rows.mapInArrow(run, f"{kinds(rows, names)}, _draw long, _y array<double>")
    if not (horizon - first) * m:  # no period to show
        out = out.where("_y is null")
    h = (F.floor(F.col("_at") / max(1, m)) + first).cast("int")
    part = F.when(F.col("_at").isNull(), "no solution").when(h < len(beyond), "conditional").otherwise("forecast")
    out = out.select(*names, F.col("_draw").alias("draw"), F.posexplode_outer("_y").alias("_at", "value"))
    return out.select(*names, "draw", part.alias("part"), h.alias("h"), (F.col("_at") % max(1, m)).cast("int").alias("variable"), F.when(~F.isnan("value"), F.col("value")).alias("value"))


def drawn(model: Model, given: np.ndarray, e: np.ndarray, data: np.ndarray, cond: str, conditional: int, method: str) -> tuple[np.ndarray, np.ndarray]:
    """Observables under every row's parameters and shocks, of rows with the one stable solution, and which these are; rows of the same parameters share one system and one filter."""
    each, of = np.unique(given, axis=0, return_inverse=True)
    s, _, good, state, met, _ = _origin(model, model.values(dict(zip(model.parameters, each.T))), data, cond, conditional, method)
    found = good[of.ravel()]
    at = (np.cumsum(good) - 1)[of.ravel()[found]]
    return np.concatenate([met[at], paths(s.rows(at), state[at], e[found])[0]], axis=1), found


def _shocks(cells: pa.ListArray, periods: int, shocks: int) -> np.ndarray:
    """rows x periods x shocks from each row's list of (h, shock, value); cells of one place are added."""
    flat, row = cells.flatten(), np.repeat(np.arange(len(cells)), pc.list_value_length(cells).fill_null(0).to_numpy())
    h, shock, value = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("h", "shock", "value"))
    if ((shock < 0) | (shock >= shocks)).any():
        raise ValueError(f"the model has {shocks} shocks")
    return np.bincount((row * periods + h) * shocks + shock, value, len(cells) * periods * shocks).reshape(len(cells), periods, shocks)


def histories(rows: DataFrame, keys: Sequence[str], model: Model, data: np.ndarray, cond: str = "none", conditional: int = 0, smooth: bool = False, method: str = "auto") -> DataFrame:
    """keys, t, state, value: filtered or smoothed states of every parameter row over history; what cond semi adds to the data counts in the filter."""
    used, history, _ = split(data, cond, conditional)
    kind, names = kinds(rows, keys), list(keys)

    def work(pdf: pd.DataFrame, at: dict) -> pd.DataFrame:
        from .statespace import filtered, smoothed

        s, codes = model.systems(at, method)
        good = np.flatnonzero((codes == 1).all(axis=1))
        out = np.zeros((len(good), len(history), model.sizes["states"]))
        for i, row in enumerate(good):
            one = System(*(x[row] for x in s))
            f = filtered(one, used)
            out[i] = (smoothed(one, f)[0] if smooth else f["state"])[: len(history)]
        return _long(out, pdf[names].iloc[good], "", 0).drop(columns="part").rename(columns={"h": "t", "variable": "state"})

    return per_batch(rows, model, keys, f"{kind}, t int, state int, value double", work)


def run_scenarios(conditions: DataFrame, key: str, system: System, s0: np.ndarray, horizon: int, shocks: Sequence[str], observables: Sequence[str], policy: str, deviations: Sequence[float] | None = None) -> DataFrame:
    """Scenarios of all kinds in one plan: key, kind, part, h, name, value, baseline.

    conditions (key, kind, h, name, value) state, as deviations from the baseline: `policy`,
    an observable's path that the shock called `policy` alone must meet; `structural`, a
    shock's own values in standard deviations; `condition`, an observable's path that the
    smallest shocks of all meet. Parts are `path` (observables beside their baseline),
    `shock` (in standard deviations) and `summary`: the largest shock, the largest norm of a
    quarter's shocks, how many deviations (of 4 and 8) either passes, and how far the path
    misses what was asked. A scenario of two kinds, or an unknown name, fails.
    """
    sd = np.sqrt(np.clip(np.diag(system.Q), 0, None)) if deviations is None else np.asarray(deviations, float)
    base = simulated(system, s0, np.zeros((horizon, len(shocks)))) @ system.Z.T + system.D
    place = {n: i for i, n in enumerate(observables)}, {n: i for i, n in enumerate(shocks)}
    kind = conditions.schema[key].dataType.simpleString()

    def kernel(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["kind"].iloc[0]
        if name not in ("policy", "structural", "condition") or (pdf["kind"] != name).any():
            raise ValueError(f"a scenario has one kind: {sorted(set(pdf['kind']))}")
        pdf = pdf[(pdf["h"] >= 0) & (pdf["h"] < horizon)]
        e, want = np.zeros((horizon, len(shocks))), np.full(base.shape, np.nan)
        if name == "structural":
            np.add.at(e, (pdf["h"].to_numpy(int), [place[1][n] for n in pdf["name"]]), pdf["value"].to_numpy(float))
            e *= sd
        else:
            at = pdf["h"].to_numpy(int), [place[0][n] for n in pdf["name"]]
            want[at] = base[at] + pdf["value"].to_numpy(float)
            e = conditioned(system, s0, want, [place[1][policy]] if name == "policy" else None)
        y = simulated(system, s0, e) @ system.Z.T + system.D
        z = np.divide(e, sd, out=np.zeros_like(e), where=sd > 0)
        single, joint = np.abs(z).max(initial=0.0), np.sqrt((z * z).sum(axis=1)).max(initial=0.0)
        passed = max((d for d in (4.0, 8.0) if single > d or joint > d), default=0.0)
        miss = np.abs(y - want)[~np.isnan(want)].max(initial=0.0)
        h, v = np.indices(y.shape)
        g, j = np.indices(e.shape)
        parts = [
            pd.DataFrame({"part": "path", "h": h.ravel(), "name": np.array(observables, object)[v.ravel()], "value": y.ravel(), "baseline": base.ravel()}),
            pd.DataFrame({"part": "shock", "h": g.ravel(), "name": np.array(shocks, object)[j.ravel()], "value": z.ravel(), "baseline": 0.0}),
            pd.DataFrame({"part": "summary", "h": -1, "name": ["largest shock", "joint norm", "deviations passed", "miss"], "value": [single, joint, passed, miss], "baseline": 0.0}),
        ]
        return pd.concat(parts).assign(**{key: group[0], "kind": name})[[key, "kind", "part", "h", "name", "value", "baseline"]]

    return conditions.select(key, "kind", "h", "name", "value").groupBy(key).applyInPandas(kernel, f"`{key}` {kind}, kind string, part string, h int, name string, value double, baseline double")
