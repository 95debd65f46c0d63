"""Posterior evaluation and draws as relational plans, with small kernels where linear algebra is needed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.transforms import log_prior
from ..operators.diagnostics import covariance_health
from ..session import bounded

#: Rows of a side that every row of the other meets.
MAX_POINTS = 100_000


def estimated(parameters: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Parameters that are estimated: those not fixed that have a prior, or the named ones; a named one that is fixed fails the query."""
    if names is None:
        return parameters.where(~F.col("fixed") & F.col("prior").isNotNull())
    fault = F.when(F.col("fixed"), F.raise_error(F.concat(F.lit("fixed parameter: "), F.col("name"))).cast("string"))
    return parameters.where(F.col("name").isin(*names)).withColumn("_fault", fault).where("_fault is null").drop("_fault")


def prior_sum(parameters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of log priors per key; parameters that are fixed or have no prior count 0, a value outside its prior's domain gives minus infinity."""
    own = F.coalesce(log_prior("prior", "value", "a", "b", "log_norm"), F.lit(float("-inf")))
    counted = ~F.col("fixed") & F.col("prior").isNotNull()
    return parameters.groupBy(*keys).agg(F.sum(F.when(counted, own).otherwise(0.0)).alias("log_prior"))


def ar1_loglik(rows: DataFrame, series: Sequence[str], order: str, value: str, points: DataFrame) -> DataFrame:
    """Log likelihood of y = rho y(-1) + sigma e at each point (point, rho, sigma) for each series, given its first value.

    The likelihood depends on a series by three sums only, so rows are read once and points
    meet one row a series.
    """
    from .. functions.transforms import previous

    y, z = F.col("_y"), F.col("_z")
    pairs = rows.select(*series, F.col(value).alias("_y"), previous(F.col(value), series, order).alias("_z")).where("_z is not null and _y is not null")
    sums = pairs.groupBy(*series).agg(F.count(F.lit(1)).alias("n"), F.sum(y * y).alias("yy"), F.sum(y * z).alias("yz"), F.sum(z * z).alias("zz"))
    squares = F.col("yy") - 2 * F.col("rho") * F.col("yz") + F.col("rho") * F.col("rho") * F.col("zz")
    loglik = -F.col("n") / 2 * F.ln(2 * F.pi() * F.col("sigma") * F.col("sigma")) - squares / (2 * F.col("sigma") * F.col("sigma"))
    return sums.crossJoin(bounded(points, MAX_POINTS, "points")).select(*series, "point", "rho", "sigma", loglik.alias("loglik"))


def mvn_logpdf(x: str, mean: str, cov: str) -> Column:
    """Log density of array x under a normal with array mean and covariance cov (row by row), by Cholesky factors; null where cov isn't positive definite."""

    @F.pandas_udf("double")
    def density(xs: pd.Series, means: pd.Series, covs: pd.Series) -> pd.Series:
        out = np.full(len(xs), np.nan)
        sizes = xs.map(len).to_numpy()
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            d = np.stack(xs.iloc[at].to_list()).astype(float) - np.stack(means.iloc[at].to_list())
            c = np.stack(covs.iloc[at].to_list()).astype(float).reshape(-1, n, n)
            good = np.linalg.eigvalsh(c)[:, 0] > 0
            low = np.linalg.cholesky(c[good])
            z = np.linalg.solve(low, d[good][..., None])[..., 0]
            logdet = 2 * np.log(np.einsum("kii->ki", low)).sum(axis=1)
            out[at[good]] = -0.5 * ((z * z).sum(axis=1) + logdet + n * np.log(2 * np.pi))
        return pd.Series(out)

    v = density(F.col(x), F.col(mean), F.col(cov))
    return F.when(~F.isnan(v), v)


def random_blocks(names: DataFrame, keys: Sequence[str], blocks: int, seed: str) -> DataFrame:
    """names with a block number: a random order per key, cut into chunks of equal, rounded-up size. The order is a hash's, so retries agree."""
    by = ", ".join(keys)
    order = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys], F.col("name")).cast("binary"))
    rows = names.withColumn("_o", order).withColumn("_i", F.expr(f"row_number() over (partition by {by} order by _o, name) - 1")).withColumn("_n", F.expr(f"count(*) over (partition by {by})"))
    return rows.withColumn("block", F.floor(F.col("_i") / F.ceil(F.col("_n") / blocks)).cast("int")).drop("_o", "_i", "_n")


def proposal_scale(cells: DataFrame, scale: float, tolerance: float = 1e-10) -> DataFrame:
    """A proposal covariance (key, i, j, value) times scale squared; a cell that differs from its mirror, or has none, and a matrix that isn't positive definite fail the query."""
    mirror = cells.select("key", F.col("i").alias("j"), F.col("j").alias("i"), F.col("value").alias("_m"))
    both = cells.join(mirror, ["key", "i", "j"], "left")
    same = F.coalesce(F.abs(F.col("value") - F.col("_m")) <= tolerance, F.lit(False))
    fault = F.when(~same, F.raise_error(F.concat(F.lit("not symmetric: "), F.col("key").cast("string"))).cast("string"))
    sound = both.withColumn("_f", fault).where("_f is null").select("key", "i", "j", "value")
    low = covariance_health(sound, "key").select("key", "low")
    lost = F.when(~(F.col("low") > 0), F.raise_error(F.concat(F.lit("not positive definite: "), F.col("key").cast("string"))).cast("string"))
    return sound.join(low, "key").withColumn("_f", lost).where("_f is null").select("key", "i", "j", (F.col("value") * scale * scale).alias("value"))


def regime_noise(quarters: DataFrame, cells: DataFrame, silent: Sequence[str], since: int) -> DataFrame:
    """Covariance cells (shock_i, shock_j, value) per quarter: before `since`, rows and columns of the silent shocks are 0. Both sides are dimension tables."""
    off = (F.col("quarter_idx") < since) & (F.col("shock_i").isin(*silent) | F.col("shock_j").isin(*silent))
    return quarters.crossJoin(bounded(cells, MAX_POINTS, "covariance cells")).select("quarter_idx", "shock_i", "shock_j", F.when(off, F.lit(0.0)).otherwise(F.col("value")).alias("value"))


def split_history(data: DataFrame, forecast_start: int | None = None, conditional: int = 0, order: str = "quarter_idx") -> DataFrame:
    """data with `part`: history, or conditional from forecast_start on; without dates, the last `conditional` rows."""
    if forecast_start is not None:
        return data.withColumn("part", F.when(F.col(order) >= forecast_start, "conditional").otherwise("history"))
    if conditional < 0:
        raise ValueError("the number of conditional periods is negative")
    rows = data.withColumn("_back", F.expr(f"row_number() over (order by {order} desc)"))  # one row a quarter
    return rows.withColumn("part", F.when(F.col("_back") <= conditional, "conditional").otherwise("history")).drop("_back")


def parameter_forecasts(draws: DataFrame, key: str, names: Sequence[str], build: Callable[[dict], tuple], horizon: int) -> DataFrame:
    """Paths of every draw's own system: build gives (T, C, Z, D, s0), stacked, of the draws' parameters as arrays.

    A draw whose system isn't finite has one row without h, variable and value.
    """

    def run(parts):
        for pdf in parts:
            if not len(pdf):
                continue
            found = [np.asarray(x, float) for x in build({n: pdf[n].to_numpy(float) for n in names})]
            good = np.all([np.isfinite(x).reshape(len(pdf), -1).all(axis=1) for x in found], axis=0)
            t, c, z, d, s = (x[good] for x in found)
            values = np.empty((len(s), horizon, z.shape[1]))
            for h in range(horizon):
                s = (t @ s[..., None])[..., 0] + c
                values[:, h] = (z @ s[..., None])[..., 0] + d
            row, h, v = (x.ravel() for x in np.indices(values.shape))
            own = pdf[key].to_numpy()
            yield pd.DataFrame({key: own[good][row], "h": h, "variable": v, "value": values.ravel()})
            if not good.all():
                yield pd.DataFrame({key: own[~good], "h": None, "variable": None, "value": None})

    kind = draws.schema[key].dataType.simpleString()
    return draws.select(key, *names).mapInPandas(run, f"{key} {kind}, h int, variable int, value double")


def expectations(systems: DataFrame, key: str, ahead: int) -> DataFrame:
    """Cells of T^k and of the constant C + T C + ... + T^(k-1) C, and of both summed over 1 to k, for k up to `ahead`; systems have t (row by row) and c."""

    def of_size(pdf: pd.DataFrame, n: int):
        c = np.stack([np.asarray(x, float) for x in pdf["c"]])
        t = np.stack([np.asarray(x, float) for x in pdf["t"]]).reshape(-1, n, n)
        row, i, j = (x.ravel() for x in np.indices(t.shape))
        power, constant, sums, constants = np.broadcast_to(np.eye(n), t.shape), np.zeros_like(c), np.zeros_like(t), np.zeros_like(c)
        for k in range(1, ahead + 1):
            constant, power = constant + (power @ c[..., None])[..., 0], power @ t
            sums, constants = sums + power, constants + constant
            yield pd.DataFrame({key: pdf[key].to_numpy()[row], "k": k, "i": i, "j": j, "power": power.ravel(), "constant": constant[row, i], "power_sum": sums.ravel(), "constant_sum": constants[row, i]})

    def run(parts):
        for pdf in parts:
            sizes = pdf["c"].map(len)
            for n in sorted(set(sizes)):  # systems of one size are worked on together
                yield from of_size(pdf[sizes == n], n)

    kind = systems.schema[key].dataType.simpleString()
    return systems.select(key, "t", "c").mapInPandas(run, f"{key} {kind}, k int, i int, j int, power double, constant double, power_sum double, constant_sum double")
