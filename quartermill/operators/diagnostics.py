"""Diagnostics of sampler chains as relational plans over (chain, draw, parameter, value) rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written


#: Draws of a block whose lagged products a task forms; lags looked at first, and by how much more each turn.
BLOCK, LAGS, FURTHER = 1 << 16, 256, 16


def numbered(draws: DataFrame, keys: Sequence[str], order: str, *columns: str | Column) -> DataFrame:
    """keys, i (from 0, by order), n (draws of the key) and the columns: a global sort and the rows before each part of it, so that a chain may lie in many tasks."""
    named = [F.col(k).alias(f"_k{x}") for x, k in enumerate(keys)]
    own = [f"_k{x}" for x in range(len(keys))]
    ordered = draws.select(*named, F.col(order).alias("_order"), *columns).orderBy(*own, "_order")
    rows = written(ordered.drop("_order").withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "numbered")
    parts = rows.groupBy(*own, "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    chain = Window.partitionBy(*own)
    before = F.sum("_rows").over(chain.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    places = parts.select(*[F.col(k).alias(f"_p{k}") for k in own], F.col("_part").alias("_p_part"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(chain).alias("n"))
    same = F.col("_part") == F.col("_p_part")
    for k in own:
        same &= F.col(k).eqNullSafe(F.col(f"_p{k}"))
    names = [c for c in rows.columns if c not in (*own, "_part", "_at")]
    return rows.join(places, same).select(*[F.col(o).alias(k) for o, k in zip(own, keys)], (F.col("_at") + F.col("_shift")).alias("i"), "n", *names)


def acceptance_windows(trace: DataFrame, keys: Sequence[str], order: str, windows: int) -> DataFrame:
    """Acceptance rate in nearly equal runs of the trace (earlier runs take the odd rows)."""
    rows = numbered(trace, keys, order, F.col("accepted").cast("double").alias("_a"))
    base, odd = F.floor(F.col("n") / windows), F.col("n") % windows
    long = odd * (base + 1)  # rows in runs of one more
    nth = F.when(F.col("i") < long, F.floor(F.col("i") / (base + 1))).otherwise(odd + F.floor((F.col("i") - long) / F.greatest(base, F.lit(1)))) + 1
    return rows.withColumn("window", nth.cast("int")).groupBy(*keys, "window").agg(F.avg("_a").alias("rate"), F.count(F.lit(1)).alias("n"))


def moments(draws: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, deviation (0 for one draw), extremes and rows per key."""
    return draws.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))


def split_rhat(draws: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Potential scale reduction of a chain's first half against its last; null under 4 draws.

    The middle draw of an odd chain is left out. Constant halves give 1 if equal, else null.
    """
    half = F.floor(F.col("n") / 2)
    part = F.when(F.col("i") < half, 1).when(F.col("i") >= F.col("n") - half, 2)
    rows = numbered(draws, keys, order, F.col(value).alias("_v"))
    halves = rows.withColumn("_part", part).where("_part is not null and n >= 4").groupBy(*keys, "_part").agg(F.avg("_v").alias("m"), F.var_samp("_v").alias("s"), F.count(F.lit(1)).alias("c"))
    both = halves.groupBy(*keys).agg(F.avg("s").alias("within"), (F.var_samp("m") * F.first("c")).alias("between"), F.first("c").alias("c"))
    var = (F.col("c") - 1) / F.col("c") * F.col("within") + F.col("between") / F.col("c")
    value_ = F.when(F.col("within") > 0, F.sqrt(var / F.col("within"))).when(F.col("between") == 0, F.lit(1.0))
    out = both.select(*keys, value_.alias("rhat"))
    return draws.select(*keys).distinct().join(out, list(keys), "left")


def lagged_products(x: np.ndarray, after: np.ndarray, lags: int) -> np.ndarray:
    """Sums of x[t] times what comes l later in x and then after, for l from 0 to lags."""
    y = np.concatenate([x, after[:lags]])
    if len(x) * (lags + 1) <= 1 << 20:
        return np.array([float(x[: max(0, len(y) - k)] @ y[k : k + len(x)]) for k in range(lags + 1)])
    size = 1 << (len(x) + len(y) + lags).bit_length()
    return np.fft.irfft(np.conj(np.fft.rfft(x, size)) * np.fft.rfft(y, size), size)[: lags + 1]


def lag_sums(chains: DataFrame, keys: Sequence[str], lags: int, block: int = BLOCK) -> DataFrame:
    """keys, lag, sum of products of values (x, at place i) so far apart; a task has a block and the lags after it, never a chain."""
    block = max(block, lags)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chains.select(*keys).schema)
    own = F.floor(F.col("i") / block)
    homes = F.when((own > 0) & (F.col("i") % block < lags), F.array(own, own - 1)).otherwise(F.array(own))
    rows = chains.select(*keys, "i", "x", F.explode(homes).alias("_block"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        inside = (part["i"] // block == part["_block"]).to_numpy()
        x = part["x"].to_numpy(float)
        sums = lagged_products(x[inside], x[~inside], lags)
        return pd.DataFrame({**{k: part[k].iloc[0] for k in keys}, "lag": np.arange(lags + 1), "sum": sums})

    return rows.groupBy(*keys, "_block").applyInPandas(run, f"{kinds}, lag long, sum double").groupBy(*keys, "lag").agg(F.sum("sum").alias("sum"))


def effective_size(draws: DataFrame, keys: Sequence[str], order: str, value: str, lags: int = LAGS, block: int = BLOCK) -> DataFrame:
    """Autocorrelation time and effective sample size: autocorrelations are summed up to the first that isn't positive.

    A chain without spread, or of one draw, counts in full. Products are formed by blocks of
    a chain; chains whose autocorrelations are still positive at the last lag are looked at
    again, FURTHER times as far.
    """
    keys = list(keys)
    rows = numbered(draws, keys, order, F.col(value).cast("double").alias("x"))
    means = rows.groupBy(*keys).agg(F.avg("x").alias("_m"), F.var_pop("x").alias("_var"))
    same = lambda other: [F.col(f"r.{k}").eqNullSafe(F.col(f"{other}.{k}")) for k in keys]

    def matched(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        on = F.lit(True)
        for c in same("s"):
            on &= c
        return left.alias("r").join(right.alias("s"), on, how)

    centred = written(matched(rows, means).select("r.*", (F.col("x") - F.col("_m")).alias("_x"), "_var").drop("x").withColumnRenamed("_x", "x"), "centred")
    tiny = float(np.finfo(float).eps)
    flat = (F.col("n") < 2) | F.coalesce(~(F.col("_var") > tiny), F.lit(True)) | F.isnan("_var")
    sizes = centred.groupBy(*keys).agg(F.max("n").alias("n"), F.max("_var").alias("_var"))
    found = sizes.where(flat).select(*keys, "n", F.lit(0.0).alias("total"))
    open_ = sizes.where(~flat)
    while True:
        sums = lag_sums(matched(centred, open_, "left_semi"), keys, lags, block)
        rho = matched(sums, open_).select(*[F.col(f"r.{k}") for k in keys], "s.n", "lag", (F.col("sum") / ((F.col("s.n") - F.col("lag")) * F.col("s._var"))).alias("rho")).where("lag between 1 and n - 1")
        end = rho.groupBy(*keys, "n").agg(F.min(F.when(~F.coalesce(F.col("rho") > 0, F.lit(False)), F.col("lag"))).alias("_end"))
        summed = matched(rho, end.select(*keys, "_end")).groupBy(*[F.col(f"r.{k}").alias(k) for k in keys], "n").agg(F.coalesce(F.sum(F.when(F.col("lag") < F.coalesce("_end", F.lit(np.iinfo(np.int64).max)), F.col("rho"))), F.lit(0.0)).alias("total"), F.max("_end").alias("_end"))
        part = written(summed, "lags")
        done = F.col("_end").isNotNull() | (F.col("n") - 1 <= lags)
        found = found.unionByName(part.where(done).select(*keys, "n", "total"))
        left = part.where(~done)
        if not left.limit(1).count():
            break
        open_ = matched(sizes, left, "left_semi")
        lags *= FURTHER
    time = F.greatest(F.lit(1.0), 1 + 2 * F.col("total"))
    return found.select(*keys, "n", time.alias("iat"), F.least(F.col("n").cast("double"), F.col("n") / time).alias("ess"))


def parameter_diagnostics(draws: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Moments per key with the effective size and the standard error of the mean it implies."""
    sizes = effective_size(draws, keys, order, value).select(*keys, "iat", "ess")
    return moments(draws, keys, value).join(sizes, list(keys)).withColumn("mcse", F.col("sd") / F.sqrt("ess"))


def chain_summary(trace: DataFrame, keys: Sequence[str], logpost: str) -> DataFrame:
    """Per chain: draws, acceptance, and mean and extremes of the log posterior."""
    return trace.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("accepted").cast("double")).alias("acceptance"), F.avg(logpost).alias("logpost_mean"), F.min(logpost).alias("logpost_min"), F.max(logpost).alias("logpost_max")
    )


def covariance_health(matrices: DataFrame, key: str) -> DataFrame:
    """Per symmetric matrix of cells (key, i, j, value): smallest and largest eigenvalue, condition number, and whether it is positive semidefinite."""

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        n = int(max(cells.i.max(), cells.j.max())) + 1
        m = np.zeros((n, n))
        m[cells.i, cells.j] = cells.value
        values = np.linalg.eigvalsh((m + m.T) / 2)
        low, high = float(values[0]), float(values[-1])
        return pd.DataFrame({key: [cells[key].iloc[0]], "n": [n], "low": [low], "high": [high], "condition": [high / low if low > 0 else np.inf], "semidefinite": [low >= -1e-12]})

    kind = matrices.schema[key].dataType.simpleString()
    return matrices.select(key, "i", "j", "value").groupBy(key).applyInPandas(run, f"`{key}` {kind}, n long, low double, high double, condition double, semidefinite boolean")


def replayed(trace: DataFrame) -> DataFrame:
    """Recomputes each proposal's verdict: log ratio, whether it should have been taken, what should have stayed, and whether the trace agrees."""
    ratio = F.col("proposed_logpost") - F.col("previous_logpost")
    take = F.ln("u") < F.least(F.lit(0.0), ratio)
    kept = F.when(take, F.col("proposed_logpost")).otherwise(F.col("previous_logpost"))
    return trace.withColumn("log_alpha", ratio).withColumn("expected", take).withColumn("retained", kept).withColumn("agrees", take == F.col("accepted"))
