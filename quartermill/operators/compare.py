"""Comparison of array tables (array, coordinates, value) and of benchmark reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.transforms import missing_as_null


def compare_arrays(actual: DataFrame, desired: DataFrame, at: Sequence[str], rtol: float, atol: float, eps: float = 2.220446049250313e-16) -> DataFrame:
    """Per array: status (passed, failed, shape_mismatch), cells, cells of one side, largest absolute and relative difference, the coordinate of the largest, and whether all are close.

    Shapes differ where the largest coordinates do; then nothing else is compared (null).
    Missing equals missing and an infinity itself; a number differs from a missing or absent
    cell by infinity. The tolerance scales with the actual value, relative differences are
    over the desired one.
    """
    a = actual.select("array", *at, missing_as_null("value").alias("x"), F.lit(True).alias("in_actual"))
    d = desired.select("array", *at, missing_as_null("value").alias("y"), F.lit(True).alias("in_desired"))
    both = a.join(d, ["array", *at], "full")
    here, there = F.col("in_actual").isNotNull(), F.col("in_desired").isNotNull()
    apart, endless = F.col("x").isNull() | F.col("y").isNull(), F.lit(float("inf"))
    diff = F.when(F.col("x").eqNullSafe(F.col("y")), F.lit(0.0)).when(apart, endless).otherwise(F.abs(F.col("x") - F.col("y")))
    rows = both.withColumn("diff", diff).withColumn("rel", F.when(F.col("diff") == endless, endless).otherwise(F.col("diff") / F.greatest(F.abs("y"), F.lit(eps))))
    close = here & there & F.coalesce((F.col("diff") == 0) | ((F.col("diff") < endless) & (F.col("diff") <= atol + rtol * F.abs("x"))), F.lit(False))
    shapes = [(F.max(F.when(here, F.col(c))).alias(f"_a_{c}"), F.max(F.when(there, F.col(c))).alias(f"_d_{c}")) for c in at]
    found = rows.groupBy("array").agg(
        F.count(F.lit(1)).alias("cells"),
        F.sum(F.when(here & there, 0).otherwise(1)).alias("one_sided"),
        F.max("diff").alias("max_abs"),
        F.max("rel").alias("max_rel"),
        F.max_by(F.concat_ws(",", *at), F.struct("diff", *[-F.col(x) for x in at])).alias("worst_at"),
        F.min(close.cast("int")).cast("boolean").alias("passed"),
        *[c for pair in shapes for c in pair],
    )
    same = F.lit(True)
    for c in at:
        same &= F.col(f"_a_{c}").eqNullSafe(F.col(f"_d_{c}"))
    status = F.when(~same, "shape_mismatch").when(F.col("passed"), "passed").otherwise("failed")
    return found.select("array", status.alias("status"), "cells", "one_sided", *[F.when(same, F.col(c)).alias(c) for c in ("max_abs", "max_rel", "worst_at")], (same & F.col("passed")).alias("passed"))


def compare_names(actual: DataFrame, desired: DataFrame, key: str = "array") -> DataFrame:
    """Names of either side with their status."""
    a = actual.select(key).distinct().withColumn("a", F.lit(1))
    d = desired.select(key).distinct().withColumn("d", F.lit(1))
    status = F.when(F.col("a").isNull(), "missing").when(F.col("d").isNull(), "extra").otherwise("both")
    return a.join(d, key, "full").select(key, status.alias("status"))


def speedups(results: DataFrame, group: Sequence[str], machine: str | None = None, backend: str | None = None) -> DataFrame:
    """Elapsed time of the group's baseline over each row's: the named machine's (and backend's) if it is there, else the fastest usable row."""
    usable = results.where("available and not skipped and elapsed > 0")
    named = (F.col("machine") == machine) if machine else F.lit(False)
    if backend:
        named &= F.col("backend") == backend
    w = Window.partitionBy(*group).orderBy(F.when(named, 0).otherwise(1), "elapsed", "machine").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return usable.withColumn("baseline", F.first_value("elapsed").over(w)).withColumn("speedup", F.try_divide("baseline", F.col("elapsed")))


def matched_baseline(results: DataFrame, baselines: DataFrame, exact: Sequence[str], wild: Sequence[str]) -> DataFrame:
    """Each result with the first baseline (by ord) that equals it on `exact` and equals it or is null on `wild`."""
    b = baselines.select(*[F.col(x).alias(f"b_{x}") for x in (*exact, *wild)], "ord", F.col("elapsed").alias("baseline"))
    match = F.lit(True)
    for x in exact:
        match &= F.col(x) == F.col(f"b_{x}")
    for x in wild:
        match &= F.col(f"b_{x}").isNull() | (F.col(x) == F.col(f"b_{x}"))
    # a row's own number keeps rows that repeat apart
    joined = results.withColumn("_row", F.monotonically_increasing_id()).join(b, match, "left")
    nth = F.row_number().over(Window.partitionBy("_row").orderBy(F.col("ord").asc_nulls_last()))
    best = joined.withColumn("_nth", nth).where("_nth = 1").select(*results.columns, "baseline")
    return best.withColumn("speedup", F.when(F.col("baseline") > 0, F.try_divide("baseline", F.col("elapsed"))))


#: Tolerances by name, (absolute, relative).
TOLERANCES = {"strict": (1e-10, 1e-10), "cpu-oracle": (1e-10, 1e-10), "forecast": (1e-8, 1e-8), "accelerator": (1e-5, 1e-5)}
#: Arrays that fixtures must hold, group by group; and the profiles that ask for groups.
ARRAYS = {
    "metadata": "observable_names observable_sources observable_forward_transforms observable_reverse_transforms pseudo_observable_names pseudo_observable_reverse_transforms pseudo_observable_forward_transforms",
    "parameters": "values scaled_values fixed bounds",
    "steady_state": "values",
    "financial_frictions": "inputs values",
    "canonical": "Gamma0 Gamma1 C Psi Pi",
    "transition": "TTT RRR CCC eu",
    "system": "TTT RRR CCC ZZ DD QQ EE",
    "kalman": "log_likelihood predicted_states filtered_states predicted_covariances filtered_covariances final_filtered_state total_log_likelihood",
    "posterior": "log_posterior log_likelihood log_prior log_likelihood_by_period log_prior_by_parameter parameter_values",
}
BANDS = ("mean", "lower", "upper")
PROFILES = {
    "model-metadata": ("metadata",),
    "parameters": ("parameters",),
    "steady-state": ("steady_state",),
    "financial-frictions": ("financial_frictions",),
    "kalman": ("kalman",),
    "posterior": ("posterior",),
    "model-setup": ("metadata", "parameters", "steady_state"),
    "matrix": ("canonical", "transition", "system"),
}
COVERAGE = {profile: tuple(f"{g}/{a}" for g in groups for a in ARRAYS[g].split()) for profile, groups in PROFILES.items()}
COVERAGE |= {
    "forecast-mode": ("forecast_mode/states", "forecast_mode/observables", *(f"meansbands_mode_forecastobs/{b}" for b in BANDS)),
    "forecast-mode-history": ("forecast_mode/history_observables", *(f"meansbands_mode_histobs/{b}" for b in BANDS)),
    "forecast-full": ("forecast_full/observables", "forecast_full/observable_samples", *(f"meansbands_full_forecastobs/{b}" for b in BANDS)),
    "forecast-full-history": ("forecast_full/history_observables", "forecast_full/history_observable_samples", *(f"meansbands_full_histobs/{b}" for b in BANDS)),
    "sampler": ("sampler/mhparams", "sampler/fixed", "sampler/proposal_covariance"),
}
FORECASTS = ("forecast-mode", "forecast-mode-history", "forecast-full", "forecast-full-history")
COVERAGE["hard-target"] = tuple(a for p in ("model-setup", "matrix", "kalman", "posterior", *FORECASTS) for a in COVERAGE[p] if a != "forecast_mode/states")
COVERAGE["sampler-trace"] = (*COVERAGE["sampler"], "sampler/accepted", "sampler/log_posterior")
COVERAGE["sampler-proposal-trace"] = (*COVERAGE["sampler-trace"], *(f"sampler/{a}" for a in ("proposal_parameters", "previous_parameters", "proposal_log_posterior", "previous_log_posterior", "uniform_draw", "log_acceptance")))


def tolerance(profile: str = "strict", atol: float | None = None, rtol: float | None = None) -> tuple[float, float]:
    """(absolute, relative) tolerance: what is given, else the profile's."""
    own = TOLERANCES.get(profile.casefold(), (None, None))
    chosen = tuple(mine if given is None else given for given, mine in zip((atol, rtol), own))
    if None in own or min(chosen) < 0:
        raise ValueError(f"profiles are {', '.join(TOLERANCES)}, tolerances at least 0: {profile}, {chosen}")
    return chosen


def compare_folders(oracle: DataFrame, candidate: DataFrame, required: Sequence[str] = (), profile: str = "strict") -> DataFrame:
    """Per array name: missing_oracle (required, in neither the oracle), missing_candidate, extra_candidate, shape_mismatch, mismatch or match, with the largest difference."""
    atol, rtol = tolerance(profile)
    both = compare_arrays(candidate, oracle, ["i", "j"], rtol, atol).select("array", F.col("status").alias("_c"), "max_abs", "passed")
    names = compare_names(candidate, oracle).select("array", F.col("status").alias("_s")).join(both, "array", "left")
    needed = oracle.sparkSession.createDataFrame([(n,) for n in required], "array string").withColumn("_needed", F.lit(True))
    rows = names.join(F.broadcast(needed), "array", "full")  # required names are a parameter
    status = (
        F.when(F.col("_s").isNull() | ((F.col("_s") == "extra") & F.coalesce("_needed", F.lit(False))), "missing_oracle" if required else "extra_candidate")
        .when(F.col("_s") == "missing", "missing_candidate")
        .when(F.col("_s") == "extra", "extra_candidate")
        .when(F.col("_c") == "shape_mismatch", "shape_mismatch")
        .when(F.col("passed"), "match")
        .otherwise("mismatch")
    )
    return rows.select("array", status.alias("status"), F.when(F.col("_s") == "both", F.col("max_abs")).alias("max_abs"))


def coverage(arrays: DataFrame, profiles: dict[str, Sequence[str]] = COVERAGE) -> DataFrame:
    """Required arrays that aren't there: (profile, array)."""
    needed = arrays.sparkSession.createDataFrame([(p, a) for p, names in profiles.items() for a in names], "profile string, array string")
    return needed.join(arrays.select("array").distinct(), "array", "left_anti").select("profile", "array")


def compare_traces(actual: DataFrame, desired: DataFrame, keys: Sequence[str], fields: Sequence[str], profile: str = "strict") -> DataFrame:
    """Draw by draw comparison of sampler traces, one row a field."""
    atol, rtol = tolerance(profile)
    cells = lambda df: df.select(*keys, *[F.col(f).cast("double").alias(f) for f in fields]).unpivot(list(keys), list(fields), "array", "value")
    return compare_arrays(cells(actual), cells(desired), keys, rtol, atol)


def bench_rows(reports: DataFrame, kernel: str | None = None, check: bool = True) -> DataFrame:
    """Results of all reports, flat; reports whose command differs from the others fail the query."""
    command = F.to_json("command")
    one = F.min(command).over(Window.partitionBy()) == F.max(command).over(Window.partitionBy())  # one row a report
    fault = F.when(~one, F.raise_error(F.lit("commands of the reports differ"))).cast("string") if check else F.lit(None).cast("string")
    rows = reports.withColumn("_f", fault).where("_f is null").select("machine", F.explode("results").alias("r")).select("machine", "r.*")
    rows = rows.where(F.col("kernel") == kernel) if kernel else rows
    return rows.orderBy("kernel", "backend", "device", "horizon", "repeats", "dtype", "machine")
