"""Whole packages in one call: a quarter's baseline, bands, history, responses and scenarios, and a study of targets; each one bundle of files."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.transforms import shown
from ..operators import scenarios
from ..operators.bands import bands
from ..operators.bundles import response_lines, stress_table, write_bundle
from ..session import written
from . import forecasting, statespace
from .equations import Model
from .statespace import System


def _system(model: Model, row: DataFrame) -> System:
    """The one parameter row's system, on the driver: a model's matrices in size."""
    rows = row.select(*[F.col(p).cast("double") for p in model.parameters]).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a package has one row of parameters")
    s, codes = model.systems(model.values({p: np.array([rows[0][p]]) for p in model.parameters}))
    if tuple(codes[0]) != (1, 1):
        raise ValueError(f"no single stable solution: {tuple(codes[0])}")
    return System(*(x[0] for x in s))


def _named(rows: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    return rows.withColumn(column, F.element_at(F.array(*map(F.lit, names)), F.col(column) + 1))


def responses(spark, system: System, horizon: int, shocks: Sequence[str], observables: Sequence[str]) -> DataFrame:
    """(variable, shock, h, response) to one standard deviation of each shock; horizon x observables x shocks cells of one system."""
    r = statespace.responses(system, horizon)
    return spark.createDataFrame([(observables[v], shocks[s], h, float(r[h, v, s])) for h, v, s in np.ndindex(r.shape)], "variable string, shock string, h int, response double")


def quarterly_package(row: DataFrame, key: str, model: Model, data: np.ndarray, horizon: int, conditions: DataFrame, shocks: Sequence[str], observables: Sequence[str], policy: str, path: str, cube: DataFrame | None = None, cond: str = "none", conditional: int = 0, **facts) -> dict:
    """From one row of parameters and the data to the quarter's files; returns their manifest.

    Tables: baseline (by variable and quarter), bands (over the cube's draws, if there is
    one), history (smoothed states), responses with their movers, scenarios (paths beside the
    baseline), shocks and summaries. conditions are those of run_scenarios.
    """
    spark, system = row.sparkSession, _system(model, row)
    base = forecasting.forecasts(row, [key], model, data, horizon, cond, conditional)
    tables = {"baseline": _named(base.select("part", "h", "variable", "value"), "variable", observables)}
    if cube is not None:
        drawn = forecasting.forecasts(row, [key], model, data, horizon, cond, conditional, cube)
        tables["bands"] = _named(bands(drawn, ["part", "h", "variable"], "value"), "variable", observables)
    tables["history"] = forecasting.histories(row, [key], model, data, cond, conditional, smooth=True).select("t", "state", "value")
    tables["responses"] = response_lines(responses(spark, system, horizon, shocks, observables))
    used, _, _ = forecasting.split(data, cond, conditional)
    start = statespace.filtered(system, used)["state"][-1]
    runs = written(forecasting.run_scenarios(conditions, "scenario", system, start, horizon, shocks, observables, policy), "scenarios")
    tables["scenarios"] = runs.where("part = 'path'").select("scenario", "kind", "h", F.col("name").alias("variable"), "value", "baseline", (F.col("value") - F.col("baseline")).alias("deviation"))
    tables["shocks"] = runs.where("part = 'shock' and value <> 0").select("scenario", "h", F.col("name").alias("shock"), "value")
    tables["summaries"] = runs.where("part = 'summary'").groupBy("scenario", "kind").pivot("name", ["largest shock", "joint norm", "deviations passed", "miss"]).agg(shown(F.max("value"), 6))
    return write_bundle(path, "quarterly_package", tables, ["summaries"], horizon=horizon, periods=len(data), condition=cond, **facts)


def study_package(row: DataFrame, model: Model, data: np.ndarray, baseline: DataFrame, targets: DataFrame, observable: str, slope: float, shocks: Sequence[str], observables: Sequence[str], path: str, **facts) -> dict:
    """A study of an outside variable's targets: what each asks of the model's observable, met by the smallest shocks, beside one-deviation shocks; returns the manifest.

    baseline has (h, value) of the outside variable, targets (scenario, target).
    """
    spark, system = row.sparkSession, _system(model, row)
    horizon = baseline.count()
    conditions = scenarios.target_conditions(targets, baseline, observable, slope).unionByName(scenarios.one_sided(spark, shocks))
    start = statespace.filtered(system, data)["state"][-1]
    runs = written(forecasting.run_scenarios(conditions, "scenario", system, start, horizon, shocks, observables, shocks[0]), "study")
    paths = runs.where("part = 'path'").select("scenario", "kind", "h", F.col("name").alias("variable"), "value", "baseline")
    met = paths.where((F.col("kind") == "condition") & (F.col("variable") == observable)).join(targets, "scenario")
    outside = met.join(baseline.withColumnRenamed("value", "_b"), "h").select("target", "h", (F.col("_b") + (F.col("value") - F.col("baseline")) / F.lit(slope)).alias("value"), F.col("_b").alias("baseline"))
    tables = {"paths": paths, "outside": outside, "stress": stress_table(outside), "summaries": runs.where("part = 'summary'").select("scenario", "kind", "name", shown("value", 6).alias("value"))}
    return write_bundle(path, "study_package", tables, ["stress"], horizon=horizon, observable=observable, **facts)
