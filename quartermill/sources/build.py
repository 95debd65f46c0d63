"""Files of observables built from files of levels: read, transformed and written in one call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quarters import parse_quarter, quarter_end
from ..operators.ingest import CoverageError
from ..operators.observables import Observable, observed, population_helpers
from .levels import levels_from_sources, located, read_wide, requirements


def transformed(levels: DataFrame, observables: Sequence[Observable], forecast: DataFrame | None = None, population: str = "CNP16OV__FRED", **settings) -> DataFrame:
    """quarter_idx and one column an observable, from levels; the population's trend, over its forecast too, where levels have a population."""
    name = next((c for c in (population, population.split("__")[0]) if c in levels.columns), None)
    return observed(population_helpers(levels, name, forecast) if name else levels, observables, **settings)


def write_wide(df: DataFrame, path: str) -> None:
    """quarter_idx and numbers as CSV with a date column, the quarter's last day, ordered by it."""
    names = [c for c in df.columns if c != "quarter_idx"]
    df.orderBy("quarter_idx").select(quarter_end("quarter_idx").alias("date"), *names).coalesce(1).write.mode("overwrite").csv(path, header=True)  # one row a quarter


def build_observables(spark: SparkSession, levels_path: str, observables: Sequence[Observable], path: str, forecast_path: str | None = None, **settings) -> DataFrame:
    """Writes the observables of one file of levels to path; returns what was written."""
    forecast = read_wide(spark, forecast_path) if forecast_path else None
    write_wide(transformed(read_wide(spark, levels_path), observables, forecast, **settings), path)
    return read_back(spark, path, [o.name for o in observables])


def build_from_sources(spark: SparkSession, root: str, vintage: str, observables: Sequence[Observable], path: str, optional: Sequence[str] = (), quarters: tuple[int, int] | None = None, forecast_path: str | None = None, **settings) -> DataFrame:
    """The same from the files that the observables' mnemonics ask of each source, found under root; a source without a file is an error."""
    names = [n for o in observables for n in o.sources] + [settings.get("population", "CNP16OV__FRED")]
    needs = requirements(spark.createDataFrame(list(enumerate(dict.fromkeys(names))), "ord int, name string"), optional)
    found = located(spark, needs, root, vintage).collect()  # a row a source
    if lacking := [r.source for r in found if r.path is None]:
        raise CoverageError(f"no file of {lacking} under {root}")
    levels = levels_from_sources({r.source: (read_wide(spark, r.path), list(r.mnemonics)) for r in found}, optional, quarters)
    forecast = read_wide(spark, forecast_path) if forecast_path else None
    write_wide(transformed(levels, observables, forecast, **settings), path)
    return read_back(spark, path, [o.name for o in observables])


def read_back(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    raw = spark.read.csv(path, header=True, schema=", ".join(["date string", *[f"`{n}` double" for n in names]]))
    return raw.select(parse_quarter("date").alias("quarter_idx"), *names)


def write_levels(payload: DataFrame, path: str, aggregation: str = "mean") -> DataFrame:
    """Levels of downloaded observations (series, date, value) as a wide CSV, one row a quarter: their mean, sum or last value in it. Fetching is the caller's."""
    if aggregation not in ("mean", "sum", "last"):
        raise ValueError(f"unknown aggregation: {aggregation}")
    value = {"mean": F.avg("value"), "sum": F.sum("value"), "last": F.max_by("value", F.when(F.col("value").isNotNull(), F.col("date")))}[aggregation]
    names = sorted(r[0] for r in payload.select("series").distinct().collect())  # a name a series
    wide = payload.withColumn("quarter_idx", parse_quarter("date")).where("quarter_idx is not null").groupBy("quarter_idx").pivot("series", names).agg(value)
    write_wide(wide, path)
    return read_back(wide.sparkSession, path, names)


def request(series: str, vintage: str | None = None, realtime: tuple[str, str] | None = None, output: int | None = None) -> dict[str, str]:
    """The parameters of an observations request, checked; nothing is fetched. A vintage excludes a realtime span, and each has its own default output (2 and 1)."""
    if not series:
        raise ValueError("a series has a name")
    if vintage and realtime:
        raise ValueError("a vintage excludes a realtime span")
    if output is not None and output not in (1, 2, 3, 4):
        raise ValueError("output is 1, 2, 3 or 4")
    out = {"series_id": series}
    if vintage:
        out |= {"vintage_dates": vintage, "output_type": str(output or 2)}
    elif realtime:
        if realtime[1] < realtime[0]:
            raise ValueError("the realtime span ends before it begins")
        out |= {"realtime_start": realtime[0], "realtime_end": realtime[1], "output_type": str(output or 1)}
    elif output is not None:
        out["output_type"] = str(output)
    return out
