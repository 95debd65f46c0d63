"""The relational part of figures and reports: what each plot or table shows, as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .reshape import stacked

#: Names under which a forecast's outputs may be asked for.
OUTPUTS = {
    "observables": ("observables", "forecastobs"),
    "pseudo_observables": ("pseudo_observables", "forecastpseudo"),
    "states": ("states", "forecaststates"),
    "history_observables": ("history_observables", "histobs"),
    "history_pseudo_observables": ("history_pseudo_observables", "histpseudo"),
    "history_states": ("history_states", "histstates"),
}


def requested(long: DataFrame, names: Sequence[str], kind: str = "kind") -> DataFrame:
    """Rows of the outputs asked for by any of their names; an unknown name raises."""
    known = {alias: output for output, aliases in OUTPUTS.items() for alias in aliases}
    if unknown := [n for n in names if n not in known]:
        raise KeyError(f"unknown outputs: {unknown}")
    return long.where(F.col(kind).isin(*{known[n] for n in names}))


def band_frame(bands: DataFrame, keys: Sequence[str], values: Sequence[str] = ("mean", "lower", "upper")) -> DataFrame:
    """Bands as long rows (keys, statistic, value)."""
    return bands.unpivot(list(keys), list(values), "statistic", "value")


def without_samples(means: DataFrame, value: str) -> DataFrame:
    """Bands of a single path: mean, lower and upper are its value."""
    return means.withColumn("mean", F.col(value)).withColumn("lower", F.col(value)).withColumn("upper", F.col(value)).drop(value)


def panel_range(rows: DataFrame, keys: Sequence[str], panel: str, value: str, margin: float = 0.05) -> DataFrame:
    """rows with the axis range of their panel: its extremes, widened by a share of their distance."""
    spans = rows.groupBy(panel).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    room = (F.col("_hi") - F.col("_lo")) * margin
    return rows.join(spans, panel).select(*keys, panel, value, (F.col("_lo") - room).alias("axis_low"), (F.col("_hi") + room).alias("axis_high"))


def scenario_panel(rows: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Deviation lines of the named variables, with each scenario's label (the first by name) once for the legend."""
    legend = rows.groupBy("scenario").agg(F.min("scenario_label").alias("legend"))
    return rows.where(F.col("variable").isin(*variables)).join(legend, "scenario").select("scenario", "legend", "variable", "horizon", "deviation")


def driver_stacks(wide: DataFrame, key: str, drivers: Sequence[str]) -> DataFrame:
    """Stacked bars of driver columns, in the order given: base and value of each."""
    order = F.element_at(F.create_map(*[x for i, d in enumerate(drivers) for x in (F.lit(d), F.lit(i))]), F.col("driver"))
    long = wide.unpivot([key], list(drivers), "driver", "value").withColumn("place", order)
    return stacked(long, [key], "place", "value").select(key, "driver", "value", "base")


def history_and_forecast(history: DataFrame, forecast: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Both, one after the other, numbered 0, 1, ... without a gap within each key."""
    both = history.withColumn("part", F.lit("history")).unionByName(forecast.withColumn("part", F.lit("forecast")))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.when(F.col("part") == "history", 0).otherwise(1), order))
    return both.withColumn("x", place - 1)


def response_rows(base: DataFrame, responses: DataFrame, on: Sequence[str], f) -> DataFrame:
    """Responses in report units: f(base + response) - f(base)."""
    both = responses.join(base, list(on))
    return both.withColumn("response", f(F.col("base") + F.col("response")) - f(F.col("base"))).drop("base")


def markdown(df: DataFrame, limit: int = 1_000) -> str:
    """A small table as Markdown text; more rows than limit raise instead of being left out."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"over {limit} rows: aggregate before rendering")
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", r"\|")
    lines = [df.columns, ["---"] * len(df.columns), *([cell(v) for v in r] for r in rows)]
    return "\n".join(f"| {' | '.join(line)} |" for line in lines)


def last_known(rows: DataFrame, keys: Sequence[str], order: str, value: str, horizon: int, current: int) -> DataFrame:
    """The last value that is known, held over a horizon; `current` says whether it is as recent as the quarter wanted."""
    known = F.when(F.col(value).isNotNull(), F.col(order))
    last = rows.groupBy(*keys).agg(F.max(known).alias("last"), F.max_by(value, known).alias("value"))
    return last.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("h"), "value", (F.col("last") >= current).alias("current"))


def bounded_root(x: Column) -> Column:
    """The root of a number, that of 0 if it is negative."""
    return F.sqrt(F.greatest(x, F.lit(0.0)))
