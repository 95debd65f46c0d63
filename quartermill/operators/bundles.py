"""Report bundles: labelled long tables, what their figures show, and their files with a manifest and a page of text."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bands import reconciliation
from .frames import history_and_forecast, markdown


def _one(rows: DataFrame, text: str) -> DataFrame:
    return rows.sparkSession.createDataFrame([(text,)], "value string").coalesce(1)


def labelled(rows: DataFrame, column: str, labels: Sequence[str], name: str) -> DataFrame:
    """rows with the label of a position (0, 1, ...) instead of it; an axis whose largest position isn't the last label's fails the query."""
    last = rows.agg(F.coalesce(F.max(column), F.lit(-1)).alias("_last"), F.coalesce(F.min(column), F.lit(0)).alias("_first"))  # one row
    wrong = (F.col("_last") != len(labels) - 1) | (F.col("_first") < 0)
    fault = F.raise_error(F.concat(F.lit(f"axis {name} has {len(labels)} labels for "), (F.col("_last") + 1).cast("string"), F.lit(" entries"))).cast("string")
    names = F.array(*map(F.lit, labels)) if labels else F.array().cast("array<string>")
    label = F.when(wrong, fault).otherwise(F.try_element_at(names, (F.col(column) + 1).cast("int")))
    return rows.crossJoin(F.broadcast(last)).withColumn("_label", label).drop("_last", "_first", column).withColumnRenamed("_label", name)


def in_parallel(a: DataFrame, b: DataFrame, keys: Sequence[str], quarter: str) -> DataFrame:
    """Rows of two tables that stand side by side, matched by quarter after checking that both have the same quarters of each key, once each; otherwise the query fails."""
    count = lambda df, n: df.groupBy(*keys, quarter).agg(F.count(F.lit(1)).alias(n))
    uneven = count(a, "_a").join(count(b, "_b"), [*keys, quarter], "full").where("coalesce(_a, 0) <> 1 or coalesce(_b, 0) <> 1")
    found = uneven.agg(F.count(F.lit(1)).alias("_uneven"), F.min(quarter).alias("_where"))  # one row
    fault = F.when(F.col("_uneven") > 0, F.raise_error(F.concat(F.lit("quarters differ, first at "), F.col("_where").cast("string"))).cast("string"))
    both = a.join(b, [*keys, quarter]).crossJoin(F.broadcast(found))
    return both.withColumn("_f", fault).where("_f is null").drop("_f", "_uneven", "_where")


def in_order(rows: DataFrame, place: str, quarter: str) -> DataFrame:
    """rows of a file (numbered by place) whose quarters are there, once each and ascending; what isn't so fails the query. A few rows a series."""
    before = F.lag(quarter).over(Window.orderBy(place))
    fault = F.when(F.col(quarter).isNull(), "missing quarter at row ").when(F.col("_before") == F.col(quarter), "repeated quarter at row ").when(F.col("_before") > F.col(quarter), "quarters aren't ascending at row ")
    checked = rows.withColumn("_before", before).withColumn("_f", F.when(fault.isNotNull(), F.raise_error(F.concat(fault, F.col(place).cast("string"))).cast("string")))
    return checked.where("_f is null").drop("_before", "_f")


def response_lines(responses: DataFrame, top: int = 6) -> DataFrame:
    """(variable, shock, h, response, mover): responses of the shocks that move most, all variables and quarters together; ties by name."""
    size = responses.groupBy("shock").agg(F.sum(F.abs("response")).alias("_size"))
    movers = size.orderBy(F.col("_size").desc(), "shock").limit(top)
    rank = movers.withColumn("mover", F.expr("row_number() over (order by _size desc, shock)")).select("shock", "mover")  # at most `top` rows
    return responses.join(F.broadcast(rank), "shock").select("variable", "shock", "h", "response", "mover")


def response_panel(lines: DataFrame) -> DataFrame:
    """(variable, h, response): the lines of each variable's panel added up."""
    return lines.groupBy("variable", "h").agg(F.sum("response").alias("response"))


def reconciled(decomposition: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """A decomposition (t, variable, driver, contribution, ..., observed) whose drivers add up to what was observed; a larger error than the tolerance fails the query."""
    gate = reconciliation(decomposition)  # one row
    fault = F.when(F.col("max_error") > tolerance, F.raise_error(F.concat(F.lit("drivers miss the observed path by "), F.col("max_error").cast("string"))).cast("string"))
    return decomposition.crossJoin(F.broadcast(gate)).withColumn("_f", fault).where("_f is null").drop("_f", "max_error")


def driver_shares(decomposition: DataFrame) -> DataFrame:
    """(variable, driver, size, share, place): mean absolute contribution of each driver, its share, and its place; ties by name."""
    size = decomposition.groupBy("variable", "driver").agg(F.avg(F.abs("contribution")).alias("size"))
    w = Window.partitionBy("variable")
    return size.select("variable", "driver", "size", F.try_divide("size", F.sum("size").over(w)).alias("share"), F.row_number().over(w.orderBy(F.col("size").desc(), "driver")).alias("place"))


def forecast_panel(history: DataFrame, bands: DataFrame, quarter: str = "quarter_idx", tail: int = 24) -> DataFrame:
    """(variable, quarter, part, x, value, lower, upper): the last quarters of history, then the bands' mean; history's bounds are its value."""
    last = history.groupBy("variable").agg(F.max(quarter).alias("_last"))
    recent = history.join(last, "variable").where(F.col(quarter) > F.col("_last") - tail).select("variable", quarter, "value", F.col("value").alias("lower"), F.col("value").alias("upper"))
    ahead = bands.select("variable", quarter, F.col("mean").alias("value"), "lower", "upper")
    return history_and_forecast(recent, ahead, ["variable"], quarter)


def stress_table(paths: DataFrame, key: str = "target") -> DataFrame:
    """One row a target of (target, h, value, baseline) paths, by target: peak and its quarter, mean deviation, and the first quarter in which the target is reached."""
    away = F.col("value") - F.col("baseline")
    peak = F.max_by("h", F.struct(F.abs(away), -F.col("h")))
    reached = F.min(F.when(F.col("value") >= F.col(key) - 1e-9, F.col("h")))
    out = paths.groupBy(key).agg(F.max_by("value", F.struct(F.abs(away), -F.col("h"))).alias("peak"), peak.alias("peak_h"), F.avg(away).alias("mean_deviation"), reached.alias("reached_h"))
    return out.orderBy(key)


def study_lines(paths: DataFrame, key: str = "target") -> DataFrame:
    """Lines of a target's path and of its baseline, long: (target, line, h, value)."""
    return paths.unpivot([key, "h"], ["value", "baseline"], "line", "value").select(key, "line", "h", "value")


def write_bundle(path: str, kind: str, tables: dict[str, DataFrame], text: Sequence[str] = (), **facts) -> dict:
    """Every table as Parquet under path/name, a manifest (kind, facts, tables with their columns) as path/manifest, and a page with the named small tables as path/page.

    The page's tables are those that `text` names; a long one fails instead of being cut.
    """
    if not tables or (unknown := [n for n in text if n not in tables]):
        raise ValueError(f"a bundle has tables, and its page only those: {unknown if tables else []}")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    manifest = {"kind": kind, **facts, "tables": {n: df.columns for n, df in tables.items()}}
    first = next(iter(tables.values()))
    page = "\n\n".join([f"# {kind.replace('_', ' ')}", *[f"- {k}: {v}" for k, v in facts.items()], *[f"## {n}\n\n{markdown(first.sparkSession.read.parquet(f'{path}/{n}').orderBy(*tables[n].columns))}" for n in text]])
    _one(first, json.dumps(manifest)).write.mode("overwrite").text(f"{path}/manifest")
    _one(first, page).write.mode("overwrite").text(f"{path}/page")
    return manifest


def bench_report(results: DataFrame, path: str) -> None:
    """Benchmark results (machine, command map, and a result's columns) as one JSON document a machine, in the form that read_reports takes."""
    fields = [c for c in results.columns if c not in ("machine", "command")]
    rows = results.groupBy("machine").agg(F.any_value("command").alias("command"), F.array_sort(F.collect_list(F.struct(*fields))).alias("results"))
    rows.repartition("machine").write.mode("overwrite").partitionBy("machine").json(path)
