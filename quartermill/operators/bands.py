"""Means and exact quantile bands of sampled paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.transforms import by_name, missing_as_null


#: Ranges of an octave of values, and equal parts that a range is cut into where a rank lies.
OCTAVE, PARTS = 16, 4_096


def exact_quantiles(rows: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float], places: int | None = None) -> DataFrame:
    """Per key: mean, and linearly interpolated quantiles of the values that aren't null, by name; keys without a value stay, null.

    With places, values have so many decimal places and the mean is exact.

    Values are counted first. The counts of value ranges, OCTAVE an octave, say which ranges
    hold the wanted ranks; these are cut into PARTS between their own least and largest value,
    and only the parts that hold a rank are put in order. So what a task orders is a small
    part of a key's values, however close together they lie.
    """
    v = F.col("_v")
    place = F.signum(v) * (20_000 + F.floor(F.log2(F.abs(v)) * OCTAVE))
    counted = rows.select(*keys, F.col(value).cast("double").alias("_v")).groupBy(*keys, F.when(v == 0, 0.0).otherwise(place).cast("int").alias("_range"), "_v").agg(F.count("_v").alias("_c"))
    times = v * F.col("_c") if places is None else v.cast(f"decimal(18,{places})") * F.col("_c").cast("decimal(12,0)")
    own = Window.partitionBy(*keys)
    ranges = counted.groupBy(*keys, "_range").agg(F.sum("_c").alias("_in"), F.sum(times).alias("_sum"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    n = F.sum("_in").over(own)
    spans = ranges.select(*keys, "_range", "_in", "_least", "_most", n.alias("_n"), (F.sum("_sum").over(own).cast("double") / n).alias("mean"), _before(own, "_range").alias("_before"))
    rank = {name: (F.col("_n") - 1) * F.lit(float(p)) for name, p in probabilities.items()}

    def holds(df: DataFrame) -> DataFrame:
        inside = F.col("_n") == 0
        for r in rank.values():
            inside |= (F.ceil(r) >= F.col("_before")) & (F.floor(r) < F.col("_before") + F.col("_in"))
        return df.where(inside)

    near = _matched(counted, holds(spans).select(*keys, "_range", "_n", "mean", "_before", "_least", "_most"), [*keys, "_range"])
    share = (v - F.col("_least")) / (F.col("_most") - F.col("_least"))
    part = F.when(F.col("_most") > F.col("_least"), F.least(F.floor(share * PARTS), F.lit(PARTS - 1))).otherwise(0)
    near = near.withColumn("_part", part.cast("int"))
    within = Window.partitionBy(*keys, "_range")
    parts = near.groupBy(*keys, "_range", "_part").agg(F.sum("_c").alias("_in"), F.max("_n").alias("_n"), F.max("_before").alias("_base"))
    parts = holds(parts.withColumn("_before", F.col("_base") + _before(within, "_part"))).select(*keys, "_range", "_part", F.col("_before").alias("_from_here"))
    last = _matched(near, parts, [*keys, "_range", "_part"])
    to = F.sum("_c").over(Window.partitionBy(*keys, "_range", "_part").orderBy("_v")) + F.col("_from_here")
    ends = last.select(*keys, "_v", "_n", "mean", to.alias("_to"), (to - F.col("_c")).alias("_from"))
    picks = []
    for name, r in rank.items():
        hit = lambda at: F.max(F.when((at >= F.col("_from")) & (at < F.col("_to")), v))
        picks += [hit(F.floor(r)).alias(f"_lo_{name}"), hit(F.ceil(r)).alias(f"_hi_{name}"), F.max(r - F.floor(r)).alias(f"_w_{name}")]
    found = ends.groupBy(*keys).agg(F.max("mean").alias("mean"), *picks)
    return found.select(*keys, "mean", *[(F.col(f"_lo_{x}") + F.col(f"_w_{x}") * (F.col(f"_hi_{x}") - F.col(f"_lo_{x}"))).alias(x) for x in probabilities])


def _before(window, by: str) -> Column:
    return F.coalesce(F.sum("_in").over(window.orderBy(F.col(by).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _matched(rows: DataFrame, found: DataFrame, on: Sequence[str]) -> DataFrame:
    """rows beside what was found of their (possibly null) columns `on`."""
    same = F.lit(True)
    for k in on:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(found.withColumnsRenamed({k: f"_k_{k}" for k in on}), same).drop(*[f"_k_{k}" for k in on])


def bands(samples: DataFrame, keys: Sequence[str], value: str, lower: float = 0.05, upper: float = 0.95, places: int | None = None) -> DataFrame:
    """Per key: mean (exact for values of so many decimal places), and linearly interpolated quantiles of the values that aren't missing."""
    return exact_quantiles(samples.select(*keys, missing_as_null(value).alias("_value")), keys, "_value", {"lower": lower, "upper": upper}, places)


def transformed_bands(samples: DataFrame, keys: Sequence[str], value: str, transform: str, lower: float = 0.05, upper: float = 0.95) -> DataFrame:
    """Bands in report units: each sample is transformed first, then the quantiles are taken."""
    return bands(samples.withColumn(value, by_name(F.lit(transform), value)), keys, value, lower, upper)


def bands_then_transform(samples: DataFrame, keys: Sequence[str], value: str, transform: str, lower: float = 0.05, upper: float = 0.95) -> DataFrame:
    """Bands in model units whose three numbers are transformed afterwards: another mean, as transforms aren't linear."""
    out = bands(samples, keys, value, lower, upper)
    return out.select(*keys, *[by_name(F.lit(transform), x).alias(x) for x in ("mean", "lower", "upper")])


def allocation_scale(total: Column, f, tiny: float = 1e-7, least: float = 1e-10) -> Column:
    """f(total) / total, or f's slope at zero where total is next to nothing."""
    return F.when(F.abs(total) > least, F.try_divide(f(total), total)).otherwise(f(F.lit(tiny)) / tiny)


def grouped_contributions(rows: DataFrame, groups: DataFrame, keys: Sequence[str], f) -> DataFrame:
    """Contributions of shocks summed to groups, in report units: scaled so that they add up to f of the total."""
    summed = rows.join(groups, "shock").groupBy(*keys, "driver").agg(F.sum("value").alias("value"))
    total = summed.groupBy(*keys).agg(F.sum("value").alias("total"))
    return summed.join(total, list(keys)).select(*keys, "driver", (F.col("value") * allocation_scale(F.col("total"), f)).alias("contribution"))


def group_faults(shocks: DataFrame, groups: DataFrame) -> DataFrame:
    """Shocks that aren't in exactly one group: (shock, groups)."""
    return shocks.select("shock").distinct().join(groups, "shock", "left").groupBy("shock").agg(F.count("driver").alias("groups")).where("groups <> 1")


def report_decomposition(contributions: DataFrame, groups: DataFrame, paths: DataFrame, f, tail: int | None = None, trend: str = "Initial conditions and trend", residual: str = "Observed-model residual") -> DataFrame:
    """(t, variable, driver, contribution, smoothed, observed) in report units.

    contributions has (t, variable, shock, value), paths (t, variable, baseline, smoothed,
    observed) in model units. Groups of shocks and the baseline share f(smoothed) in proportion;
    the residual is f(observed) - f(smoothed), so that drivers add up to f(observed). With tail,
    only the last so many periods are shown.
    """
    grouped = contributions.join(groups, "shock").groupBy("t", "variable", "driver").agg(F.sum("value").alias("value"))
    scale = allocation_scale(F.col("smoothed"), f)
    report = paths.select("t", "variable", "baseline", scale.alias("_scale"), f(F.col("smoothed")).alias("smoothed"), f(F.col("observed")).alias("observed"))
    if tail is not None:
        last = report.agg(F.max("t").alias("_last"))  # one row
        report = report.crossJoin(F.broadcast(last)).where(F.col("t") > F.col("_last") - tail).drop("_last")
    own = grouped.join(report, ["t", "variable"]).select("t", "variable", "driver", (F.col("value") * F.col("_scale")).alias("contribution"), "smoothed", "observed")
    both = F.array(F.struct(F.lit(trend).alias("driver"), (F.col("baseline") * F.col("_scale")).alias("contribution")), F.struct(F.lit(residual).alias("driver"), (F.col("observed") - F.col("smoothed")).alias("contribution")))
    rest = report.select("t", "variable", F.explode(both).alias("d"), "smoothed", "observed").select("t", "variable", "d.driver", "d.contribution", "smoothed", "observed")
    return own.unionByName(rest)


def reconciliation(decomposition: DataFrame) -> DataFrame:
    """The largest distance between drivers added up and what was observed; one row."""
    sums = decomposition.groupBy("t", "variable").agg(F.abs(F.sum("contribution") - F.first("observed")).alias("error"))
    return sums.agg(F.max("error").alias("max_error"))
