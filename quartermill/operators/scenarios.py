"""Scenario paths and summaries, all as relational plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def structural_path(components: DataFrame, horizon: int) -> DataFrame:
    """(scenario, h, shock, value) from components (scenario, shock, size_sd, start, duration, decay, scale).

    A component adds size * decay^k * scale at start + k; what falls beyond the horizon is cut.
    """
    steps = components.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("duration") - 1)))
    rows = steps.select("scenario", "shock", (F.col("start") + F.col("k")).alias("h"), (F.col("size_sd") * F.pow("decay", F.col("k")) * F.col("scale")).alias("value"))
    return rows.where(F.col("h") < horizon).groupBy("scenario", "shock", "h").agg(F.sum("value").alias("value"))


def ramp_path(targets: DataFrame, horizon: int, ramp: int = 4, hold: int = 4, back: int = 8) -> DataFrame:
    """Ramp from base to target over `ramp` quarters (both ends included), hold it, return over `back`, stay."""
    h, base, target = F.col("h"), F.col("base"), F.col("target")
    rows = targets.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))
    value = (
        F.when(h < ramp, base + (target - base) * h / max(ramp - 1, 1))
        .when(h < ramp + hold, target)
        .when(h < ramp + hold + back, target + (base - target) * (h - ramp - hold) / max(back - 1, 1))
        .otherwise(base)
    )
    return rows.withColumn("value", value)


def floor_conditions(path: DataFrame, keys: Sequence[str], order: str, rate: str, floor: float, leads: int, annual: bool = True) -> DataFrame:
    """A rate path held at its floor, in quarterly units, and its own next `leads` values beside it."""
    w = Window.partitionBy(*keys).orderBy(order)
    held = F.greatest(F.col(rate), F.lit(floor)) / (4 if annual else 1)
    out = path.withColumn("rate0", held)
    return out.select(*keys, order, "rate0", *[F.lead("rate0", k).over(w).alias(f"rate{k}") for k in range(1, leads + 1)])


def padded(shocks: DataFrame, names: DataFrame, horizon: int) -> DataFrame:
    """Shocks (h, shock, value) on the whole grid of horizons and names: gaps are 0, later rows are cut."""
    grid = names.select("shock").withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))
    return grid.join(shocks, ["h", "shock"], "left").select("h", "shock", F.coalesce("value", F.lit(0.0)).alias("value"))


def summary(rows: DataFrame, variables: Sequence[str], key: str = "scenario") -> DataFrame:
    """Smallest and largest deviation of each named variable per scenario."""
    picks = []
    for v in variables:
        d = F.when(F.col("variable") == v, F.col("deviation"))
        picks += [F.min(d).alias(f"{v}_min"), F.max(d).alias(f"{v}_max")]
    return rows.groupBy(key).agg(*picks)


def domain_flag(single: Column, joint: Column) -> Column:
    """How far shocks, in deviations, leave the range where a linear model can be trusted: one alone or a quarter's together."""
    beyond = lambda n: (single > n) | (joint > n)
    return F.when(beyond(8), "extreme_extrapolation").when(beyond(4), "stress_extrapolation").otherwise("within_4sd")


def standardised(shocks: DataFrame, scales: DataFrame, on: Sequence[str]) -> DataFrame:
    """Shocks with z, the value over its shock's scale; 0 where the scale is next to nothing."""
    z = F.when(F.col("scale") > 1e-12, F.col("value") / F.col("scale")).otherwise(F.lit(0.0))
    return shocks.join(scales, list(on)).withColumn("z", z)


def joint_norm(shocks: DataFrame, key: str = "scenario") -> DataFrame:
    """Per scenario: the largest standardised shock, the largest root of summed squares of a quarter, and the flag."""
    quarter = shocks.groupBy(key, "h").agg(F.max(F.abs("z")).alias("single"), F.sqrt(F.sum(F.col("z") * F.col("z"))).alias("joint"))
    out = quarter.groupBy(key).agg(F.max("single").alias("max_single"), F.max("joint").alias("max_joint"))
    return out.withColumn("domain", domain_flag(F.col("max_single"), F.col("max_joint")))


def components_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "scenario string, shock string, size_sd double, start int, duration int, decay double, scale double")


def one_sided(spark: SparkSession, shocks: Sequence[str], size_sd: float = 1.0) -> DataFrame:
    """A structural scenario a shock: it alone, once, in the first quarter (scenario, kind, h, name, value)."""
    return spark.createDataFrame([(f"{s}_{size_sd:g}sd", "structural", 0, s, float(size_sd)) for s in shocks], "scenario string, kind string, h int, name string, value double")


def target_conditions(targets: DataFrame, baseline: DataFrame, name: str, slope: float = 1.0, ramp: int = 4, hold: int = 4, back: int = 8) -> DataFrame:
    """Conditions on an observable that follow from an outside variable: its path ramps from the baseline to each target and back, and moves the observable by slope.

    targets has (scenario, target), baseline (h, value) of the outside variable, from 0 on; a few rows each.
    """
    start = baseline.where("h = 0").select(F.col("value").alias("base"))  # one row
    horizon = baseline.agg(F.max("h")).first()[0] + 1
    path = ramp_path(targets.crossJoin(F.broadcast(start)), horizon, ramp, hold, back).select("scenario", "h", "value")
    away = path.join(baseline.withColumnRenamed("value", "_b"), "h")
    return away.select("scenario", F.lit("condition").alias("kind"), "h", F.lit(name).alias("name"), (F.lit(slope) * (F.col("value") - F.col("_b"))).alias("value"))
