"""Series on a quarterly grid: aggregation, revisions, merges, coverage and quality checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.quarters import quarter_index, quarter_label


class CoverageError(ValueError):
    """A source lacks rows or values that a model needs."""


def exact_mean(value: str | Column, places: int = 2) -> Column:
    """The mean of numbers of so many decimal places, whose sum doesn't hang on the order of rows."""
    c = F.col(value) if isinstance(value, str) else value
    return F.try_divide(F.sum(c.cast(f"decimal(18,{places})")).cast("double"), F.count(c))


def quarterly(df: DataFrame, keys: Sequence[str], date: str, value: str, how: str = "mean", tie: str | None = None, places: int | None = None) -> DataFrame:
    """One row per key and quarter: the mean or the last of the values that aren't null.

    "Last" is by date (then tie), never by the order of rows. All-null quarters stay, null.
    With places, the mean is exact for values of so many decimal places.
    """
    if how not in ("mean", "last"):
        raise ValueError(f"unknown aggregation: {how}")
    present = F.when(F.col(value).isNotNull(), F.struct(date, *([tie] if tie else [])))
    out = (F.avg(value) if places is None else exact_mean(value, places)) if how == "mean" else F.max_by(value, present)
    return df.groupBy(*keys, quarter_index(date).alias("quarter_idx")).agg(out.alias("value"))


def latest_revision(df: DataFrame, keys: Sequence[str], *newest_last: str) -> DataFrame:
    """One row per key: the one whose revision columns are the largest."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(x).desc_nulls_last() for x in newest_last])
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def quarter_grid(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("quarter_idx"))


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, which fails when it runs if a key repeats: joins and pivots below would multiply or mix such rows."""
    repeated = F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1
    shown = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    # the error is a column that must be null, so nothing runs before the plan does
    fault = F.when(repeated, F.raise_error(F.concat(F.lit("repeated keys: "), shown)).cast("string"))
    return df.withColumn("_fault", fault).where("_fault is null").drop("_fault")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def merge_series(series: dict[str, DataFrame]) -> DataFrame:
    """Full outer merge of (quarter_idx, value) tables to one wide table: a union and one shuffle instead of a chain of joins."""
    names = list(series)
    long = None
    for name in names:
        part = series[name].select("quarter_idx", F.lit(name).alias("name"), F.col("value").cast("double").alias("value"))
        long = part if long is None else long.unionByName(part)
    return long.groupBy("quarter_idx").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])


def on_grid(grid: DataFrame, df: DataFrame) -> DataFrame:
    """Left join of a series onto a quarter grid."""
    return grid.join(df, "quarter_idx", "left")


def missing_quarters(grid: DataFrame, df: DataFrame) -> DataFrame:
    return grid.join(df.select("quarter_idx").distinct(), "quarter_idx", "left_anti").select("quarter_idx", quarter_label("quarter_idx").alias("label"))


def value_coverage(grid: DataFrame, long: DataFrame) -> DataFrame:
    """Quarters of the grid without a value, per name of a long (name, quarter_idx, value) table."""
    quarters = grid.agg(F.collect_list("quarter_idx").alias("quarters"))  # one row: the grid is a parameter
    wanted = long.select("name").distinct().crossJoin(F.broadcast(quarters)).select("name", F.explode("quarters").alias("quarter_idx"))
    return wanted.join(long.where(F.col("value").isNotNull()), ["name", "quarter_idx"], "left_anti")


def ragged(long: DataFrame) -> DataFrame:
    """Per series: first and last quarter with a value, and how many nulls lie between (leading and trailing ones are fine)."""
    w = Window.partitionBy("name")
    known = F.when(F.col("value").isNotNull(), F.col("quarter_idx"))
    spans = long.select("*", F.min(known).over(w).alias("first"), F.max(known).over(w).alias("last"))
    inside = F.col("value").isNull() & (F.col("quarter_idx") > F.col("first")) & (F.col("quarter_idx") < F.col("last"))
    return spans.groupBy("name").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum(F.when(inside, 1).otherwise(0)).alias("interior_nulls"))


def quality_report(long: DataFrame, last_quarter: int | None = None) -> DataFrame:
    """Per series: observed cells, share, last value's quarter, and a status; a series should reach last_quarter, or else the last of the table's quarters."""
    out = long.groupBy("name").agg(
        F.count(F.lit(1)).alias("cells"),
        F.count("value").alias("observed"),
        F.max(F.when(F.col("value").isNotNull(), F.col("quarter_idx"))).alias("latest"),
        F.max_by("value", F.when(F.col("value").isNotNull(), F.col("quarter_idx"))).alias("latest_value"),
        F.max("quarter_idx").alias("_last"),
    )
    # one row a series reaches the window over all
    last = F.max("_last").over(Window.partitionBy()) if last_quarter is None else F.lit(last_quarter)
    status = F.when(F.col("observed") == 0, "all missing").when(F.col("latest") < last, "missing at end").otherwise("ok")
    out = out.withColumn("status", status).drop("_last")
    return out.withColumn("share", F.col("observed") / F.col("cells"))


def sample(df: DataFrame, start: int | None, forecast_start: int, inside: bool = True) -> DataFrame:
    """In-sample rows (from start on, before forecast_start) or those from forecast_start on."""
    q = F.col("quarter_idx")
    if not inside:
        return df.where(q >= forecast_start)
    return df.where((q < forecast_start) & ((q >= start) if start is not None else F.lit(True)))


def with_optional(df: DataFrame, required: Sequence[str], optional: Sequence[str]) -> DataFrame:
    """required and optional columns; optional ones that aren't there are null, required ones raise together."""
    if lacking := [x for x in required if x not in df.columns]:
        raise CoverageError(f"missing columns: {lacking}")
    return df.select(*required, *[F.col(x) if x in df.columns else F.lit(None).cast("double").alias(x) for x in optional])


def empty_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    counts = df.agg(*[F.count(x).alias(x) for x in names]).first()
    return [x for x in names if counts[x] == 0]


def bridge(df: DataFrame, y: str, x: str, weights: dict[str, str] | None = None) -> DataFrame:
    """Least squares of y on 1 and x: intercept, slope, R2 (0 if y is constant), rows; beside it, per sub-sample condition, slope and rows."""
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    pick = lambda c, cond=None: F.when(both if cond is None else both & cond, F.col(c))
    aggs = [
        F.regr_intercept(pick(y), pick(x)).alias("intercept"),
        F.regr_slope(pick(y), pick(x)).alias("slope"),
        F.when(F.regr_syy(pick(y), pick(x)) == 0, F.lit(0.0)).otherwise(F.regr_r2(pick(y), pick(x))).alias("r2"),
        F.count(pick(y)).alias("n"),
    ]
    for name, condition in (weights or {}).items():
        cond = F.expr(condition)
        aggs += [F.regr_slope(pick(y, cond), pick(x, cond)).alias(f"slope_{name}"), F.count(pick(y, cond)).alias(f"n_{name}")]
    return df.agg(*aggs)


def hours_bridge(df: DataFrame, keys: Sequence[str], order: str, hours: str, unemployment: str, early: int, late: int, least: int = 20) -> DataFrame:
    """Least squares of the change of hours on the change of unemployment, one row: the whole sample and the slopes before `early` and from `late` on.

    A slope with under `least` quarters behind it is null; under `least` in all fails the query.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    change = lambda x: F.col(x) - F.lag(x).over(w)
    d = df.select(order, change(hours).alias("y"), change(unemployment).alias("x"))
    out = bridge(d, "y", "x", {"early": f"{order} < {early}", "late": f"{order} >= {late}"})
    fault = F.when(F.col("n") < least, F.raise_error(F.concat(F.lit("too few quarters: "), F.col("n").cast("string"))).cast("string"))
    slopes = {f"slope_{p}": F.when(F.col(f"n_{p}") >= least, F.col(f"slope_{p}")) for p in ("early", "late")}
    return out.withColumn("_f", fault).where("_f is null").drop("_f").withColumns(slopes)
