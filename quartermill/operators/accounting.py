"""Price-index accounting: effects of parts, what they leave over, and whether totals agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_sum(names: Sequence[str]) -> Column:
    """Sum over columns; missing parts count as 0."""
    out = F.lit(0.0)
    for n in names:
        out = out + F.coalesce(F.col(n), F.lit(0.0))
    return out


def accounting(df: DataFrame, headline: str, published: Sequence[str], splits: dict[str, str], tolerance: float = 0.10, exact: float = 1e-10, strict: bool = False) -> DataFrame:
    """The sum of published parts, what rounding leaves of the headline, and whether the drivers restore it.

    splits names, for a published part, the detail that is shown on its own; the drivers are
    the parts that aren't split, these details, what they leave of their parts (`<part>_other`)
    and the residual. With strict, a row whose residual is over tolerance or whose drivers miss
    the headline by over exact fails the query.
    """
    others = {f"{part}_other": F.coalesce(F.col(part), F.lit(0.0)) - F.coalesce(F.col(detail), F.lit(0.0)) for part, detail in splits.items()}
    out = df.withColumns(others).withColumn("sum_of_parts", row_sum(published)).withColumn("residual", F.col(headline) - F.col("sum_of_parts"))
    drivers = [*[x for x in published if x not in splits], *splits.values(), *others, "residual"]
    out = out.withColumn("error", F.abs(row_sum(drivers) - F.col(headline)))
    out = out.withColumn("residual_ok", F.abs("residual") <= tolerance).withColumn("reconciles", F.col("error") <= exact)
    if strict:
        text = F.concat(F.lit("accounting fails: residual "), F.col("residual").cast("string"), F.lit(", error "), F.col("error").cast("string"))
        fine = F.when(F.col("residual_ok") & F.col("reconciles"), F.lit(None)).otherwise(F.raise_error(text))
        out = out.withColumn("_fault", fine.cast("string")).where("_fault is null").drop("_fault")
    return out


def largest_errors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The largest absolute value of each column; one row."""
    return df.agg(*[F.max(F.abs(x)).alias(x) for x in columns])


def stale(df: DataFrame, quarter: str, wanted: int) -> DataFrame:
    """The last quarter of a table and whether it comes before the one wanted."""
    return df.agg(F.max(quarter).alias("last")).withColumn("stale", F.coalesce(F.col("last") < wanted, F.lit(True)))


def detail_residuals(df: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """For each total, what its listed details leave over: columns `<total>_rest`."""
    return df.withColumns({f"{total}_rest": F.coalesce(F.col(total), F.lit(0.0)) - row_sum(details) for total, details in groups.items()})


def control_total(goods: DataFrame, groups: Sequence[str], published: float, tolerance: float = 0.01) -> DataFrame:
    """Whether the contributions of the listed goods groups add up to the published number."""
    total = goods.agg(F.sum(F.when(F.col("group").isin(*groups), F.col("contribution"))).alias("total"))
    return total.withColumn("ok", F.abs(F.col("total") - published) <= tolerance)
