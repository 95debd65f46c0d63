"""Parquet and CSV forms of results: long array fixtures, wide baselines, scenario configurations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIG = """start_date string, model_end_date string, horizon int, stochastic_draws int, seed long,
unemployment_targets array<double>,
policy_scenarios array<struct<name:string,label:string,rate_deviation_pp:array<double>>>,
structural_scenarios array<struct<name:string,label:string,components:array<struct<shock:string,size_sd:double,start:int,duration:int,decay:double>>>>"""


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """A scenario configuration with the hash of its bytes."""
    raw = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("sha256"))
    return spark.read.schema(CONFIG).json(path, multiLine=True).crossJoin(F.broadcast(raw))  # one row each


def config_faults(config: DataFrame) -> list[str]:
    """What is wrong with a configuration; empty if nothing is."""
    names = F.concat(F.coalesce(F.col("policy_scenarios.name"), F.array()), F.coalesce(F.col("structural_scenarios.name"), F.array()))
    row = config.select(
        (F.col("horizon") >= 4).alias("horizon is under 4"),
        (F.size(names) == F.size(F.array_distinct(names))).alias("scenario names repeat"),
        (~F.array_contains(names, "baseline")).alias("a scenario is called baseline"),
        (~F.exists(F.coalesce("policy_scenarios", F.array().cast("array<struct<name:string,label:string,rate_deviation_pp:array<double>>>")), lambda s: F.size(s["rate_deviation_pp"]) > F.col("horizon"))).alias("a rate path is longer than the horizon"),
    ).first()
    return [fault for fault, fine in row.asDict().items() if fine is False]


def config_components(config: DataFrame) -> DataFrame:
    """Components of the structural scenarios, one a row."""
    s = config.select(F.explode("structural_scenarios").alias("s"))
    return s.select(F.col("s.name").alias("scenario"), F.explode("s.components").alias("c")).select("scenario", "c.*")


def write_arrays(df: DataFrame, path: str) -> None:
    """A long array table (array, i, j, value), one folder an array."""
    df.write.partitionBy("array").mode("overwrite").parquet(path)


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_wide_csv(long: DataFrame, key: Sequence[str], names: Sequence[str], path: str) -> None:
    from ..operators.reshape import wide

    wide(long, key, "variable", "value", names).orderBy(*key).write.mode("overwrite").csv(path, header=True)
