"""Series files and API payloads as DataFrames; nothing here opens a network connection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, StringType, StructField, StructType

OBSERVATION = StructType([StructField("observation_date", StringType()), StructField("value", StringType())])
PAYLOAD = "struct<error_code:int,error_message:string,observations:array<map<string,string>>>"


def parsed_number(text: Column) -> Column:
    """A number, or null for `.` and anything else that isn't one; NaN and infinities are missing too."""
    n = text.try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def read_series_csv(spark: SparkSession, path: str, mnemonic: str) -> DataFrame:
    """A two-column series file: first the date, then the value. Rows without a date go."""
    raw = spark.read.csv(path, header=True, schema=OBSERVATION)
    return raw.select(F.lit(mnemonic).alias("mnemonic"), F.col("observation_date").try_cast(DateType()).alias("obs_date"), parsed_number(F.col("value")).alias("value")).where("obs_date is not null")


def read_levels_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A wide file of levels: `date` and the named columns, typed, not inferred."""
    schema = StructType([StructField("date", StringType())] + [StructField(x, DoubleType()) for x in columns])
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False, nanValue="NaN")


def newest_key(item: Column, mnemonic: str) -> Column:
    """The newest of an item's vintage keys, `MNEMONIC_YYYYMMDD` or `_MNEMONIC_YYYYMMDD`, whatever its value: struct of stamp and key."""
    tail = lambda k: F.substring(k, -8, 8)
    head = lambda k: (k.startswith(f"{mnemonic}_") & (F.length(k) == len(mnemonic) + 9)) | (k.startswith(f"_{mnemonic}_") & (F.length(k) == len(mnemonic) + 10))
    named = lambda k: head(k) & tail(k).rlike("^[0-9]{8}$")
    own = F.filter(F.map_keys(item), named)
    return F.array_max(F.transform(own, lambda k: F.struct(tail(k).alias("stamp"), k.alias("key"))))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """The named columns, each computed once a row: behind a generator the optimiser doesn't repeat them where they are used."""
    return df.select(F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once")).select("_once.*")


def parse_observations(payloads: DataFrame, payload: str, mnemonic: str) -> DataFrame:
    """Rows (obs_date, value, realtime_start, realtime_end) of API payloads.

    A payload where any observation has a plain `value` is read by these; any other is a wide
    one, where the newest vintage of each row counts, missing or not, and dates both ends. A
    payload with observations but neither fails when it is read.
    """
    bodies = once(payloads, body=F.from_json(F.col(payload), PAYLOAD)["observations"])
    kinds = once(bodies, body=F.col("body"), plain=F.exists("body", lambda o: F.map_contains_key(o, "value")))
    items = F.transform("body", lambda o: F.struct(o.alias("o"), F.when(~F.col("plain"), newest_key(o, mnemonic)).alias("newest")))
    found = once(kinds, plain=F.col("plain"), items=items)
    neither = ~F.col("plain") & (F.size("items") > 0) & ~F.exists("items", lambda x: x["newest"].isNotNull())
    fault = F.when(neither, F.raise_error(F.lit(f"no value columns for {mnemonic}")).cast("string"))
    rows = found.where(fault.isNull()).select("plain", F.explode("items").alias("x")).select("plain", "x.o", "x.newest")
    stamp = F.try_to_date("newest.stamp", "yyyyMMdd")
    pick = lambda name: F.when(F.col("plain"), F.try_element_at("o", F.lit(name)).try_cast("date")).otherwise(stamp).alias(name)
    value = parsed_number(F.when(F.col("plain"), F.try_element_at("o", F.lit("value"))).otherwise(F.try_element_at("o", F.col("newest.key"))))
    return rows.select(F.try_element_at("o", F.lit("date")).try_cast("date").alias("obs_date"), value.alias("value"), pick("realtime_start"), pick("realtime_end")).where("obs_date is not null")


def payload_errors(payloads: DataFrame, payload: str) -> DataFrame:
    """Payloads that report an error; `optional` marks those that only say the series has no such vintage."""
    body = F.from_json(F.col(payload), PAYLOAD)
    rows = payloads.select(body["error_code"].alias("code"), body["error_message"].alias("message")).where("message is not null")
    return rows.withColumn("optional", (F.col("code").isNull() | (F.col("code") == 400)) & F.lower("message").contains("does not exist"))


def source_of(names: DataFrame, column: str, default: str) -> DataFrame:
    """`MNEMONIC__SOURCE` names as distinct (source, mnemonic), in the order first seen."""
    parts = F.split(F.col(column), "__")
    rows = names.select(F.upper(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(default))).alias("source"), F.upper(parts[0]).alias("mnemonic"), "ord")
    return rows.groupBy("source", "mnemonic").agg(F.min("ord").alias("ord"))


def candidate_names(source: str, vintage: str) -> list[str]:
    """File names to try for a source, in order."""
    return [f"{name}{mark}.csv" for mark in (f"_{vintage}", f"_vint={vintage}", "") for name in (source.lower(), source.upper())]
