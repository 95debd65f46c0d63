"""Archives of modes and sampler runs: a table as Parquet with its metadata as JSON beside it; manifests of fixtures."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that each kind of archive must hold.
KINDS = {"mode": ("parameter", "value"), "sampler": ("chain", "draw", "parameter", "value"), "trace": ("chain", "draw", "logpost", "accepted"), "shocks": ("draw", "h", "shock", "value")}


def write_archive(df: DataFrame, path: str, kind: str, **metadata) -> None:
    """df under path/data, and its kind and metadata under path/meta."""
    if lacking := [c for c in KINDS[kind] if c not in df.columns]:
        raise ValueError(f"a {kind} archive needs columns {lacking}")
    df.write.mode("overwrite").parquet(f"{path}/data")
    df.sparkSession.createDataFrame([(json.dumps({"kind": kind, **metadata}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_archive(spark: SparkSession, path: str, kind: str, needed: Sequence[str] = ()) -> tuple[DataFrame, dict]:
    """The table and its metadata; another kind, or metadata or columns that aren't there, raise."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if meta.get("kind") != kind:
        raise ValueError(f"{path} is a {meta.get('kind')} archive, not a {kind} one")
    if lacking := [n for n in needed if n not in meta]:
        raise ValueError(f"{path} lacks metadata {lacking}")
    df = spark.read.parquet(f"{path}/data")
    if lacking := [c for c in KINDS[kind] if c not in df.columns]:
        raise ValueError(f"{path} lacks columns {lacking}")
    return df, meta


def scalar(text, kind: str):
    """A metadata text as a number or truth value; null for what isn't one."""
    c = F.col(text) if isinstance(text, str) else text
    if kind == "boolean":
        return F.when(F.lower(c).isin("true", "1", "1.0", "yes"), True).when(F.lower(c).isin("false", "0", "0.0", "no"), False)
    return c.try_cast("double").try_cast(kind) if kind in ("int", "bigint") else c.try_cast(kind)


def trace_faults(trace: DataFrame) -> DataFrame:
    """Per chain: draws without a log posterior or a verdict, draws that repeat, and gaps in their numbering."""
    per = trace.groupBy("chain", "draw").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("logpost").isNull() | F.isnan("logpost") | F.col("accepted").isNull()).alias("bad"))
    out = per.groupBy("chain").agg(F.sum(F.col("bad").cast("long")).alias("bad"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("repeated"), (F.max("draw") - F.min("draw") + 1 - F.count(F.lit(1))).cast("long").alias("gaps"))
    return out.where("bad > 0 or repeated > 0 or gaps > 0")


def merged_labels(old: DataFrame, new: DataFrame) -> DataFrame:
    """Labels (array, ord, label) of a manifest with those of another laid over them: an array of the new ones replaces the old one's labels whole."""
    return new.unionByName(old.join(new.select("array").distinct(), "array", "left_anti"))


def write_manifest(labels: DataFrame, path: str, **facts) -> None:
    """A manifest as one JSON line: facts, and labels by array."""
    rows = labels.groupBy("array").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "label"))), lambda x: x["label"]).alias("labels"))
    one = rows.agg(F.map_from_entries(F.collect_list(F.struct("array", "labels"))).alias("labels"))
    one.select("labels", *[F.lit(v).alias(k) for k, v in facts.items()]).coalesce(1).write.mode("overwrite").json(path)
