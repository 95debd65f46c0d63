"""Local source files to one table of levels, with what a model requires of them; fixtures and reports as DataFrames."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.quarters import parse_quarter, quarter_label
from ..operators.ingest import CoverageError, merge_series
from .vintages import candidate_names


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def candidate_paths(root: str, vintage: str, data_id: int | None = None) -> list[str]:
    """Where observables may be, in order: under `data`, then in the root."""
    names = [f"data_{vintage}.csv", f"data_vint={vintage}.csv"] + ([f"data_dsid={data_id:02d}_vint={vintage}.csv"] if data_id is not None else [])
    return [f"{folder}/{n}" for folder in (f"{root}/data", root) for n in names]


def first_of(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first path that is there; none is an error that names them."""
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"none of {list(paths)}")


def header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).limit(1).collect()
    return [c.strip() for c in first[0][0].split(",")] if first else []


def read_wide(spark: SparkSession, path: str) -> DataFrame:
    """A wide CSV file: its date as quarter_idx, every other column a number (null for what isn't one)."""
    names = header(spark, path)
    if "date" not in names:
        raise CoverageError(f"{path}: no date column")
    raw = spark.read.csv(path, header=True, schema=StructType([StructField(n, StringType()) for n in names]))
    number = lambda n: F.nanvl(F.col(f"`{n}`").try_cast("double"), F.lit(None).cast("double")).alias(n)
    return raw.select(parse_quarter("date").alias("quarter_idx"), *[number(n) for n in names if n != "date"]).where("quarter_idx is not null")


def read_observables(spark: SparkSession, paths: Sequence[str], check_empty: bool = True) -> DataFrame:
    """Observables from the first path that is there; a column without any value is an error."""
    df = read_wide(spark, first_of(spark, paths))
    names = [c for c in df.columns if c != "quarter_idx"]
    if check_empty and names:
        counts = df.agg(*[F.count(f"`{c}`").alias(c) for c in names]).first()
        if empty := [c for c in names if not counts[c]]:
            raise CoverageError(f"columns without values: {empty}")
    return df


def requirements(names: DataFrame, optional: Sequence[str], default: str = "FRED") -> DataFrame:
    """Per source, the mnemonics (in the order first seen) that names `MNEMONIC__SOURCE` ask of it, and those of them that may be absent."""
    parts = F.split("name", "__")
    rows = names.select(F.upper(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(default))).alias("source"), F.upper(parts[0]).alias("mnemonic"), "ord")
    once = rows.groupBy("source", "mnemonic").agg(F.min("ord").alias("ord"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "mnemonic"))), lambda x: x["mnemonic"])
    out = once.groupBy("source").agg(listed.alias("mnemonics"), F.min("ord").alias("ord"))
    return out.withColumn("optional", F.filter("mnemonics", lambda m: m.isin(*optional) if optional else F.lit(False)))


def located(spark: SparkSession, needs: DataFrame, root: str, vintage: str) -> DataFrame:
    """requirements with the candidate files of each source and the one that is there; a few rows, one a source."""
    rows = []
    for r in needs.collect():
        paths = [f"{root}/{n}" for n in candidate_names(r.source, vintage)]
        rows.append((r.source, paths, next((p for p in paths if exists(spark, p)), None)))
    return needs.join(spark.createDataFrame(rows, "source string, candidates array<string>, path string"), "source")


def required_quarters(df: DataFrame, first: int, last: int) -> DataFrame:
    """Rows of the required quarters."""
    if last < first:
        raise ValueError("the last required quarter comes before the first")
    return df.where(F.col("quarter_idx").between(first, last))


def faults(source: DataFrame, name: str, mnemonics: Sequence[str], optional: Sequence[str], first: int, last: int) -> DataFrame:
    """What a wide source lacks: (source, fault, what). Repeated quarters, required quarters that aren't there, and quarters without a finite value of a required series."""
    grid = source.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("quarter_idx"))
    here = source.groupBy("quarter_idx").agg(F.count(F.lit(1)).alias("n"), *[F.max(F.when(F.abs(F.col(f"`{m}`")) < float("inf"), 1)).alias(f"has_{m}") for m in mnemonics if m in source.columns and m not in optional])
    label = quarter_label("quarter_idx")
    out = here.where("n > 1").select(F.lit("repeated quarter").alias("fault"), label.alias("what"))
    wanted = grid.join(here, "quarter_idx", "left")
    out = out.unionByName(wanted.where("n is null").select(F.lit("missing quarter").alias("fault"), label.alias("what")))
    for m in mnemonics:
        if m in optional:
            continue
        if m not in source.columns:
            out = out.unionByName(source.sparkSession.range(1).select(F.lit("missing column").alias("fault"), F.lit(m).alias("what")))
        else:
            out = out.unionByName(wanted.where(F.col("n").isNotNull() & F.col(f"has_{m}").isNull()).select(F.lit("missing value").alias("fault"), F.concat(F.lit(f"{m} "), label).alias("what")))
    return out.select(F.lit(name).alias("source"), "fault", "what")


def levels_from_sources(sources: dict[str, tuple[DataFrame, Sequence[str]]], optional: Sequence[str] = (), quarters: tuple[int, int] | None = None) -> DataFrame:
    """One wide table of the mnemonics asked of each source, merged on the quarter, ordered and filtered to the required quarters.

    A source that lacks something required raises with all that is missing; an optional series that isn't there is null.
    """
    series: dict[str, DataFrame] = {}
    for name, (df, mnemonics) in sources.items():
        if quarters and (found := faults(df, name, mnemonics, optional, *quarters).limit(20).collect()):
            raise CoverageError("; ".join(f"{r.source}: {r.fault} {r.what}" for r in found))
        if lacking := [m for m in mnemonics if m not in df.columns and m not in optional]:
            raise CoverageError(f"{name}: missing columns {lacking}")
        for m in mnemonics:
            series[m] = df.select("quarter_idx", (F.col(f"`{m}`") if m in df.columns else F.lit(None).cast("double")).alias("value"))
    merged = merge_series(series)
    return (required_quarters(merged, *quarters) if quarters else merged).orderBy("quarter_idx")


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Arrays of CSV, NPY and NPZ files as cells; a CSV file with anything but numbers is left out."""
    columns = ["array", "i", "j", "value"]
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            stem, _, kind = path.rpartition(".")
            if kind == "csv":
                try:
                    found = {stem: np.loadtxt(io.BytesIO(content), delimiter=",", ndmin=2)}
                except ValueError:
                    continue
            else:
                loaded = np.load(io.BytesIO(content), allow_pickle=False)
                found = {stem: loaded} if kind == "npy" else {f"{stem}/{k}": loaded[k] for k in loaded.files}
            for name, array in found.items():
                if np.issubdtype(array.dtype, np.number) or array.dtype == bool:
                    flat = np.atleast_2d(array.astype(float)).reshape(len(np.atleast_2d(array)), -1)
                    i, j = np.indices(flat.shape)
                    out.append(pd.DataFrame({"array": name, "i": i.ravel(), "j": j.ravel(), "value": flat.ravel()}))
        yield pd.concat(out) if out else pd.DataFrame([], columns=columns)


def read_fixtures(spark: SparkSession, folder: str) -> DataFrame:
    """All arrays under a folder as (array, i, j, value), named by their path (and key); two files of one name fail the query."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.col("path").rlike(r"\.(csv|npy|npz)$"))
    here = files.select(F.regexp_replace("path", "^.*?" + folder.replace("file:", "").rstrip("/").replace(".", r"\.") + "/", "").alias("path"), "content")
    cells = here.mapInPandas(_cells, "array string, i long, j long, value double")
    again = F.count(F.lit(1)).over(Window.partitionBy("array", "i", "j")) > 1
    fault = F.when(again, F.raise_error(F.concat(F.lit("two files of one name: "), F.col("array"))).cast("string"))
    return cells.withColumn("_f", fault).where("_f is null").drop("_f")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of a manifest's arrays: (array, ord, label)."""
    raw = spark.read.schema("labels map<string,array<string>>").json(path, multiLine=True)
    return raw.select(F.explode("labels").alias("array", "labels")).select("array", F.posexplode("labels").alias("ord", "label"))


REPORT = """machine string, command map<string,string>, results array<struct<kernel:string,backend:string,device:string,horizon:int,repeats:int,
dtype:string,elapsed_seconds:double,skipped:boolean,available:boolean,reason:string>>"""


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark reports, one row a file; a result without its kernel, backend or device fails the query."""
    df = spark.read.schema(REPORT).json(path, multiLine=True).withColumn("machine", F.coalesce("machine", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)))
    broken = F.exists("results", lambda r: r["kernel"].isNull() | r["backend"].isNull() | r["device"].isNull())
    return df.withColumn("_f", F.when(broken, F.raise_error(F.concat(F.lit("broken report: "), F.col("machine"))).cast("string"))).where("_f is null").drop("_f")


def matrix_cells(df: DataFrame, name: str, columns: Sequence[str], row: str) -> DataFrame:
    """A wide matrix as cells (array, i, j, value)."""
    values = F.posexplode(F.array(*[F.col(c).cast(DoubleType()) for c in columns])).alias("j", "value")
    return df.select(F.lit(name).alias("array"), F.col(row).alias("i"), values)
