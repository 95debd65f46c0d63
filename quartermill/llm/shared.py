"""Small helpers that every training-data operator shares."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch: bounds what a Python worker holds at once.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a test-only default."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and bytes unless the session already says otherwise."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        try:
            if spark.conf.get(key, None) is None:
                spark.conf.set(key, value)
        except Exception as e:  # a Spark without the byte bound keeps the row bound
            if "CANNOT_MODIFY" not in str(e) and "NoSuchElement" not in str(e):
                raise


class Cut:
    """A table written to the shared folder: ends the lineage, survives lost executors."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path = spark, path
        self.df = spark.read.schema(schema).parquet(path)  # given, so no job looks for it

    def drop(self) -> None:
        """Deletes the files; only after everything that reads them has been written."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def cut(df: DataFrame, tag: str) -> Cut:
    """Writes df as Parquet in the shared folder and reads it back."""
    path = fresh_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return Cut(df.sparkSession, path, df.schema)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns (case-insensitive as Spark resolves them); extra columns never clash further down."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def keyed(docs: DataFrame, carry: bool = False) -> tuple[DataFrame, bool]:
    """docs as (rid, doc_id, text) and whether rows were numbered: rid is unique per row and sorts as doc_id does.

    rid is doc_id itself when doc_ids are distinct and not null (checked by a count over
    the id column alone). Otherwise rows are numbered in the order of doc_id (null last),
    then the text's hash, and the numbering is written out so that retries agree. With
    carry, the struct `others` holds all columns but text, so that no names clash.
    """
    base = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if carry:
        base.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]).alias("others"))
    base = docs.select(*base)
    repeated = base.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if not repeated:
        return base.withColumn("rid", F.col("doc_id")), False
    order = base.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), "text")
    return cut(order.withColumn("rid", F.monotonically_increasing_id()), "keyed").df, True


def restored(rows: DataFrame, names: list[str]) -> DataFrame:
    """The columns called names, in that order, from `others` and `text`."""
    return rows.select(*[F.col("text").alias(n) if n.lower() == "text" else F.col(f"others.`{n}`").alias(n) for n in names])


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes empty."""
    column = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def strings(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that have rows."""
    return (b for b in source if b.num_rows)


def part_rows(spark: SparkSession) -> int:
    """Shuffle partitions of this session."""
    return int(re.sub(r"\D", "", spark.conf.get("spark.sql.shuffle.partitions")) or 200)
