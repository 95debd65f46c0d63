"""Streams give what the batch operators give."""

from quartermill.operators import ingest
from quartermill.streaming import revisions


def run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted(map(tuple, spark.table(name).collect()), key=str)


def test_latest_revision_and_quarters(spark, tmp_path):
    rows = [("a", "2016-07-01", "2016-10-01", 1.0), ("a", "2016-07-01", "2016-12-01", 3.0), ("b", "2016-10-01", "2017-01-01", 5.0), ("a", "2016-08-01", "2016-09-01", 7.0)]
    schema = "k string, d string, r string, v double"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = run(spark, revisions.latest_revisions(stream, ["k", "d"], "r", "v"), "revised", "complete")
    batch = ingest.latest_revision(spark.createDataFrame(rows, schema), ["k", "d"], "r").select("k", "d", "r", "v")
    assert got == sorted(map(tuple, batch.collect()), key=str)
    typed = stream.withColumn("t", stream.d.cast("timestamp"))
    quarters = run(spark, revisions.quarterly(typed, "t", ["k"], "v"), "quarters", "complete")
    assert quarters == [("a", 8067, 11 / 3), ("b", 8068, 5.0)]
    closed = run(spark, revisions.windowed(typed, "t", "1 day", "1 day", ["k"], "v"), "closed", "append")
    assert sorted((r[0], r[4]) for r in closed) == [("a", 1), ("a", 2)]
