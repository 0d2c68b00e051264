"""Streams with state: late rows, restarts from a checkpoint, and the batch twins."""

from pyspark.sql import functions as F

from lexitide.streaming import sessions as S

EVENTS = "t string, user string, value double"


def at(rows, spark, schema=EVENTS):
    return spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("t")).drop("t")


def ran(stream, name, mode, checkpoint, spark):
    """All rows so far of a stream into a table of files."""
    out = f"{checkpoint}-out"
    if mode == "append":
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    else:
        stream.writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/b={i}")).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def test_sessions(spark, tmp_path):
    first = [("2024-01-01 00:00:00", "a", 1.0), ("2024-01-01 00:20:00", "a", 2.0), ("2024-01-01 02:00:00", "a", 4.0), ("2024-01-01 00:10:00", "b", 8.0), (None, "b", 9.0)]
    second = [("2024-01-01 02:20:00", "a", 16.0), ("2024-01-01 00:25:00", "a", 32.0), ("2024-01-02 00:00:00", "c", 64.0)]  # the second is far too late
    src, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    batch = {(r.user, str(r.start), r.n, r.total) for r in S.sessions(at(first, spark), ["user"]).collect()}
    assert batch == {("a", "2024-01-01 00:00:00", 2, 3.0), ("a", "2024-01-01 02:00:00", 1, 4.0), ("b", "2024-01-01 00:10:00", 1, 8.0)}
    schema = at(first, spark).schema
    stream = lambda: S.sessions(spark.readStream.schema(schema).parquet(src), ["user"])
    at(first, spark).coalesce(1).write.parquet(src)
    ran(stream(), "s", "append", ck, spark)
    at(second, spark).coalesce(1).write.mode("append").parquet(src)
    ran(stream(), "s", "append", ck, spark)  # a restart: the session of 02:00 goes on
    at([("2024-01-03 00:00:00", "d", 0.0)], spark).write.mode("append").parquet(src)
    got = {(r.user, str(r.start), r.n, r.total) for r in ran(stream(), "s", "append", ck, spark).collect()}
    assert got == {("a", "2024-01-01 00:00:00", 2, 3.0), ("b", "2024-01-01 00:10:00", 1, 8.0), ("a", "2024-01-01 02:00:00", 2, 20.0), ("c", "2024-01-02 00:00:00", 1, 64.0)}


def test_rows_that_come_twice(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "a", 1.0), ("2024-01-01 00:05:00", "b", 2.0)]
    again = [("2024-01-01 00:10:00", "a", 3.0), ("2024-01-01 00:06:00", "c", 4.0)]
    src, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    schema = at(rows, spark).schema
    stream = lambda: S.once(spark.readStream.schema(schema).parquet(src), ["user"])
    for part in (rows, again):
        at(part, spark).coalesce(1).write.mode("append").parquet(src)
        got = ran(stream(), "o", "append", ck, spark)
    want = {("a", 1.0), ("b", 2.0), ("c", 4.0)}
    assert {(r.user, r.value) for r in got.collect()} == want == {(r.user, r.value) for r in S.once(at(rows + again, spark), ["user"]).collect()}


def test_running_scores(spark, tmp_path):
    schema = "t string, _id string, score double, weight double"
    first = [("2024-01-01 00:00:00", "x", 1.0, 1.0), ("2024-01-01 00:01:00", "x", 4.0, 2.0), ("2024-01-01 00:01:00", "y", 5.0, 1.0), ("2024-01-01 00:02:00", "y", None, 1.0)]
    second = [("2024-01-01 00:03:00", "x", 0.0, 6.0), ("2024-01-01 00:03:00", None, 0.0, 6.0)]
    src, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    frame = at(first, spark, schema)
    stream = lambda: S.running_scores(spark.readStream.schema(frame.schema).parquet(src))
    for part in (first, second):  # the second run starts from the first's checkpoint
        at(part, spark, schema).coalesce(1).write.mode("append").parquet(src)
        got = ran(stream(), "r", "update", ck, spark)
    assert {(r._id, r.n, r.mean) for r in got.collect()} == {("x", 2, 3.0), ("y", 1, 5.0), ("x", 3, 1.0)}
    twin = {(r._id, r.n, r.weight, r["mean"]) for r in S.running_scores(at(first + second, spark, schema)).collect()}
    assert twin == {("x", 3, 9.0, 1.0), ("y", 1, 1.0, 5.0)}
