import datetime as dt

from pyspark.sql import functions as F

from tessella.operators.refine import consecutive
from tessella.streaming.cadence import cadence, votes_in_a_row


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_cadence_drops_late_rows_and_closes_periods(spark, tmp_path):
    schema = "ts timestamp, value double"
    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    path = f"{tmp_path}/in"
    write(spark, path, [(t(0, 5), 1.0), (t(0, 50), 2.0), (t(1, 10), 4.0)], schema)
    stream = spark.readStream.schema(schema).parquet(path)
    out = cadence(stream, "ts", "1 hour", F.sum("value").alias("total"), late="10 minutes")
    q = out.writeStream.outputMode("append").format("memory").queryName("cadence_out").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
        write(spark, path, [(t(3), 8.0)], schema)
        q.processAllAvailable()
        write(spark, path, [(t(0, 30), 100.0), (t(5), 1.0)], schema)
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.start.hour, r.total) for r in spark.table("cadence_out").collect()}
    assert got >= {(0, 3.0), (1, 4.0), (3, 8.0)} and all(total < 100 for _, total in got)


def test_votes_as_state_equal_votes_in_batch(spark, tmp_path):
    schema = "block long, cycle long, tag int"
    rows = [(b, c, -1 if (c * 7 + b) % 5 else (c + b) % 3 - 1) for b in range(3) for c in range(20)]
    path = f"{tmp_path}/in"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path) if write(spark, path, [r for r in rows if r[1] < 9], schema) is None else None
    q = votes_in_a_row(stream, "block", "cycle", "tag", 3).writeStream.outputMode("append").format("memory").queryName("votes_out").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
        write(spark, path, [r for r in rows if r[1] >= 9], schema)
        q.processAllAvailable()
    finally:
        q.stop()
    batch = consecutive(spark.createDataFrame(rows, schema), "block", "cycle", "tag", 3)
    assert {(r.block, r.cycle, r.act) for r in spark.table("votes_out").collect()} == {(r.block, r.cycle, r.act) for r in batch.collect()}
