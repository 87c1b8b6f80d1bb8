"""Windowed sums give the same rows on a stream as on a table, but for rows that come too late."""

from datetime import datetime, timedelta

from plainfold.streaming.events import hourly

SCHEMA = "event_id long, ts timestamp_ntz, event_type string, value double"


def rows(first, hours):
    at = datetime(2024, 1, 1)
    return [(first + i, at + timedelta(minutes=7 * (first + i)), "ab"[i % 2] if i % 5 else None, None if i % 9 == 0 else float(i)) for i in range(hours * 60 // 7)]


def summed(found):
    return {(str(r.hour), r.event_type): (r.n, r.total) for r in found}


def test_stream_equals_batch(spark, tmp_path):
    whole = spark.createDataFrame(rows(0, 12), SCHEMA)
    for i, part in enumerate((whole.where("event_id < 40"), whole.where("event_id >= 40"))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = (
            hourly(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("hours").outputMode("complete")
            .option("checkpointLocation", f"{tmp_path}/state{i}").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    assert summed(spark.table("hours").collect()) == summed(hourly(whole).collect())


def test_late_rows_are_left_out(spark, tmp_path):
    def drain():
        query = (
            hourly(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")).writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        )
        query.awaitTermination()

    spark.createDataFrame(rows(0, 12), SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    drain()
    spark.createDataFrame([(999, datetime(2024, 1, 1), "a", 1000.0)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    drain()
    batch = summed(hourly(spark.createDataFrame(rows(0, 12), SCHEMA)).collect())
    stream = summed(spark.read.parquet(f"{tmp_path}/out").collect())
    assert stream and set(stream) < set(batch) and all(batch[k] == v for k, v in stream.items())
