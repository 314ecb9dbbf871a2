"""Streams in available-now mode against the same query in batch."""

import pytest
from pyspark.sql import functions as F

from tessitura.operators import samples as S
from tessitura.streaming import operators as O

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("events"))
    df = spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", "user_id", "event_id")
    df.orderBy("ts").coalesce(1).write.mode("append").parquet(folder)
    return folder, df


def _drain(stream, name, mode, folder):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", folder).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_windows_equal_batch(spark, events, tmp_path):
    folder, df = events
    stream = spark.readStream.schema(df.schema).parquet(folder)
    got = {tuple(r) for r in _drain(O.windowed_rate(stream, "6 hours"), "w", "complete", str(tmp_path)).select("start", "event_type", "count").collect()}
    want = {tuple(r) for r in df.groupBy(F.window("ts", "6 hours").start.alias("s"), "event_type").count().collect()}
    assert got == want


def test_forgetting_equals_closed_form(spark, tmp_path):
    rows = [("k", n, 1 + n % 3) for n in range(20)]
    df = spark.createDataFrame(rows, "signal_id string, n long, obs int")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = _drain(O.forgetting_stream(stream, 3, 1.0, 5.0), "f", "update", str(tmp_path / "c")).collect()[-1]["p"]
    want = [r["p"] for r in S.forgetting(df, 3, 1.0, 5.0).orderBy("state").collect()]
    assert max(abs(a - b) for a, b in zip(got, want, strict=True)) < 1e-9


def test_sessions(spark, events, tmp_path):
    folder, df = events
    stream = spark.readStream.schema(df.schema).parquet(folder)
    got = _drain(O.event_sessions(stream, 10.0, "2 hours"), "s", "append", str(tmp_path))
    assert got.filter("end <= start").count() == 0
