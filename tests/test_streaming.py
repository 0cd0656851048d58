import datetime as dt

from lexmill.operators.index import Index
from lexmill.streaming import ingest


def test_stream_into_index(spark, tmp_path):
    schema = spark.createDataFrame([], "doc_id string, t string").schema
    src, ix = tmp_path / "in", Index(spark, str(tmp_path / "ix"))
    spark.createDataFrame([("a", "1"), ("b", "1")], schema).coalesce(1).write.mode("append").parquet(str(src))
    ingest.stream_into_index(spark, str(src), schema, ix, {"v": 1}, str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([("b", "2"), ("c", "2")], schema).coalesce(1).write.mode("append").parquet(str(src))
    ingest.stream_into_index(spark, str(src), schema, ix, {"v": 1}, str(tmp_path / "cp")).awaitTermination()
    assert {tuple(r) for r in ix.read().select("doc_id", "t").collect()} == {("a", "1"), ("b", "2"), ("c", "2")}


def test_stream_records(spark, tmp_path):
    cols = "tribunal string, tipo_documento string, numero_processo string, numero_sumula string, url_oficial string"
    df = spark.createDataFrame([("TCU", "acordao", "1", None, None), ("ZZ", "acordao", None, None, None)], cols)
    df.write.parquet(str(tmp_path / "in"))
    ingest.stream_records(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "good"), str(tmp_path / "dead"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1 and spark.read.json(str(tmp_path / "dead")).count() == 1


def test_windowed_counts(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 10)
    df = spark.createDataFrame([(t, "a"), (t + dt.timedelta(minutes=5), "a"), (t + dt.timedelta(hours=2), "b")], "ts timestamp, k string")
    assert ingest.windowed_counts(df, "ts", "1 hour", "10 minutes", "5 minutes", ["k"]).count() == 5
    df.write.parquet(str(tmp_path / "s"))
    q = ingest.windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "s")), "ts", "1 hour", "10 minutes", None, ["k"]).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").count() == 2
