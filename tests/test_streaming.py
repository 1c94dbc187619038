from pyspark.sql import functions as F

from millrace.streaming.pipelines import run_available, windowed_counts


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    src = spark.read.parquet(f"{sf_dir}/events.parquet")
    src.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    run_available(stream, lambda b: b.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r.event_type: r.n for r in spark.read.parquet(str(tmp_path / "out")).groupBy("event_type").agg(F.sum("n").alias("n")).collect()}
    assert got == {r.event_type: r["count"] for r in src.groupBy("event_type").count().collect()}
    assert windowed_counts(stream).isStreaming
