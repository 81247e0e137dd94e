from pyspark.sql import functions as F

from tamarack.operators import features
from tamarack.operators.query import parse
from tamarack.streaming import events, profiles


def test_hourly_counts_stream_as_they_batch(spark, tmp_path):
    rows = [(f"2024-01-01 {h:02d}:{m:02d}:00", kind, float(h + m)) for h in range(4) for m in (0, 30) for kind in ("a", "b")]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = events.hourly_counts(events.read(spark, str(tmp_path / "in"), df.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("hours").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("hours").collect()) == sorted(events.hourly_counts(df).collect())


def test_profiles_stream(spark, tmp_path):
    df = spark.createDataFrame([("A", ["Python"], "built python search"), ("B", [], "none")], "candidate_id string, skills array<string>, career_history string")
    fp = features.fingerprints(df)
    fp.write.parquet(str(tmp_path / "fp"))
    stream = spark.readStream.schema(fp.schema).parquet(str(tmp_path / "fp"))
    got = []
    q = profiles.ranked_batches(profiles.light_scores(stream, parse("Need Python")), 1, lambda b, n: got.extend(b.collect())).start()
    q.processAllAvailable()
    q.stop()
    assert [r.candidate_id for r in got] == ["A"]


def test_raw_records_stream_as_they_batch(spark, tmp_path):
    df = spark.createDataFrame([("A", ["Python"], "built python search"), (None, ["SQL"], "none")], "candidate_id string, skills array<string>, career_history string")
    df.write.parquet(str(tmp_path / "raw"))
    stream = features.fingerprints(spark.readStream.schema(df.schema).parquet(str(tmp_path / "raw")))
    q = stream.writeStream.format("memory").queryName("prints").start()
    q.processAllAvailable()
    q.stop()
    got = {r.claimed_skills[0]: r for r in spark.table("prints").collect()}
    batch = {r.claimed_skills[0]: r for r in features.fingerprints(df).collect()}
    assert got["Python"] == batch["Python"]
    assert got["SQL"].candidate_id.startswith("GENERATED_") and got["SQL"].asDict() | {"candidate_id": 0} == batch["SQL"].asDict() | {"candidate_id": 0}
