from pyspark.sql import functions as F

from babelmill.operators import jobs
from babelmill.streaming import job_log

SF = "/root/testdata/sf0.001"
SCHEMA = "job_id long, event_id long, ts timestamp, type string"


def source(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("type"))
    e.repartition(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    return e, spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))


def run(stream, tmp_path, name):
    q = job_log.append_to(stream, str(tmp_path / name), str(tmp_path / f"{name}-state"))
    q.awaitTermination(120)
    assert q.exception() is None


def test_stream_sequence_equals_batch(spark, tmp_path):
    batch, stream = source(spark, tmp_path)
    run(job_log.sequence(stream), tmp_path, "log")
    got = {(r.event_id, r.seq) for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    assert got == {(r.event_id, r.seq) for r in jobs.sequenced(batch).collect()}


def test_stream_ends_with_terminal_event(spark, tmp_path):
    batch, stream = source(spark, tmp_path)
    run(job_log.open_jobs(stream, ("error",)), tmp_path, "open")
    got = {r.event_id for r in spark.read.parquet(str(tmp_path / "open")).collect()}
    assert got == {r.event_id for r in jobs.until_terminal(jobs.sequenced(batch), ("error",)).collect()}


def test_windows_run(spark, tmp_path):
    _, stream = source(spark, tmp_path)
    run(job_log.progress(stream), tmp_path, "progress")
    run(job_log.debounce(stream, "5 minutes"), tmp_path, "debounce")
    assert spark.read.parquet(str(tmp_path / "progress")).count() > 0


def test_stored_reads_expire(spark, tmp_path):
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    rows = [("a", at(0), "one"), ("a", at(900), None), ("a", at(901), None), ("a", at(1000), "two"), ("a", at(1001), None), ("b", at(5), None)]
    d = spark.createDataFrame(rows, "key string, ts string, payload string").withColumn("ts", F.to_timestamp("ts"))
    d.coalesce(1).write.parquet(str(tmp_path / "ops"))
    run(job_log.stored_reads(spark.readStream.schema(d.schema).parquet(str(tmp_path / "ops"))), tmp_path, "reads")
    got = sorted((r.key, r.at // 1000 % 3600, r.payload) for r in spark.read.parquet(str(tmp_path / "reads")).collect())
    assert got == [("a", 900, "one"), ("a", 901, None), ("a", 1001, "two"), ("b", 5, None)]


def test_serve_leaves_out_cancelled_jobs(spark, tmp_path):
    log = spark.createDataFrame([(1, 1, "{}"), (1, 2, '{"a":1}'), (2, 1, "{}"), (3, 1, "{}"), (4, 1, "{}")], "job_id long, seq long, payload string")
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    spark.createDataFrame([(1, "running", None), (2, "cancelled", None), (3, "error", "bad")], "job_id long, status string, error string").write.parquet(str(tmp_path / "jobs"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    start = lambda: job_log.serve(stream, str(tmp_path / "jobs"), str(tmp_path / "lines"), str(tmp_path / "state"), once=True)
    waits, ends = [], iter([False, False, True])
    assert job_log.until_ended(start, lambda: next(ends), sleep=waits.append) == 2 and waits == [3.0, 6.0]
    got = {(r.job_id, r.seq, r.line) for r in spark.read.parquet(str(tmp_path / "lines")).collect()}
    assert got == {(1, 1, "data: {}\n\n"), (1, 2, 'data: {"a":1}\n\n'), (1, None, ": keep-alive\n\n"), (3, 1, "data: {}\n\n"), (3, None, 'data: {"type":"error","detail":"bad"}\n\n')}
