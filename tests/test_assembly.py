"""Streams that keep what was cut, go on from an offset, and join starts with calls."""

import random

import pytest
from pyspark.sql import functions as F

from babelmill.streaming import assembly, job_log, log_source

CHUNK = "connection string, chunk long, bytes binary, last boolean"
TEXT = ': keep-alive\n\ndata: {"a": "é中"}\r\n\nevent: x\ndata: {"b": [1, 2]}\n\ndata: tail é'.encode()
REPLY = '[{"a": "} \\" é"}, {"b": {"c": 1}}, {"d": "'.encode()


def cut(data, places):
    edges = [0, *sorted(places), len(data)]
    return [data[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def run(spark, tmp_path, batches, kind):
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, CHUNK).coalesce(1).write.mode("append").parquet(str(folder))
        kept = spark.conf.get(assembly.STATE_STORE[0], None)
        spark.conf.set(*assembly.STATE_STORE)
        try:
            stream = spark.readStream.schema(CHUNK).parquet(str(folder))
            q = job_log.append_to(assembly.assembled(stream, kind), str(tmp_path / "out"), str(tmp_path / "state"))
            q.awaitTermination(120)
            assert q.exception() is None, i
        finally:
            spark.conf.unset(assembly.STATE_STORE[0]) if kept is None else spark.conf.set(assembly.STATE_STORE[0], kept)
    out = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("connection", "nth").collect():
        out.setdefault(r.connection, []).append((r.nth, r.payload))
    return out


def test_chunks_cut_anywhere_give_whole_lines(spark, tmp_path):
    """One connection a place of the cut, in two batches, the second part of some first."""
    first, second = [], []
    for place in range(len(TEXT) + 1):
        a, b = cut(TEXT, [place])
        one, two = (f"c{place}", 0, a, False), (f"c{place}", 1, b, True)
        early = place % 3 == 0
        first.append(two if early else one)
        second.append(one if early else two)
    r = random.Random(1)
    many = [("bytes", i, bytes([x]), i == len(TEXT) - 1) for i, x in enumerate(TEXT)]
    r.shuffle(many)
    got = run(spark, tmp_path, [first + many[:40], second + many[30:]], "lines")
    want = [(0, '{"a": "é中"}'), (1, '{"b": [1, 2]}'), (2, "tail é")]
    assert len(got) == len(TEXT) + 2 and all(v == want for v in got.values())


def test_objects_of_a_reply_that_is_being_written(spark, tmp_path):
    batches = [[], [], []]
    for place in range(1, len(REPLY)):
        a, b = cut(REPLY, [place])
        for n, (batch, part) in enumerate(zip(batches, (a, b, b'x"}]'), strict=True)):
            batch.append((f"c{place}", n, part, n == 2))
    got = run(spark, tmp_path, batches, "objects")
    want = [(0, '{"a": "} \\" é"}'), (1, '{"b": {"c": 1}}'), (2, '{"d": "x"}')]
    assert len(got) == len(REPLY) - 1 and all(v == want for v in got.values())


@pytest.fixture
def log(spark, tmp_path):
    def append(job, numbers):
        rows = [(job, n, f'{{"n": {n}}}') for n in numbers] + [(99, n, "other") for n in numbers]
        spark.createDataFrame(rows, log_source.SCHEMA).repartition(2).write.mode("append").parquet(str(tmp_path / "log"))

    spark.dataSource.register(log_source.JobLog)
    return append


def view(spark, tmp_path, name, after=0):
    stream = spark.readStream.format("job_log").option("path", str(tmp_path / "log")).option("job", 7).option("from", after).load()
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(once=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    rows = spark.read.schema(log_source.SCHEMA).parquet(str(tmp_path / name)).collect()
    return sorted((r.job_id, r.seq, r.payload) for r in rows)


def test_viewer_goes_on_from_its_offset(spark, tmp_path, log):
    want = lambda *numbers: [(7, n, f'{{"n": {n}}}') for n in numbers]
    log(7, range(1, 6))
    assert view(spark, tmp_path, "a") == want(*range(1, 6))
    log(7, range(6, 9))
    # A restart serves what is new, once; another viewer replays from any number.
    assert view(spark, tmp_path, "a") == want(*range(1, 9))
    assert view(spark, tmp_path, "a") == want(*range(1, 9))
    assert view(spark, tmp_path, "b", 6) == want(7, 8)
    # A number is missing: what follows it waits until it is there.
    log(7, [10, 11])
    assert view(spark, tmp_path, "a") == want(*range(1, 9))
    log(7, [9])
    assert view(spark, tmp_path, "a") == want(*range(1, 12))
    assert view(spark, tmp_path, "b") == want(*range(7, 12))


def test_starts_and_calls_join_as_streams(spark, tmp_path):
    at = lambda m: f"2024-01-01 00:{m:02d}:00"
    starts = [("r1", "a", at(0), "q1"), ("r1", "b", at(1), "q2"), ("r2", "a", at(1), "q3"), ("r2", "c", at(2), "q4"), ("r3", "z", at(59), "end")]
    calls = [("r1", "a", at(5), "found"), ("r2", "a", at(12), "too late"), ("r1", "b", at(0), "too early"), ("r2", "c", at(12), "just"), ("r9", "a", at(3), "nobody"), ("r3", "none", at(59), "x")]
    frame = lambda rows, last: spark.createDataFrame(rows, f"run string, id string, ts string, {last} string").withColumn("ts", F.to_timestamp("ts"))
    s, c = frame(starts, "args"), frame(calls, "content")
    batch = sorted(tuple(str(v) for v in r) for r in job_log.answered_starts(s, c).collect())
    assert [r[4][-8:] for r in batch if r[4] != "None"] == ["00:05:00", "00:12:00"]
    streams = []
    for name, df in (("s", s), ("c", c)):
        df.where(F.col("run") != "r3").coalesce(1).write.parquet(str(tmp_path / name))
        df.where(F.col("run") == "r3").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        streams.append(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)))
    for _ in range(2):  # the watermark of one batch lets the next one give up on starts
        q = job_log.append_to(job_log.answered_starts(*streams), str(tmp_path / "out"), str(tmp_path / "state"))
        q.awaitTermination(120)
        assert q.exception() is None
    got = sorted(tuple(str(v) for v in r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # The last start is still open: its call could yet come.
    assert got == [r for r in batch if r[0] != "r3"]
    late = frame([("r1", "b", at(3), "late call")], "content")
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "c"))
    job_log.append_to(job_log.answered_starts(*streams), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert sorted(tuple(str(v) for v in r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == got
