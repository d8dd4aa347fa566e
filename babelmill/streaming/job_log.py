"""The job log as a stream: dense sequence numbers, replay, terminal states, debouncing, stored files with a time to live."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from babelmill.operators.dialogue import served
from babelmill.operators.jobs import TERMINAL

LOG = "job_id long, event_id long, ts timestamp, type string, seq long"


def sequence(events: DataFrame) -> DataFrame:
    """events(job_id, event_id, ts, type) -> LOG: each job counts its events from 1, in order within a batch; state is one number."""

    def number(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq = state.get[0] if state.exists else 0
        held = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        held["seq"] = range(seq + 1, seq + 1 + len(held))
        state.update((seq + len(held),))
        yield held[["job_id", "event_id", "ts", "type", "seq"]]

    return events.groupBy("job_id").applyInPandasWithState(number, LOG, "seq long", "append", GroupStateTimeout.NoTimeout)


def open_jobs(events: DataFrame, types: tuple[str, ...] = TERMINAL) -> DataFrame:
    """LOG without what comes after a job's terminal event; a job's state is its number and whether it ended."""

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, ended = state.get if state.exists else (0, False)
        held = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        stop = held.type.isin(types).to_numpy()
        n = 0 if ended else int(stop.argmax()) + 1 if stop.any() else len(held)
        held = held.iloc[:n].copy()
        held["seq"] = range(seq + 1, seq + 1 + len(held))
        state.update((seq + len(held), bool(ended or stop.any())))
        yield held[["job_id", "event_id", "ts", "type", "seq"]]

    return events.groupBy("job_id").applyInPandasWithState(follow, LOG, "seq long, ended boolean", "append", GroupStateTimeout.NoTimeout)


def debounce(events: DataFrame, gap: str = "500 milliseconds", late: str = "10 minutes") -> DataFrame:
    """The last event of each run of events less than `gap` apart."""
    e = events.withWatermark("ts", late)
    run = e.groupBy("job_id", F.session_window("ts", gap)).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return run.select("job_id", "event_id", F.col("session_window.end").alias("settled_at"))


def progress(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events of each type in tumbling windows, late ones within the watermark counted."""
    e = events.withWatermark("ts", late)
    return e.groupBy(F.window("ts", window), "type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "type", "n")


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything there is, once, exactly once across restarts from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


READS = "key string, at long, payload string"


def stored_reads(ops: DataFrame, ttl_seconds: int = 900, late: str = "10 minutes") -> DataFrame:
    """READS of the reads in ops(key, ts, payload): a row with a payload stores it, one without reads what is stored.

    A payload older than ttl_seconds is gone (null); its state goes when the watermark passes that age.
    """
    ttl = ttl_seconds * 1000

    def read(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = pd.concat(list(frames)).sort_values("at", kind="stable")
        payload, created = state.get if state.exists else (None, 0)
        out = []
        for at, given in zip(held["at"], held["payload"], strict=True):
            if pd.notna(given):
                payload, created = given, int(at)
            else:
                out.append((key[0], int(at), payload if payload is not None and at - created <= ttl else None))
        if payload is not None and created + ttl > state.getCurrentWatermarkMs():
            state.update((payload, created))
            state.setTimeoutTimestamp(created + ttl + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "at", "payload"])

    held = ops.withWatermark("ts", late).select("key", "ts", F.unix_millis("ts").alias("at"), "payload")
    return held.groupBy("key").applyInPandasWithState(read, READS, "payload string, created long", "append", GroupStateTimeout.EventTimeTimeout)


def serve(log: DataFrame, jobs_path: str, out: str, checkpoint: str, every: str = "500 milliseconds", once: bool = False) -> StreamingQuery:
    """Lines for viewers (see dialogue.served) of a streaming log(job_id, seq, payload), polled for `every` so often.

    jobs(job_id, status, error) is read anew for each batch, so a job cancelled in between sends nothing more. A batch
    done again after a failure replaces its own folder of `out`.
    """

    def send(batch: DataFrame, batch_id: int) -> None:
        jobs = batch.sparkSession.read.parquet(jobs_path).where("status is distinct from 'cancelled'")
        served(batch, jobs).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    w = log.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def until_ended(start: Callable[[], StreamingQuery], ended: Callable[[], bool], most: int = 5, first: float = 3.0, sleep: Callable[[float], None] = time.sleep) -> int:
    """Start a stream again from its checkpoint until ended() holds; the number of restarts, `most` at most.

    The nth restart waits first * 2**(n - 1) seconds. A stream that stops cleanly before the end is started again too.
    """
    for n in range(most + 1):
        if n:
            sleep(first * 2 ** (n - 1))
        try:
            start().awaitTermination()
        except StreamingQueryException:
            pass
        if ended():
            return n
    raise RuntimeError(f"the stream did not end after {most} restarts")


def answered_starts(starts: DataFrame, calls: DataFrame, within: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """run, id, started_at, args, called_at, content: tool starts(run, id, ts, args) with the calls(run, id, ts, content) that answer
    them within that time; starts without one follow, with nulls, when the watermark shows that none can come.

    Streams are joined on run and id with bounded state; tables by the same condition give the same rows.
    """
    if starts.isStreaming:
        starts, calls = starts.withWatermark("ts", late), calls.withWatermark("ts", late)
    s, c = starts.alias("s"), calls.alias("c")
    on = (F.col("s.run") == F.col("c.run")) & (F.col("s.id") == F.col("c.id")) & (F.col("c.ts") >= F.col("s.ts")) & (F.col("c.ts") <= F.col("s.ts") + F.expr(f"interval {within}"))
    return s.join(c, on, "left").select("s.run", "s.id", F.col("s.ts").alias("started_at"), "s.args", F.col("c.ts").alias("called_at"), "c.content")
