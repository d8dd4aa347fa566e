"""The job log in batch form: sequence numbers, replay, terminal states, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from babelmill.operators.review import eta_seconds

TERMINAL = ("done", "error", "cancelled")


def new_jobs(requests: DataFrame, *key: str) -> DataFrame:
    """Job records of requests(file_type, source_lang, target_lang, ...): columns that a request lacks are null, the status is
    `running`. job_id is made from the columns of `key`, so a request sent again names the same job."""
    digest = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in key]).cast("binary"))
    at = lambda a, n: F.substring(digest, a, n)
    job_id = F.concat_ws("-", at(1, 8), at(9, 4), at(13, 4), at(17, 4), at(21, 12))
    optional = [F.col(c) if c in requests.columns else F.lit(None).cast("string").alias(c) for c in ("file_name", "glossary_id", "tm_id", "user_id")]
    return requests.select(job_id.alias("job_id"), "file_type", "source_lang", "target_lang", *optional, F.lit("running").alias("status"))


def sequenced(events: DataFrame) -> DataFrame:
    """events(job_id, ts, event_id, ...) with a dense seq from 1 in each job."""
    return events.withColumn("seq", F.row_number().over(W.partitionBy("job_id").orderBy("ts", "event_id")))


def replay(log: DataFrame, offset: int) -> DataFrame:
    return log.where(F.col("seq") > offset)


def next_sequence(log: DataFrame) -> DataFrame:
    return log.groupBy("job_id").agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("next_seq"))


def until_terminal(log: DataFrame, types: tuple[str, ...] = TERMINAL) -> DataFrame:
    """Events up to and with a job's first terminal one."""
    w = W.partitionBy("job_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    ended = F.max(F.when(F.col("type").isin(*types), 1).otherwise(0)).over(w)
    return log.withColumn("_e", ended).where("coalesce(_e, 0) = 0").drop("_e")


def cancelled_or_unknown(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """An unknown job counts as cancelled."""
    return events.join(jobs.select("job_id", "cancelled"), "job_id", "left").withColumn("cancelled", F.coalesce("cancelled", F.lit(True)))


def estimate(log: DataFrame, baseline: int = 2) -> DataFrame:
    """A job's remaining seconds from its pace since the `baseline`th event, over its events so far and its total."""
    base = F.min(F.when(F.col("seq") == baseline, F.col("ts")))
    j = log.groupBy("job_id").agg(base.alias("_t0"), F.max("ts").alias("_t1"), F.max("seq").alias("completed"), F.max("total").alias("total"))
    elapsed = (F.unix_micros(F.col("_t1").cast("timestamp")) - F.unix_micros(F.col("_t0").cast("timestamp"))) / 1e6
    return j.select("job_id", "completed", "total", eta_seconds(elapsed, F.col("completed") - baseline, F.col("total") - F.col("completed")).alias("eta_s"))
