"""Runs of an assistant as tables: tool events, attempts over providers, labelled answers, token chunks, served lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from babelmill.operators.jobs import TERMINAL, replay


def tool_calls(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """events(key, order, type, id, args) -> a row a `tool_call`, with the id and args of the start it answers.

    A call answers the start right before it, other kinds of events aside; a start is answered once. A call's own id
    counts before the start's, the start's args before its own.
    """
    held = events.where(F.col("type").isin("tool_start", "tool_call"))
    before = F.lag(F.struct("type", "id", "args")).over(W.partitionBy(key).orderBy(*order))
    held = held.withColumn("_b", before).where("type = 'tool_call'")
    answered = F.coalesce(F.col("_b.type") == "tool_start", F.lit(False))
    call_id = F.coalesce("id", F.when(answered, F.col("_b.id")))
    return held.withColumns({"tool_call_id": call_id, "args": F.when(answered, F.col("_b.args")).otherwise(F.col("args"))}).drop("_b")


def first_success(attempts: DataFrame, key: str, order: list[str], most: int = 3) -> DataFrame:
    """attempts(key, provider, order, answer, error) -> key, provider, attempt, answer, error.

    Providers are asked by number, each up to `most` times; the first attempt without an error answers. Where none does,
    the error names the number of providers and the last error.
    """
    n = F.row_number().over(W.partitionBy(key, "provider").orderBy(*order))
    held = attempts.withColumn("attempt", n.cast("long")).where(F.col("attempt") <= most)
    at = F.struct("provider", "attempt")
    r = held.groupBy(key).agg(
        F.min(F.when(F.col("error").isNull(), F.struct("provider", "attempt", "answer"))).alias("won"),
        F.max_by("error", at).alias("last"), F.countDistinct("provider").alias("asked"),
    )
    failed = F.concat(F.lit("All "), F.col("asked"), F.lit(f" providers failed after {most} attempts each. Last error: "), F.col("last"))
    return r.select(key, "won.provider", "won.attempt", "won.answer", F.when(F.col("won").isNull(), failed).alias("error"))


def gathered(results: DataFrame, key: str, order: str) -> DataFrame:
    """results(key, label, order, text, error) -> key, results map<label, text>: of one label's answers the last, an error as text."""
    said = F.when(F.col("error").isNull(), F.col("text")).otherwise(F.concat(F.lit("Error: "), F.col("error")))
    last = results.groupBy(key, "label").agg(F.max_by(F.struct(said.alias("said")), order).alias("s"))
    return last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("label", "s.said"))).alias("results"))


def token_text(content: Column) -> Column:
    """Text of a chunk's VARIANT content: a string, or the first of a list of parts (its `text`, if it is an object)."""
    first = F.try_variant_get(content, "$[0]", "variant")
    part = F.when(F.startswith(F.schema_of_variant(first), F.lit("OBJECT")), F.try_variant_get(first, "$.text", "string")).otherwise(F.try_variant_get(first, "$", "string"))
    kind = F.schema_of_variant(content)
    return F.when(kind == "STRING", F.try_variant_get(content, "$", "string")).when(F.startswith(kind, F.lit("ARRAY")), part)


def tokens(chunks: DataFrame, node: str = "model") -> DataFrame:
    """chunks(node, content VARIANT, ...) of one node with their text; empty ones are left out. Batch or streaming."""
    return chunks.where(F.col("node") == node).withColumn("text", token_text(F.col("content"))).where("text <> ''").drop("content")


def without_aborted(events: DataFrame, key: list[str], aborted: Column) -> DataFrame:
    """Events of the turns (key) that were not aborted: an abort drops what its turn had given."""
    gone = events.where(aborted).select(*key).distinct()
    return events.join(gone, key, "left_anti")


def served(log: DataFrame, jobs: DataFrame, offset: int = 0) -> DataFrame:
    """job_id, seq, line: what a viewer at `offset` is sent of log(job_id, seq, payload) and jobs(job_id, status, error).

    A line an event, by seq; then (seq null, to be sent last) the error of a job that failed, or a keep-alive comment
    while the job runs. Jobs that are unknown send nothing.
    """
    line = lambda x: F.concat(F.lit("data: "), x, F.lit("\n\n"))
    sent = replay(log, offset).join(jobs.select("job_id"), "job_id", "left_semi").select("job_id", "seq", line(F.col("payload")).alias("line"))
    detail = F.to_json(F.struct(F.lit("error").alias("type"), F.coalesce("error", F.lit("Unknown error")).alias("detail")))
    last = F.when(F.col("status") == "error", line(detail)).when(~F.coalesce(F.col("status").isin(*TERMINAL), F.lit(False)), F.lit(": keep-alive\n\n"))
    return sent.unionByName(jobs.select("job_id", F.lit(None).cast("long").alias("seq"), last.alias("line")).where("line is not null"))


def table_blocks(blocks: DataFrame, key: str, order: str) -> DataFrame:
    """blocks(key, order, kind, num) with run: the number of the table a block is written to, null for other kinds.

    A table block starts a table after a block of another kind, or where its num differs from the block before; num 0
    joins whatever table is open.
    """
    w = W.partitionBy(key).orderBy(order)
    table = F.coalesce(F.col("kind") == "Table", F.lit(False))
    joins = F.coalesce(F.lag("kind").over(w) == "Table", F.lit(False)) & (F.coalesce(F.col("num") == 0, F.lit(False)) | F.col("num").eqNullSafe(F.lag("num").over(w)))
    held = blocks.withColumn("_new", (table & ~joins).cast("long"))
    return held.withColumn("run", F.when(table, F.sum("_new").over(w))).drop("_new")
