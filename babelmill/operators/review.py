"""Review: merging reviewer output, pending suggestions, batch application, splits, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from babelmill.functions.text import half_up, percent, word_count


def segment_id(page: Column, block: Column) -> Column:
    return F.concat_ws("-", page.cast("string"), block.cast("string"))


def merge_review(segments: DataFrame, reviews: DataFrame) -> DataFrame:
    """segments(document_id, page, block, source, translation) with reviews(document_id, page, block, suggestion, note)."""
    keys = ["document_id", "page", "block"]
    changed = ~F.col("suggestion").eqNullSafe(F.col("translation"))
    return segments.join(reviews, keys).select(*keys, segment_id(F.col("page"), F.col("block")).alias("id"), "source", F.col("translation").alias("original"), F.col("suggestion").alias("revised"), "note", changed.alias("changed"))


def pending() -> Column:
    """Of columns review_suggestion, review_note, review_applied, review_dismissed, chat_suggestion, chat_applied, chat_dismissed."""
    review = F.coalesce(F.col("review_note"), F.lit("")) != ""
    open_review = review & ~F.coalesce("review_applied", F.lit(False)) & ~F.coalesce("review_dismissed", F.lit(False))
    open_chat = F.col("chat_suggestion").isNotNull() & ~F.coalesce("chat_applied", F.lit(False)) & ~F.coalesce("chat_dismissed", F.lit(False))
    return open_review | open_chat


def applied() -> Column:
    """The translation after all pending suggestions are applied: the review's first, else the chat's."""
    return F.when(pending(), F.coalesce("review_suggestion", "chat_suggestion", "translation")).otherwise(F.col("translation"))


def shifted(block: Column, split: Column) -> Column:
    """State keys after a split: later blocks move on by one, the split one and its new half lose their state (null)."""
    return F.when(block > split, block + 1).when(block < split, block)


def progress(rows: DataFrame, key: str, source: str, confirmed: Column) -> DataFrame:
    return rows.groupBy(key).agg(
        F.count("*").alias("total"), F.count_if(confirmed).alias("checked"), F.sum(word_count(F.col(source))).alias("words")
    ).withColumn("percent", percent(F.col("checked"), F.col("total")))


def neighbours(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    w = W.partitionBy(key).orderBy(order)
    return rows.withColumns({"previous_text": F.lag(text, 1, "").over(w), "next_position": F.lead(order).over(w), "number": F.row_number().over(w)})


def display_numbers(rows: DataFrame, key: str, page: str, block: str) -> DataFrame:
    """rows with `number`: from 1 on over all pages of a document, blocks of a page in order."""
    return rows.withColumn("number", F.row_number().over(W.partitionBy(key).orderBy(page, block)).cast("long"))


def circular_next(rows: DataFrame, key: str, order: str) -> DataFrame:
    w = W.partitionBy(key).orderBy(order)
    ends = W.partitionBy(key)
    return rows.withColumns({
        "next_pending": F.coalesce(F.lead(order).over(w), F.min(order).over(ends)),
        "previous_pending": F.coalesce(F.lag(order).over(w), F.max(order).over(ends)),
    })


def runs(rows: DataFrame, key: str, order: str, kind: str) -> DataFrame:
    """Gaps and islands: adds run, the number of the run of equal kinds."""
    w = W.partitionBy(key).orderBy(order)
    new = F.when(F.col(kind).eqNullSafe(F.lag(kind).over(w)), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w)).drop("_new")


def until_accepted(rows: DataFrame, key: str, iteration: str, score: str, threshold: int, most: int) -> DataFrame:
    """Iterations up to the first whose score reaches the threshold, `most` at most."""
    w = W.partitionBy(key).orderBy(iteration)
    before = F.max(score).over(w.rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("_b", before).where((F.coalesce(F.col("_b"), F.lit(-1)) < threshold)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_b", "_n")


def eta_seconds(elapsed: Column, done: Column, left: Column) -> Column:
    return F.when(done >= 1, elapsed / done * left)


__all__ = ["applied", "circular_next", "eta_seconds", "half_up", "merge_review", "neighbours", "pending", "progress", "runs", "segment_id", "shifted", "until_accepted"]
