"""Text blocks, their reviewers and their messages: output shapes, fallbacks, counts and inserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def output_blocks(blocks: DataFrame) -> DataFrame:
    """blocks with `type` ("Text" where null) and `info` (an empty map where null)."""
    none = F.create_map().cast("map<string,string>")
    return blocks.withColumns({"type": F.coalesce("type", F.lit("Text")), "info": F.coalesce("info", none)})


def model_texts(by_model: Column) -> Column:
    """An array of {text, model}, by model, from a map of model to text; empty for a null map."""
    pairs = F.transform(F.map_entries(by_model), lambda e: F.struct(e["value"].alias("text"), e["key"].alias("model")))
    by_name = lambda a, b: F.when(a["model"] < b["model"], -1).when(a["model"] > b["model"], 1).otherwise(0)
    return F.coalesce(F.array_sort(pairs, by_name), F.array().cast("array<struct<text:string,model:string>>"))


def reviewer_input(segments: DataFrame, page: str, block: str) -> DataFrame:
    """page, input: a JSON array of {id "page-block", source, translation} a page, by block; nulls are empty texts."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    one = F.struct(F.concat_ws("-", page, block).alias("id"), text("source"), text("translation"))
    held = segments.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(F.col(block).alias("b"), one.alias("row")))).alias("rows"))
    return held.select(page, F.to_json(F.transform("rows", lambda r: r["row"])).alias("input"))


def translated_text(blocks: DataFrame, key: str, order: str) -> DataFrame:
    """key, text: translations in order, a block without one keeping its source."""
    one = F.struct(F.col(order).alias("o"), F.coalesce("translation", "source", F.lit("")).alias("t"))
    held = blocks.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("b"))
    return held.select(key, F.array_join(F.transform("b", lambda b: b["t"]), "").alias("text"))


def or_empty(translation: Column, error: Column) -> Column:
    """The translation, or an empty text where it failed: the other segments of the job go on."""
    return F.when(error.isNotNull(), F.lit("")).otherwise(F.coalesce(translation, F.lit("")))


def of_user(df: DataFrame, user: object = None, by: str = "user_id") -> DataFrame:
    """The user's rows; all rows if no user is named."""
    return df if user is None else df.where(F.col(by) == user)


def row_of(df: DataFrame, key: str, value: object) -> DataFrame:
    """The rows of one key: the filter reaches the scan."""
    return df.where(F.col(key) == value)


def messages_of(messages: DataFrame, agent: str) -> DataFrame:
    """Messages of the agent that are no system messages."""
    return messages.where((F.col("agent") == agent) & ~F.coalesce(F.col("system"), F.lit(False)))


def appended(history: DataFrame, new: DataFrame, *order: str) -> DataFrame:
    """history and new in one table; `iteration` says which came first."""
    first, second = history.withColumn("iteration", F.lit(0)), new.withColumn("iteration", F.lit(1))
    return first.unionByName(second).withColumn("order", F.struct("iteration", *order))


def score_list(score: Column, *order: str) -> Column:
    """Aggregate: the scores in order."""
    made = F.array_sort(F.collect_list(F.struct(*order, score.alias("score_"))))
    return F.transform(made, lambda s: s["score_"])


def changed_count(before: Column, after: Column) -> Column:
    """Aggregate: how many reviewed texts differ from the text before; unreviewed ones (null) don't count."""
    return F.count_if(after.isNotNull() & ~before.eqNullSafe(after))


def insert_with_children(header: DataFrame, children: DataFrame, folder: str) -> None:
    """Append both tables below folder, the children first: a header that can be read has its children."""
    children.write.mode("append").parquet(f"{folder}/children")
    header.write.mode("append").parquet(f"{folder}/header")
