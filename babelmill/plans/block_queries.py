"""Queries over text blocks, reviewers and messages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from babelmill.operators import blocks
from babelmill.operators.lineage import shared_dir
from babelmill.plans.file_queries import _TURNS_SQL, _turns
from babelmill.plans.queries import query, read

_TEXT = "coalesce(text, '')"


@query(f"""
SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN role ELSE 'Text' END AS type,
  CASE WHEN turn % 2 = 1 THEN 'role=' || role ELSE '' END AS info, {_TEXT} AS text FROM conversations
""")
def output_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of which every other one has neither a type nor info."""
    odd = F.col("turn") % 2 == 1
    c = read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), F.when(odd, F.col("role")).alias("type"),
        F.when(odd, F.create_map(F.lit("role"), F.col("role"))).alias("info"),
    )
    said = F.array_join(F.transform(F.map_entries("info"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return blocks.output_blocks(c).withColumn("info", said)


@query(f"""
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY role) - 1 AS position, t AS text, role AS model
FROM (SELECT conv_id, role, arg_max({_TEXT}, turn) AS t FROM conversations GROUP BY ALL)
""")
def model_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last text of each role as alternatives to choose from."""
    last = read(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.max_by(F.coalesce("text", F.lit("")), "turn").alias("t"))
    by_model = last.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "t"))).alias("m"))
    made = by_model.select("conv_id", F.posexplode(blocks.model_texts(F.col("m"))).alias("position", "x"))
    return made.select("conv_id", F.col("position").cast("long"), "x.text", "x.model")


@query(f"""
SELECT conv_id, '[' || string_agg('{{"id":"' || conv_id || '-' || n || '","source":' || to_json(x) || ',"translation":' || to_json(coalesce(y, '')) || '}}', ',' ORDER BY n) || ']' AS input
FROM {_TURNS_SQL} GROUP BY conv_id
""")
def reviewer_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reviewer reads of each conversation: a turn as the source, the next as its translation."""
    turns = _turns(spark, sf_dir).select("conv_id", "n", F.col("x").alias("source"), F.col("y").alias("translation"))
    return blocks.reviewer_input(turns, "conv_id", "n")


@query(f"SELECT conv_id, string_agg(CASE WHEN turn % 2 = 1 THEN '[' || {_TEXT} || ']' ELSE {_TEXT} END, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def translated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of which every other block is translated."""
    text = F.coalesce("text", F.lit(""))
    made = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("["), text, F.lit("]")))
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("source"), made.alias("translation"))
    return blocks.translated_text(c, "conv_id", "turn")


@query(f"SELECT conv_id, turn, CASE WHEN role = 'user' THEN '' ELSE {_TEXT} END AS translation FROM conversations")
def failed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations of a job that fails for the users' turns."""
    error = F.when(F.col("role") == "user", F.lit("timeout"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", blocks.or_empty(F.col("text"), error).alias("translation"))


@query("SELECT 'any' AS asked, event_id, user_id FROM events UNION ALL SELECT '13', event_id, user_id FROM events WHERE user_id = 13")
def user_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with and without a user named."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id")
    asked = lambda user: blocks.of_user(e, user).select(F.lit("any" if user is None else str(user)).alias("asked"), "event_id", "user_id")
    return asked(None).unionByName(asked(13))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey = 7")
def part_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.row_of(read(spark, sf_dir, "part"), "p_partkey", 7).select("p_partkey", "p_name")


@query(f"SELECT conv_id, turn, {_TEXT} AS text FROM conversations WHERE role = 'assistant' AND turn > 0")
def agent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assistant's messages, those that open a conversation being system messages."""
    c = read(spark, sf_dir, "conversations").withColumns({"agent": F.col("role"), "system": F.col("turn") == 0})
    return blocks.messages_of(c, "assistant").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY role <> 'user', turn) AS position FROM conversations")
def appended_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users' messages with the others appended to them."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    users = F.col("role") == "user"
    all_of = blocks.appended(c.where(users), c.where(~users), "turn")
    return all_of.select("conv_id", "turn", F.row_number().over(W.partitionBy("conv_id").orderBy("order")).cast("long").alias("position"))


@query("SELECT l_orderkey, string_agg(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_quantity) AS scores FROM lineitem GROUP BY l_orderkey")
def score_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's quantities, line by line."""
    scores = blocks.score_list(F.col("l_quantity").cast("long"), "l_linenumber", "l_partkey")
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(scores.cast("array<string>"), ",").alias("scores"))


@query("""
SELECT conv_id, count(*) FILTER (WHERE y IS NOT NULL AND x IS DISTINCT FROM y) AS changed, count(y) AS reviewed
FROM (SELECT conv_id, text AS x, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS y FROM conversations) GROUP BY conv_id
""")
def changed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many turns of a conversation differ from the turn before."""
    w = W.partitionBy("conv_id").orderBy("turn")
    c = read(spark, sf_dir, "conversations").select("conv_id", F.col("text").alias("x"), F.lead("text").over(w).alias("y"))
    return c.groupBy("conv_id").agg(blocks.changed_count(F.col("x"), F.col("y")).alias("changed"), F.count("y").alias("reviewed"))


@query("SELECT o_orderkey, count(l_orderkey) AS n_children FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def inserted_with_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their lines inserted into new tables and read back."""
    folder = f"{shared_dir(spark)}/inserted-{uuid.uuid4().hex}"
    blocks.insert_with_children(read(spark, sf_dir, "orders").select("o_orderkey"), read(spark, sf_dir, "lineitem").select("l_orderkey"), folder)
    counts = spark.read.parquet(f"{folder}/children").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    header = spark.read.parquet(f"{folder}/header")
    return header.join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_children"))
