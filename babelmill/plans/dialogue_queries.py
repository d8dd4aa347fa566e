"""Queries over an assistant's runs: tool calls, providers, labelled answers, tokens, error texts, profiles, served lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from babelmill.functions import text as tx
from babelmill.operators import dialogue
from babelmill.plans.file_queries import _files, _printed_sql, printed
from babelmill.plans.queries import query, read
from babelmill.sources import exchange


@query("""
SELECT user_id, event_id, CASE WHEN event_id % 4 <> 0 THEN event_id WHEN p.event_type = 'view' THEN p.event_id END AS tool_call_id,
       CASE WHEN p.event_type = 'view' THEN p.props ELSE props END AS args
FROM (SELECT *, lag(e) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events e WHERE event_type IN ('view', 'click')) WHERE event_type = 'click'
""")
def tool_call_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls with the ids and arguments of their starts; every fourth call comes without an id."""
    kind = F.when(F.col("event_type") == "view", "tool_start").when(F.col("event_type") == "click", "tool_call").otherwise("text")
    own = F.when((kind == "tool_start") | (F.col("event_id") % 4 != 0), F.col("event_id"))
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", kind.alias("type"), own.alias("id"), F.col("props").alias("args"))
    return dialogue.tool_calls(e, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "tool_call_id", "args")


@query("""
WITH a AS (SELECT user_id, event_id % 3 AS provider, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts, event_id) AS attempt,
             event_id AS answer, CASE WHEN event_type <> 'purchase' THEN event_type || ' ' || event_id END AS error FROM events),
k AS (SELECT * FROM a WHERE attempt <= 3),
r AS (SELECT user_id, arg_min({'p': provider, 'a': attempt, 'w': answer}, provider * 10 + attempt) FILTER (error IS NULL) AS won,
        arg_max(coalesce(error, ''), provider * 10 + attempt) AS last, count(DISTINCT provider) AS n FROM k GROUP BY 1)
SELECT user_id, won.p AS provider, won.a AS attempt, won.w AS answer,
       CASE WHEN won IS NULL THEN 'All ' || n || ' providers failed after 3 attempts each. Last error: ' || last END AS error FROM r
""")
def provider_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first answer over three providers, three attempts each."""
    error = F.when(F.col("event_type") != "purchase", F.concat_ws(" ", "event_type", "event_id"))
    e = read(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 3).alias("provider"), "ts", "event_id", F.col("event_id").alias("answer"), error.alias("error"))
    return dialogue.first_success(e, "user_id", ["ts", "event_id"])


@query("""
SELECT conv_id, role AS label, arg_max(CASE WHEN turn % 3 = 0 THEN 'Error: turn ' || turn ELSE coalesce(text, '') END, turn) AS said FROM conversations GROUP BY ALL
""")
def labelled_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by label; every third failed."""
    error = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("turn "), F.col("turn")))
    c = read(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("label"), "turn", F.coalesce("text", F.lit("")).alias("text"), error.alias("error"))
    return dialogue.gathered(c, "conv_id", "turn").select("conv_id", F.explode("results").alias("label", "said"))


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant' AND text <> ''")
def reply_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the model's node as plain text: strings, lists of strings, lists of parts."""
    listed = F.parse_json(F.to_json(F.array("text"), {"ignoreNullFields": "false"}))
    parts = F.parse_json(F.to_json(F.array(F.struct(F.lit("text").alias("type"), "text")), {"ignoreNullFields": "false"}))
    content = F.when(F.col("turn") % 3 == 0, F.try_variant_get(listed, "$[0]", "variant")).when(F.col("turn") % 3 == 1, parts).otherwise(listed)
    node = F.when(F.col("role") == "assistant", "model").otherwise("tools")
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", node.alias("node"), content.alias("content"))
    return dialogue.tokens(c).select("conv_id", "turn", "text")


@query("""
SELECT event_id, CASE event_id % 6 WHEN 1 THEN event_type WHEN 2 THEN 'm ' || event_type WHEN 3 THEN CAST(event_id AS VARCHAR) WHEN 4 THEN '[object Object]' ELSE 'Unknown error' END AS message,
  CASE WHEN event_id % 6 = 2 THEN 'TypeError' END AS name, CASE WHEN event_id % 6 = 2 THEN CAST(event_id AS VARCHAR) END AS code, CASE WHEN event_id % 6 = 2 THEN repeat('s', 4000) || '...' END AS stack FROM events
""")
def error_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is reported of errors that are nothing, a string, an object, a number, an object without a message, or empty."""
    n = F.col("event_id")
    whole = F.to_json(F.struct(F.concat(F.lit("m "), F.col("event_type")).alias("message"), F.lit("TypeError").alias("name"), n.alias("code"), F.repeat(F.lit("s"), 5000).alias("stack")))
    shown = F.when(n % 6 == 1, F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))).when(n % 6 == 2, whole).when(n % 6 == 3, n.cast("string"))
    shown = shown.when(n % 6 == 4, '{"name": "x", "message": ""}').when(n % 6 == 5, '""').otherwise("null")
    return read(spark, sf_dir, "events").select("event_id", tx.error_info(F.parse_json(shown)).alias("e")).select("event_id", "e.*")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN p_type ELSE '' END AS role, CASE WHEN p_partkey % 4 = 0 THEN 'a,' || p_name ELSE '' END AS preferences, p_partkey % 4 < 2 AS usable FROM part
""")
def translator_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles in replies: whole, with preferences that are no list, without JSON, with broken JSON."""
    k = F.col("p_partkey") % 4
    body = F.when(k == 0, F.to_json(F.struct(F.col("p_type").alias("role"), F.array(F.lit("a"), "p_name").alias("preferences"))))
    body = body.when(k == 1, F.to_json(F.struct(F.col("p_type").alias("role"), F.lit("x").alias("preferences")))).when(k == 2, "none").otherwise('{"role": }')
    reply = F.concat(F.lit("Here it is:\n"), body, F.lit("\nDone."))
    p = read(spark, sf_dir, "part").select("p_partkey", tx.profile_of(reply).alias("p"))
    return p.select("p_partkey", "p.role", F.array_join("p.preferences", ",").alias("preferences"), "p.usable")


_STATUS_SQL = "(SELECT DISTINCT user_id AS job_id, (['running', 'done', 'error', 'cancelled'])[user_id % 4 + 1] AS status FROM events WHERE user_id % 9 <> 0)"


@query(f"""
WITH l AS (SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type FROM events)
SELECT job_id, seq, 'data: {{"seq":' || seq || ',"type":"' || event_type || '"}}' || chr(10) || chr(10) AS line FROM l JOIN {_STATUS_SQL} USING (job_id) WHERE seq > 2
UNION ALL SELECT job_id, NULL, CASE WHEN status = 'error' THEN 'data: {{"type":"error","detail":"e' || job_id || '"}}' || chr(10) || chr(10) ELSE ': keep-alive' || chr(10) || chr(10) END
FROM {_STATUS_SQL} WHERE status IN ('running', 'error')
""")
def served_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Server-sent lines of jobs for viewers who have seen two events."""
    e = read(spark, sf_dir, "events").withColumnRenamed("user_id", "job_id")
    seq = F.row_number().over(W.partitionBy("job_id").orderBy("ts", "event_id")).cast("long")
    log = e.select("job_id", seq.alias("seq"), "event_type")
    log = log.select("job_id", "seq", F.to_json(F.struct("seq", F.col("event_type").alias("type"))).alias("payload"))
    status = F.array(*map(F.lit, ["running", "done", "error", "cancelled"]))[(F.col("job_id") % 4).cast("int")]
    jobs = e.where("job_id % 9 <> 0").select("job_id").distinct().select("job_id", status.alias("status"), F.concat(F.lit("e"), F.col("job_id")).alias("error"))
    return dialogue.served(log, jobs, 2)


@query("SELECT event_id FROM events e WHERE NOT EXISTS (FROM events a WHERE a.user_id = e.user_id AND a.event_id % 50 = e.event_id % 50 AND a.event_type = 'error')")
def unaborted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of turns that were not aborted."""
    e = read(spark, sf_dir, "events").withColumn("epoch", F.col("event_id") % 50)
    return dialogue.without_aborted(e, ["user_id", "epoch"], F.col("event_type") == "error").select("event_id")


@query("""
WITH b AS (SELECT conv_id, turn, role, length(text) % 3 AS num FROM conversations),
s AS (SELECT *, role = 'user' AS t, lag(role) OVER w AS r, lag(num) OVER w AS m FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
n AS (SELECT *, CASE WHEN NOT t THEN 0 WHEN r IS DISTINCT FROM 'user' THEN 1 WHEN num = 0 THEN 0 WHEN num IS NOT DISTINCT FROM m THEN 0 ELSE 1 END AS first FROM s)
SELECT conv_id, turn, CASE WHEN t THEN CAST(sum(first) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) END AS run FROM n
""")
def written_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which table each block is written to; here a user's turns are table blocks."""
    kind = F.when(F.col("role") == "user", "Table").otherwise("Text")
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", kind.alias("kind"), (F.length("text") % 3).alias("num"))
    return dialogue.table_blocks(c, "conv_id", "turn").select("conv_id", "turn", "run")


@query(f"""
WITH c AS (SELECT p_size, p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS n, {_printed_sql('p_name')} AS s, {_printed_sql('p_type')} AS t FROM part)
SELECT CAST(p_size AS BIGINT) AS p_size, s AS source_term, arg_min(t, n) AS target_term, min(n) AS position FROM c WHERE s <> '' AND t <> '' AND p_partkey % 5 <> 0 GROUP BY p_size, s
""")
def tbx_two_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term bases read without saying the languages: only concepts in exactly two count; every fifth has a third."""
    n = F.row_number().over(W.partitionBy("p_size").orderBy("p_partkey"))
    p = read(spark, sf_dir, "part").select("p_size", "p_partkey", n.alias("n"), printed(F.col("p_name")).alias("s"), printed(F.col("p_type")).alias("t"))

    def said(lang: str, text: Column) -> Column:
        return F.concat(F.lit(f'<langSet xml:lang="{lang}"><tig><term>'), tx.escape_xml(text), F.lit("</term></tig></langSet>"))

    third = F.when(F.col("p_partkey") % 5 == 0, said("de", F.lit("x"))).otherwise("")
    concept = F.concat(F.lit("<termEntry>"), said("en", F.col("s")), said("fr", F.col("t")), third, F.lit("</termEntry>"))
    found = exchange.two_languages(exchange.parsed(_files(p, "p_size", "n", "<martif><text><body>", concept, "</body></text></martif>"), exchange.tbx_rows, exchange.TBX))
    return found.select(F.col("path").cast("long").alias("p_size"), "source_term", "target_term", F.col("position").cast("long"))
