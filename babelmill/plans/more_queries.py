"""More queries over the driver's tables: projections, guards, chat and log rules, style guides, streams in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from babelmill.functions import segmentation as seg
from babelmill.functions import style_guide
from babelmill.functions import text as tx
from babelmill.operators import keyed, styles
from babelmill.plans.queries import _sentence_sql, query, read
from babelmill.sources.exchange import sse_events
from babelmill.sources.writers import new_xliff


@query(r"""
SELECT conv_id AS document_id, '<?xml version="1.0" encoding="UTF-8"?><xliff xmlns="urn:oasis:names:tc:xliff:document:1.2" version="1.2"><file source-language="en" target-language="fr" datatype="plaintext" original="document"><body>'
  || string_agg('<trans-unit id="seg_' || n || '"><source>' || x || '</source><target>' || x || '</target></trans-unit>', '' ORDER BY turn) || '</body></file></xliff>' AS xml
FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS x FROM conversations)
GROUP BY conv_id
""")
def xliff_from_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return new_xliff(c.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("pos"), F.col("text").alias("source_text"), F.col("text").alias("target_text")), "en", "fr")


@query("""
SELECT conv_id, string_agg('<page n=''' || turn // 2 || '''>' || t || '</page>', chr(10) ORDER BY turn // 2) AS prompt FROM (
  SELECT conv_id, turn // 2 * 2 AS turn, string_agg(text, chr(10) || chr(10) ORDER BY conversations.turn) AS t FROM conversations GROUP BY conv_id, conversations.turn // 2) GROUP BY conv_id
""")
def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages (two turns each) as tagged text, blocks apart by a blank line."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.floor(F.col("turn") / 2).alias("page"))
    pages = keyed.concatenated(c.withColumn("k", F.struct("conv_id", "page")), "k", "turn", "text", "\n\n").select("k.*", "text")
    tagged = pages.withColumn("prompt", F.concat(F.lit("<page n='"), F.col("page"), F.lit("'>"), F.col("text"), F.lit("</page>")))
    return keyed.concatenated(tagged, "conv_id", "page", "prompt", "\n")


@query("SELECT conv_id, count(*) AS n, count(*) > 6 AS too_many, bool_and(turn < 5) AS only_first_pages, sum(CASE WHEN turn < 5 THEN length(trim(text)) ELSE 0 END) = 0 AS image_based FROM conversations GROUP BY conv_id")
def document_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    first = F.when(F.col("turn") < 5, F.length(F.trim("text"))).otherwise(0)
    return c.groupBy("conv_id").agg(F.count("*").alias("n"), (F.count("*") > 6).alias("too_many"), F.bool_and(F.col("turn") < 5).alias("only_first_pages"), (F.sum(first) == 0).alias("image_based"))


@query("SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring')")
def termbase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.lower(F.lit("Ring"))
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return p.where(F.contains(F.lower("p_name"), asked) | F.contains(F.lower("p_type"), asked))


@query("SELECT user_id, count(*) AS seen, CAST(sum(CASE WHEN n <= 3 THEN 1 ELSE 0 END) AS BIGINT) AS allowed FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) GROUP BY 1")
def tool_call_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three tool calls of a run count."""
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return read(spark, sf_dir, "events").select("user_id", n.alias("n")).groupBy("user_id").agg(F.count("*").alias("seen"), F.count_if(F.col("n") <= 3).alias("allowed"))


@query("""
SELECT user_id, min(ts) AS first_ok, arg_min(event_type, ts) AS provider FROM events WHERE event_type <> 'error' GROUP BY user_id
""")
def first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retries over providers: the first attempt that did not fail."""
    e = read(spark, sf_dir, "events").where("event_type <> 'error'")
    return e.groupBy("user_id").agg(F.min("ts").alias("first_ok"), F.min_by("event_type", "ts").alias("provider"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE props IS NOT NULL")
def event_stream_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payloads of server-sent lines, one a row of events."""
    body = F.concat(F.lit('{"id": '), F.col("event_id"), F.lit(', "p": '), F.col("props"), F.lit("}"))
    lines = read(spark, sf_dir, "events").select(F.concat(F.lit("data: "), body).alias("value"))
    p = sse_events(lines)
    return p.select(F.variant_get("payload", "$.id", "bigint").alias("event_id"), F.variant_get("payload", "$.p.k", "int").alias("k"))


@query("""
SELECT a.user_id, a.event_id AS started, b.event_id AS ended FROM (SELECT *, row_number() OVER w AS n FROM events WHERE event_type = 'view' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) a
JOIN (SELECT *, row_number() OVER w AS n FROM events WHERE event_type = 'click' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) b ON a.user_id = b.user_id AND a.n = b.n
""")
def tool_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts and calls of tools, matched by order of arrival."""
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    e = read(spark, sf_dir, "events")
    start = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("started"), n.alias("n"))
    end = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("ended"), n.alias("n"))
    return start.join(end, ["user_id", "n"]).select("user_id", "started", "ended")


_FENCED = "CASE WHEN turn % 3 = 0 THEN role || chr(10) || '```json' || chr(10) || '{\"action\": \"edit_translation\", \"segment_id\": \"0-' || turn || '\", \"new_text\": \"x' || conv_id || '\"}' || chr(10) || '```' || chr(10) || 'end' WHEN turn % 3 = 1 THEN role || ' ```json {\"a\"' ELSE role || ' ``' END"


@query(f"""
WITH m AS (SELECT conv_id, turn, {_FENCED} AS reply FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS n_edits, CASE WHEN turn % 3 = 0 THEN '0-' || turn || '=x' || conv_id ELSE '' END AS edits,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(reply, '(?s)```json\\s*\\{{.*?\\}}\\s*```', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '(?s)```json\\b.*$', ''), '`{{1,3}}(j(s(o(n)?)?)?)?$', ''), ' ' || chr(10)) AS shown FROM m
""")
def chat_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits in chat replies, and what is shown while they arrive."""
    body = F.concat(F.lit('{"action": "edit_translation", "segment_id": "0-'), F.col("turn"), F.lit('", "new_text": "x'), F.col("conv_id"), F.lit('"}'))
    whole = F.concat(F.col("role"), F.lit("\n```json\n"), body, F.lit("\n```\nend"))
    reply = F.when(F.col("turn") % 3 == 0, whole).when(F.col("turn") % 3 == 1, F.concat(F.col("role"), F.lit(' ```json {"a"'))).otherwise(F.concat(F.col("role"), F.lit(" ``")))
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", reply.alias("reply"))
    edits = tx.edits_of(F.col("reply"))
    return c.select("conv_id", "turn", F.size(edits).cast("long").alias("n_edits"), F.array_join(F.transform(edits, lambda e: F.concat_ws("=", e["segment_id"], e["new_text"])), ",").alias("edits"), tx.without_fenced_json(F.col("reply")).alias("shown"))


_AGENTS = ("Mozilla/5.0 (Windows NT 10.0) Chrome/1 Safari/1 Edge/1", "Mozilla/5.0 (Macintosh; Mac OS X) Safari/1", "Mozilla/5.0 (X11; Linux) Firefox/1", "Opera/9 (Linux; Android 4)", "curl/8")


@query(f"""
WITH a AS (SELECT event_id, ([{', '.join(f"'{x}'" for x in _AGENTS)}])[event_id % 5 + 1] AS ua FROM events)
SELECT event_id, CASE WHEN contains(ua, 'Firefox') THEN 'Firefox' WHEN contains(ua, 'Chrome') THEN 'Chrome' WHEN contains(ua, 'Safari') THEN 'Safari' WHEN contains(ua, 'Opera') THEN 'Opera' ELSE 'Unknown' END AS browser,
       CASE WHEN contains(ua, 'Windows') THEN 'Windows' WHEN contains(ua, 'Mac') THEN 'macOS' WHEN contains(ua, 'Linux') THEN 'Linux' ELSE 'Unknown' END AS system FROM a
""")
def user_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    agent = F.array(*map(F.lit, _AGENTS))[(F.col("event_id") % 5).cast("int")]
    return read(spark, sf_dir, "events").select("event_id", tx.first_mark(agent, tx.BROWSERS).alias("browser"), tx.first_mark(agent, tx.SYSTEMS).alias("system"))


@query("SELECT event_id, event_id % 4 = 0 AS recoverable FROM events")
def recoverable_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only an error of the right type with the right message is worth another connection."""
    pick = lambda *x: F.array(*map(F.lit, x))[(F.col("event_id") % 4).cast("int")]
    kind, message = pick("TypeError", "TypeError", "Error", None), pick("Failed to fetch (host)", "x is not a function", "network error", "Load failed")
    return read(spark, sf_dir, "events").select("event_id", tx.recoverable(kind, message).alias("recoverable"))


@query(r"""
SELECT p_partkey, '<style_guide>' || chr(10) || '  <tone_and_register>' || chr(10) || '  <register>' || p_type || '</register>' || chr(10) || '  </tone_and_register>' || chr(10)
  || CASE WHEN p_size > 25 THEN '  <numbers_dates_units>' || chr(10) || '  <units_handling>' || p_size || ' &lt; &amp;</units_handling>' || chr(10) || '  </numbers_dates_units>' || chr(10) ELSE '' END || '</style_guide>' AS xml,
  '# Translation Style Guide' || chr(10) || chr(10) || '## Tone & Register' || chr(10) || '- **Register:** ' || p_type
  || CASE WHEN p_size > 25 THEN chr(10) || chr(10) || '## Numbers, Dates & Units' || chr(10) || '- **Units Handling:** ' || p_size || ' < &' ELSE '' END AS markdown, true AS filled FROM part
""")
def style_guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.create_map(F.lit("register"), F.col("p_type"), F.lit("units"), F.when(F.col("p_size") > 25, F.concat(F.col("p_size"), F.lit(" < &"))))
    p = read(spark, sf_dir, "part").select("p_partkey", form.alias("form"))
    f = F.col("form")
    return p.select("p_partkey", style_guide.as_xml(f).alias("xml"), style_guide.as_markdown(f).alias("markdown"), style_guide.is_filled(f).alias("filled"))


@query("SELECT p_partkey, array_to_string(list_filter(['- ' || p_name, CASE WHEN p_size % 2 = 0 THEN '- ' || p_type END], lambda x: x IS NOT NULL), chr(10)) AS preferences FROM part")
def preference_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed lines as bullets: markers stripped, blank ones dropped."""
    typed = F.concat(F.lit(" * "), F.col("p_name"), F.lit("\n\n -  "), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(""))
    lines = F.transform(tx.bullets(typed), lambda x: F.concat(F.lit("- "), x))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(lines, "\n").alias("preferences"))


@query("""
WITH RECURSIVE style AS (SELECT p_partkey AS id, p_partkey // 3 AS parent, CASE WHEN p_size % 4 = 0 THEN CASE WHEN p_size % 8 = 0 THEN 'left' ELSE 'right' END END AS alignment FROM part),
walk AS (SELECT id, parent, alignment FROM style UNION ALL SELECT w.id, s.parent, s.alignment FROM walk w JOIN style s ON w.parent = s.id WHERE w.alignment IS NULL AND w.parent <> s.parent),
f AS (SELECT style.id, max(walk.alignment) AS alignment FROM style LEFT JOIN walk ON style.id = walk.id GROUP BY style.id)
SELECT id, alignment, CASE WHEN alignment IS NULL OR alignment = 'left' THEN 'right' WHEN alignment = 'right' THEN 'left' ELSE alignment END AS mirrored FROM f
""")
def effective_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A style's own alignment, else the nearest parent's, and its mirror image; the style 0 is nobody's parent."""
    p = read(spark, sf_dir, "part")
    own = F.when(F.col("p_size") % 4 == 0, F.when(F.col("p_size") % 8 == 0, "left").otherwise("right"))
    style = p.select(F.col("p_partkey").alias("id"), F.nullif(F.floor(F.col("p_partkey") / 3), F.lit(0)).alias("parent"), own.alias("alignment"))
    return styles.inherited(style).select("id", "alignment", styles.mirrored(F.col("alignment")).alias("mirrored"))


@query("""
SELECT l_orderkey, arg_min(l_returnflag, l_linenumber * 100000000 + l_partkey) FILTER (l_quantity > 10) AS format, count(DISTINCT l_linenumber) AS cells FROM lineitem GROUP BY 1
""")
def run_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The format of the first run that is not blank, and unique cells."""
    at = F.when(F.col("l_quantity") > 10, F.col("l_linenumber") * 100000000 + F.col("l_partkey"))
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_returnflag", at).alias("format"), F.countDistinct("l_linenumber").alias("cells"))


@query("""
SELECT page_id, coalesce(nullif(title, ''), url) AS title, url, replace(html, chr(10), ' ') AS text FROM (
  SELECT *, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'Page ' || page_id END AS title FROM pages) WHERE url IS NOT NULL
""")
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results normalised: rows without a URL dropped, titles default to it, text lists joined."""
    p = read(spark, sf_dir, "pages")
    title = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("Page "), F.col("page_id")))
    parts = F.split("html", "\n", -1)
    return p.where("url is not null").select("page_id", F.coalesce(F.nullif(title, F.lit("")), F.col("url")).alias("title"), "url", F.array_join(parts, " ").alias("text"))


@query("SELECT vec_id, now - created <= 900 AS alive FROM (SELECT vec_id, vec_id * 3 AS created, max(vec_id) OVER () * 3 AS now FROM embeddings)")
def stored_files_alive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated files expire after 900 seconds."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") * 3).alias("created"))
    now = e.agg(F.max("created").alias("now"))
    return e.join(F.broadcast(now)).select("vec_id", (F.col("now") - F.col("created") <= 900).alias("alive"))


@query("SELECT conv_id, string_agg(role || '=' || n, ',' ORDER BY role) AS results FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL) GROUP BY conv_id")
def gathered_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled results of parallel calls, as one map in label order."""
    n = read(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    held = F.array_sort(F.collect_list(F.concat_ws("=", "role", F.col("n").cast("string"))))
    return n.groupBy("conv_id").agg(F.array_join(held, ",").alias("results"))


@query(f"""
WITH s AS (SELECT doc_id, {_sentence_sql('text')} AS x FROM documents)
SELECT doc_id, CAST(i // 2 AS BIGINT) AS place, array_to_string(x[i + 1:i + 2], ' ') AS text FROM (SELECT doc_id, x, unnest(range(0, len(x), 2)) AS i FROM s)
""")
def segment_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences two at a time, as segments of a larger grain."""
    d = read(spark, sf_dir, "documents").select("doc_id", seg.grouped(seg.sentences(F.col("text")), 2).alias("x"))
    return d.select("doc_id", F.posexplode("x").alias("place", "text")).select("doc_id", F.col("place").cast("long").alias("place"), "text")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(count(*) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey) AS BIGINT) AS completed, count(*) OVER (PARTITION BY l_orderkey) AS total FROM lineitem")
def completion_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress events in order of completion."""
    w = W.partitionBy("l_orderkey")
    done = F.row_number().over(w.orderBy("l_shipdate", "l_linenumber", "l_partkey"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", done.cast("long").alias("completed"), F.count("*").over(w).alias("total"))


