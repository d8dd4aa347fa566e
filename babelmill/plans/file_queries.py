"""Queries through exchange files: files are made from the driver's tables, then read and written as any others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from babelmill.functions import language, replies, word_diff
from babelmill.functions import text as tx
from babelmill.operators import glossary
from babelmill.plans.queries import _WORDS, _WORDS_SQL, _sentence_sql, query, read
from babelmill.sources import exchange, writers

# What a file can hold: printable characters below the surrogates, without white space at the ends.
_PRINTED = r"[^\x20-\x7E\x{A0}-\x{D7FF}]"


def printed(text: Column) -> Column:
    return tx.strip(F.regexp_replace(F.coalesce(text, F.lit("")), _PRINTED, " "))


def _printed_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace(coalesce({x}, ''), '{_PRINTED}', ' ', 'g'), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


_TURNS_SQL = f"(SELECT conv_id, turn, row_number() OVER w AS n, {_printed_sql('text')} AS x, {_printed_sql('lead(text) OVER w')} AS y FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n (from 1), x (the turn's text), y (the next turn's)."""
    w = W.partitionBy("conv_id").orderBy("turn")
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", F.row_number().over(w).alias("n"), printed(F.col("text")).alias("x"), printed(F.lead("text").over(w)).alias("y"))


def _files(rows: DataFrame, key: str, order: str, head: str, one: Column, tail: str) -> DataFrame:
    """path, content: a file a key, of the pieces `one` in order."""
    held = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, one.alias("piece")))).alias("p"))
    content = F.concat(F.lit(head), F.array_join(F.transform("p", lambda p: p["piece"]), ""), F.lit(tail))
    return held.select(F.col(key).cast("string").alias("path"), content.cast("binary").alias("content"))


@query(f"SELECT conv_id, n - 1 AS position, x AS source_text, y AS target_text FROM {_TURNS_SQL} WHERE x <> '' AND y <> ''")
def tmx_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A translation memory a conversation: each turn with the next as its translation, written as TMX and read."""
    said = lambda lang, c: F.concat(F.lit(f'<tuv xml:lang="{lang}"><seg>'), tx.escape_xml(F.col(c)), F.lit("</seg></tuv>"))
    unit = F.concat(F.lit("<tu>"), said("en-US", "x"), said("fr", "y"), F.lit("</tu>"))
    files = _files(_turns(spark, sf_dir), "conv_id", "n", '<?xml version="1.0" encoding="UTF-8"?><tmx version="1.4"><body>', unit, "</body></tmx>")
    pairs = exchange.pair_variants(exchange.parsed(files, exchange.tmx_variants, exchange.TMX), "en", "fr")
    return pairs.select(F.col("path").cast("long").alias("conv_id"), F.col("position").cast("long"), "source_text", "target_text")


@query(f"""
WITH c AS (SELECT p_size, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS n, {_printed_sql('p_name')} AS s, {_printed_sql('p_type')} AS t FROM part)
SELECT CAST(p_size AS BIGINT) AS p_size, s AS source_term, arg_min(t, n) AS target_term, min(n) AS position FROM c WHERE s <> '' AND t <> '' GROUP BY p_size, s
""")
def tbx_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term base a part size, written as TBX and read; of concepts with one source term the first counts."""
    n = F.row_number().over(W.partitionBy("p_size").orderBy("p_partkey"))
    parts = read(spark, sf_dir, "part").select("p_size", n.alias("n"), printed(F.col("p_name")).alias("s"), printed(F.col("p_type")).alias("t"))
    said = lambda lang, c: F.concat(F.lit(f'<langSet xml:lang="{lang}"><tig><term>'), tx.escape_xml(F.col(c)), F.lit("</term></tig></langSet>"))
    concept = F.concat(F.lit("<termEntry>"), said("en", "s"), said("fr-FR", "t"), F.lit("</termEntry>"))
    files = _files(parts, "p_size", "n", "<martif><text><body>", concept, "</body></text></martif>")
    found = exchange.glossary_of(exchange.parsed(files, exchange.tbx_rows, exchange.TBX), "en", "fr")
    return found.select(F.col("path").cast("long").alias("p_size"), "source_term", "target_term", F.col("position").cast("long"))


def _xliff(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    made = writers.new_xliff(t.select(F.col("conv_id").alias("document_id"), F.col("n").alias("pos"), F.col("x").alias("source_text"), F.lit("").alias("target_text")), "en", "fr")
    return made.select(F.col("document_id").cast("string").alias("path"), F.col("xml").cast("binary").alias("content"))


@query(f"""
SELECT conv_id, 'seg_' || n AS id, row_number() OVER (PARTITION BY conv_id ORDER BY n) - 1 AS pos, x AS text, false AS locked FROM {_TURNS_SQL} WHERE x <> ''
""")
def xliff_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of XLIFF files made from conversations."""
    s = exchange.parsed(_xliff(spark, sf_dir), exchange.xliff_segments, exchange.XLIFF)
    return s.select(F.col("path").cast("long").alias("conv_id"), "id", F.col("pos").cast("long"), "text", "locked")


@query(f"""
SELECT conv_id, string_agg('t ' || n || ': ' || x, '|' ORDER BY n) AS targets, 'seg_0' AS unmatched FROM {_TURNS_SQL} GROUP BY conv_id
""")
def xliff_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets written into XLIFF files by segment id, of repeated ids the last; ids that a file lacks are named."""
    t = _turns(spark, sf_dir)
    path = F.col("conv_id").cast("string").alias("path")
    id_ = F.concat(F.lit("seg_"), F.col("n")).alias("id")
    last = t.select(path, id_, (F.col("n") * 2).alias("pos"), F.concat(F.lit("t "), F.col("n"), F.lit(": "), F.col("x")).alias("text"))
    first = t.select(path, id_, (F.col("n") * 2 - 1).alias("pos"), F.lit("replaced").alias("text"))
    other = t.select(path, F.lit("seg_0").alias("id"), F.lit(0).alias("pos"), F.lit("nowhere").alias("text")).distinct()
    filled = writers.fill_xliff(_xliff(spark, sf_dir), last.unionByName(first).unionByName(other))
    held = F.xpath(F.col("content").cast("string"), F.lit("//*[local-name()='target']/text()"))
    return filled.select(F.col("path").cast("long").alias("conv_id"), F.array_join(held, "|").alias("targets"), F.array_join("unmatched", ",").alias("unmatched"))


def _docx(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    return writers.new_docx(t.select(F.col("conv_id").alias("document_id"), F.col("n").alias("pos"), F.col("x").alias("text"), F.lit("Normal").alias("style"), F.lit("left").alias("alignment")))


@query(f"""
WITH t AS (SELECT conv_id, n - 1 AS element, {_sentence_sql('x')} AS s FROM {_TURNS_SQL})
SELECT conv_id, element || '_' || i AS id, s[i + 1] AS text, 'Normal' AS style FROM (SELECT conv_id, element, s, unnest(range(0, len(s))) AS i FROM t)
""")
def docx_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence blocks of DOCX files made from conversations."""
    b = exchange.docx_blocks(exchange.parsed(_docx(spark, sf_dir), exchange.docx_paragraphs, exchange.DOCX))
    return b.select(F.col("path").cast("long").alias("conv_id"), "id", "text", "style")


@query(f"""
WITH t AS (SELECT conv_id, n - 1 AS element, x, {_sentence_sql('x')} AS s FROM {_TURNS_SQL})
SELECT conv_id, element, CASE WHEN len(s) = 0 THEN x ELSE array_to_string(list_transform(s, lambda y, i: CASE WHEN i % 2 = 1 THEN 'T ' || y || ' / 2' ELSE y END), ' ') END AS text FROM t
""")
def docx_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files scanned, every other sentence of a paragraph translated (in two parts) under the scanner's ids, written back and
    scanned again; what is not translated stays."""
    files = _docx(spark, sf_dir)
    b = exchange.docx_blocks(exchange.parsed(files, exchange.docx_paragraphs, exchange.DOCX)).where("i % 2 = 0")
    one = b.select("path", "id", F.lit(0).alias("pos"), F.concat(F.lit("T "), "text").alias("text"))
    two = b.select("path", "id", F.lit(1).alias("pos"), F.lit("/ 2").alias("text"))
    filled = writers.fill_docx(files, one.unionByName(two)).select("path", "content")
    p = exchange.parsed(filled, exchange.docx_paragraphs, exchange.DOCX)
    return p.select(F.col("path").cast("long").alias("conv_id"), F.col("element").cast("long"), "text")


@query("SELECT page_id, sha256(coalesce(html, '')) AS text_sha256 FROM pages")
def decoded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages in two encodings, decoded by the first that fits."""
    html = F.coalesce(F.col("html"), F.lit(""))
    p = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.when(F.col("page_id") % 2 == 0, F.encode(html, "UTF-8")).otherwise(F.encode(html, "UTF-16")).alias("content"))
    return exchange.decoded(p).select(F.col("path").cast("long").alias("page_id"), F.sha2("text", 256).alias("text_sha256"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CAST(2 AS BIGINT) AS n_objects, length(props) * 2 + 1 AS resume FROM events WHERE props IS NOT NULL")
def reply_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON in replies: the object in prose, and the objects of a reply that has not come to its end."""
    e = read(spark, sf_dir, "events").where("props is not null")
    held = tx.tolerant_json(F.concat(F.lit("Sure: "), F.col("props"), F.lit(" done")))
    arrived = replies.json_objects(F.concat("props", F.lit(","), "props", F.lit('{"open": "}')))
    return e.select("event_id", F.try_variant_get(held, "$.k", "int").alias("k"), arrived.alias("a")).select(
        "event_id", "k", F.size("a.objects").cast("long").alias("n_objects"), F.col("a.resume").cast("long").alias("resume")
    )


#: Every fifth document is held out of the language model.
_FOLDS, _HELD_OUT = 5, 3


def _languages_sql() -> str:
    """CTEs up to `told`(doc_id, detected): the model of the documents that aren't held out, and its choice for all of them."""
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    code = lambda k: f"CAST(unicode(t[i + {k}]) AS BIGINT)"
    return f"""
WITH tri AS (
  SELECT r, doc_id, lang, (961 * {code(0)} + 31 * {code(1)} + {code(2)}) % 4096 AS class
  FROM (SELECT row_number() OVER () AS r, doc_id, lang, {lowered} AS t, unnest(range(1, greatest(length(coalesce(text, '')) - 1, 1))) AS i FROM documents)
), bag AS (SELECT r, doc_id, lang, class, count(*) AS n FROM tri GROUP BY ALL
), seen AS (SELECT lang, class, sum(n) AS n FROM bag WHERE lang IS NOT NULL AND doc_id % {_FOLDS} <> {_HELD_OUT} GROUP BY ALL
), every AS (SELECT lang, sum(n) AS n FROM seen GROUP BY lang
), score AS (
  SELECT r, doc_id, every.lang, sum(bag.n * ln((coalesce(seen.n, 0) + 1) / CAST(every.n + 4096 AS DOUBLE))) AS s
  FROM bag CROSS JOIN every LEFT JOIN seen ON seen.lang = every.lang AND seen.class = bag.class GROUP BY r, doc_id, every.lang
), told AS (SELECT r, doc_id, first(lang ORDER BY s DESC, lang) AS detected FROM score GROUP BY r, doc_id)"""


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.trained(d.where(F.col("doc_id") % _FOLDS != _HELD_OUT))
    return language.detected(d, model)


@query(f"{_languages_sql()} SELECT d.doc_id, detected FROM documents d LEFT JOIN told ON told.doc_id = d.doc_id")
def detected_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a model that every fifth document is held out of."""
    return _detected(spark, sf_dir).select("doc_id", "detected")


@query(rf"""{_languages_sql()}
SELECT d.doc_id, lang, coalesce(detected = requested, false) AS matches, coalesce(regexp_matches(text, '[\p{{L}}\p{{N}}]'), false) AS has_text
FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE 'fr' END AS requested FROM documents) d LEFT JOIN told ON told.doc_id = d.doc_id
""")
def language_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document is in the language that is asked for, as detected, and has any text."""
    requested = F.when(F.col("doc_id") % 2 == 0, "en").otherwise("fr")
    has_text = F.coalesce(F.col("text").rlike(r"[\p{L}\p{N}]"), F.lit(False))
    return _detected(spark, sf_dir).select("doc_id", "lang", F.coalesce(F.col("detected") == requested, F.lit(False)).alias("matches"), has_text.alias("has_text"))


_WORD_LCS = """list_last(list_reduce(list_transform(a, lambda w: [w]), lambda prev, cur:
  list_reduce(list_transform(b, lambda w: [w]), lambda acc, x: list_append(acc, CASE WHEN cur[1] = x[1] THEN CAST(CAST(prev[len(acc)] AS INT) + 1 AS VARCHAR)
    ELSE CAST(greatest(CAST(prev[len(acc) + 1] AS INT), CAST(list_last(acc) AS INT)) AS VARCHAR) END), ['0']),
  list_transform(range(0, len(b) + 1), lambda z: '0')))"""


@query(rf"""
WITH p AS (SELECT conv_id, turn, coalesce(text, '') AS o, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS n FROM conversations),
t AS (SELECT *, regexp_extract_all(o, '\s+|\S+\s*') AS a, regexp_extract_all(n, '\s+|\S+\s*') AS b FROM p),
l AS (SELECT *, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE CAST({_WORD_LCS} AS BIGINT) END AS same FROM t)
SELECT conv_id, turn, same, len(a) - same AS removed, len(b) - same AS added, md5(o) AS old_md5, md5(n) AS new_md5 FROM l
""")
def word_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn and the next as two versions: words kept, removed and added by a shortest edit script, and both versions
    built again from it."""
    following = F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))
    d = read(spark, sf_dir, "conversations").select("conv_id", "turn", word_diff.word_diff(F.col("text"), following).alias("d"))
    of = lambda *kinds: F.array_join(F.transform(F.filter("d", lambda x: x["kind"].isin(*kinds)), lambda x: x["text"]), "")
    n = lambda kind: F.aggregate(F.filter("d", lambda x: x["kind"] == kind), F.lit(0).cast("long"), lambda s, x: s + x["words"])
    return d.select("conv_id", "turn", n("same").alias("same"), n("removed").alias("removed"), n("added").alias("added"), F.md5(of("same", "removed")).alias("old_md5"), F.md5(of("same", "added")).alias("new_md5"))


@query(f"""
WITH g AS (SELECT arg_min(id, id) AS id, arg_min(source_term, id) AS source_term, lower(source_term) AS k FROM {_WORDS_SQL} GROUP BY 3),
s AS (SELECT doc_id, lower(text) AS t, list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+|[؀-ۿݐ-ݿ]+')) AS w FROM documents),
h AS (SELECT doc_id, count(*) AS n FROM s, g WHERE CASE WHEN contains(k, ' ') THEN contains(t, k) ELSE list_contains(w, k) END GROUP BY 1)
SELECT documents.doc_id, coalesce(n, 0) AS n_terms FROM documents LEFT JOIN h ON documents.doc_id = h.doc_id
""")
def term_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many glossary terms each segment holds, 0 where there is none."""
    rows = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(s).alias("source_term"), F.lit(t).alias("target_term")) for i, (s, t) in enumerate(_WORDS)])
    g = spark.range(1).select(F.explode(rows).alias("g")).select("g.*")
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("segment_id"), "text")
    hits = glossary.hits_per_segment(d, g)
    return hits.select(F.col("segment_id").alias("doc_id"), "n_terms")
