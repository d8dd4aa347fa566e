"""Queries over the rules of a job's input, reviews, headers with entries, marked segments and growing glossaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from babelmill.functions import text as tx
from babelmill.operators import glossary, guards, jobs, layout, review
from babelmill.operators.styles import mirrored
from babelmill.plans.file_queries import _TURNS_SQL, _turns
from babelmill.plans.queries import _sentence_sql, query, read
from babelmill.sources import exchange, writers

_SHAPES = """CASE event_id % 4 WHEN 0 THEN '{"id": "' || event_id || '", "translated_text": "t"}' WHEN 1 THEN '{"translated_text": "t"}' WHEN 2 THEN '{"id": "' || event_id || '"}' ELSE '{}' END"""


@query("""
SELECT event_id, CASE WHEN event_id % 4 IN (1, 3) THEN 'translations[' || event_id || '] is missing required key(s) ''id''. Each entry must have both ''id'' and ''translated_text''.'
  WHEN event_id % 4 = 2 THEN 'translations[' || event_id || '] is missing required key(s) ''translated_text''. Each entry must have both ''id'' and ''translated_text''.' END AS error FROM events
""")
def translation_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the shape of given translations."""
    e = read(spark, sf_dir, "events").select("event_id", F.parse_json(F.expr(_SHAPES)).alias("item"))
    return e.select("event_id", guards.shape_error(F.col("item"), F.col("event_id")).alias("error"))


@query(f"""
SELECT conv_id, sum(CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS changed, '<review_results>' || chr(10) || string_agg(
  '  <segment id="0-' || n || '" changed="' || CASE WHEN n % 3 = 0 THEN 'true' ELSE 'false' END || '">' || chr(10) || '    <source>' || x || '</source>' || chr(10)
  || '    <original_translation>' || coalesce(y, '') || '</original_translation>' || chr(10) || '    <revised_translation>' || x || '</revised_translation>' || chr(10)
  || CASE WHEN n % 2 = 0 THEN '    <note>better ' || n || '</note>' || chr(10) ELSE '' END || '  </segment>' || chr(10), '' ORDER BY n) || '</review_results>' AS xml
FROM {_TURNS_SQL} GROUP BY conv_id
""")
def review_results_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of conversations as they are told to the assistant; every other segment has a note."""
    t = _turns(spark, sf_dir)
    rows = t.select(
        "conv_id", "n", F.concat(F.lit("0-"), "n").alias("id"), (F.col("n") % 3 == 0).alias("changed"), F.col("x").alias("source"),
        F.col("y").alias("original_translation"), F.col("x").alias("revised_translation"), F.when(F.col("n") % 2 == 0, F.concat(F.lit("better "), "n")).otherwise("").alias("note"),
    )
    return guards.review_results(rows, "conv_id", "n")


@query("""
WITH w AS (SELECT DISTINCT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 UNION SELECT -1),
h AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0),
e AS (SELECT o_custkey AS id, o_orderstatus AS s, arg_max(CAST(o_orderkey AS VARCHAR), o_orderkey) AS t FROM orders GROUP BY ALL)
SELECT w.id, h.id IS NOT NULL AS found, CASE WHEN h.id IS NOT NULL THEN coalesce(string_agg(s || '=' || t, ',' ORDER BY s), '') END AS terms
FROM w LEFT JOIN h ON w.id = h.id LEFT JOIN e ON w.id = e.id GROUP BY w.id, h.id
""")
def terms_of_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of headers by id: none at all where the header is missing, empty where it has no entries."""
    c, o = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), read(spark, sf_dir, "orders")
    wanted = o.select(F.col("o_custkey").alias("id")).union(c.where("id % 2 = 0")).union(spark.range(1).select((F.col("id") - 1).alias("id"))).distinct()
    entries = o.select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("source_term"), F.col("o_orderkey").cast("string").alias("target_term"), "o_orderkey")
    held = guards.terms_of(wanted, c.where("id % 3 <> 0"), entries, "id", "o_orderkey")
    said = F.array_join(F.transform(F.map_entries("terms"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return held.select("id", F.col("terms").isNotNull().alias("found"), F.when(F.col("terms").isNotNull(), said).alias("terms"))


@query("SELECT conv_id, list_transform(list(text ORDER BY turn), lambda x: coalesce(x, ''))[1:3] AS texts FROM conversations GROUP BY conv_id")
def renamed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first blocks of each conversation, under the name that the next step knows them by."""
    block = F.struct("turn", F.coalesce("text", F.lit("")).alias("original_text"), F.col("role").alias("type"))
    pages = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array(F.array_sort(F.collect_list(block))).alias("pages"))
    made = pages.select("conv_id", guards.renamed_blocks(F.col("pages"), "original_text", "text", ["type"]).alias("pages"))
    return made.select("conv_id", F.slice(F.transform(F.flatten("pages"), lambda b: b["text"]), 1, 3).alias("texts"))


@query("""
SELECT label AS run, iteration, avg(score) AS mean_score FROM (
  SELECT label, unnest([0, 1, 2]) AS iteration, unnest([vec_id % 101, vec_id % 53, vec_id % 7]) AS score FROM embeddings) GROUP BY ALL
""")
def iteration_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score of each iteration over the blocks of a run."""
    scores = F.array(*[(F.col("vec_id") % n) for n in (101, 53, 7)])
    e = read(spark, sf_dir, "embeddings").select(F.col("label").alias("run"), scores.alias("scores"))
    return guards.mean_by_iteration(e, "run", "scores").select("run", F.col("iteration"), "mean_score")


@query("""
SELECT p_partkey, p_name, p_type, 'ring' AS asked FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring')
UNION ALL SELECT p_partkey, p_name, p_type, 'blank' FROM part
""")
def term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term base searched for a word in either language, and for nothing, which shows all of it."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    of = lambda q, name: guards.searched_terms(p, q, "p_name", "p_type").withColumn("asked", F.lit(name))
    return of("RiNg", "ring").unionByName(of(" \t", "blank"))


@query(f"""
WITH t AS (SELECT conv_id, n, x, CASE WHEN n % 3 = 0 THEN [x || ' a', x || ' b'] ELSE [x] END AS s FROM {_TURNS_SQL} WHERE x <> ''),
m AS (SELECT conv_id, n, unnest(s) AS text, unnest(range(len(s))) AS i FROM t)
SELECT conv_id, 'u' || n AS unit_id, CASE WHEN n % 3 = 0 THEN n || '.' || i ELSE 'u' || n END AS id, row_number() OVER (PARTITION BY conv_id ORDER BY n, i) - 1 AS pos, text, n % 4 = 1 OR n % 5 = 2 AS locked FROM m
""")
def xliff_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XLIFF files with units that are divided into segments, and units that are not to be translated."""
    x = tx.escape_xml(F.col("x"))
    mark = lambda i, tail: F.concat(F.lit('<mrk mtype="seg" mid="'), F.col("n"), F.lit(f'.{i}">'), x, F.lit(f"{tail}</mrk>"))
    divided = F.when(F.col("n") % 3 == 0, F.concat(F.lit("<seg-source><g>"), mark(0, " a"), F.lit("</g> "), mark(1, " b"), F.lit("</seg-source>"))).otherwise("")
    state = F.when(F.col("n") % 4 == 1, ' translate="no"').otherwise("")
    signed = F.when(F.col("n") % 5 == 2, '<sdl:seg-defs><sdl:seg id="1" conf="ApprovedSignOff"/></sdl:seg-defs>').otherwise("")
    unit = F.concat(F.lit('<trans-unit id="u'), F.col("n"), F.lit('"'), state, F.lit("><source>"), x, F.lit("</source>"), divided, signed, F.lit("</trans-unit>"))
    head = '<xliff xmlns="urn:oasis:names:tc:xliff:document:1.2" xmlns:sdl="http://sdl.com/FileTypes/SdlXliff/1.0" version="1.2"><file><body>'
    held = _turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", unit.alias("u")))).alias("u"))
    content = F.concat(F.lit(head), F.array_join(F.transform("u", lambda u: u["u"]), ""), F.lit("</body></file></xliff>"))
    files = held.select(F.col("conv_id").cast("string").alias("path"), content.cast("binary").alias("content"))
    s = exchange.parsed(files, exchange.xliff_segments, exchange.XLIFF)
    return s.select(F.col("path").cast("long").alias("conv_id"), "unit_id", "id", F.col("pos").cast("long"), "text", "locked")


_ITEM_TERMS = """SELECT id, source_term FROM (SELECT item_id * 2 + i AS id, CASE i WHEN 0 THEN w[3] ELSE w[1] || ' ' || w[2] END AS source_term
  FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z]+') AS w, unnest([0, 1]) AS i FROM benchmark) WHERE len(w) >= 3)"""


@query(f"""
WITH t AS ({_ITEM_TERMS}), g AS (SELECT min(id) AS id, lower(source_term) AS k FROM t GROUP BY 2),
s AS (SELECT doc_id, lower(text) AS t, list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+|[؀-ۿݐ-ݿ]+')) AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS k FROM s)
SELECT doc_id, id FROM u JOIN g ON u.k = g.k WHERE NOT contains(g.k, ' ')
UNION ALL SELECT doc_id, id FROM s, g WHERE contains(g.k, ' ') AND contains(t, g.k)
""")
def benchmark_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A glossary that grows with the benchmark: words and two-word terms of its items, found in all documents."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    b = read(spark, sf_dir, "benchmark").select("item_id", words.alias("w")).where("size(w) >= 3")
    pick = lambda i, term: b.select((F.col("item_id") * 2 + i).alias("id"), term.alias("source_term"))
    g = pick(0, F.col("w")[2]).unionByName(pick(1, F.concat_ws(" ", F.col("w")[0], F.col("w")[1]))).withColumn("target_term", F.lit("t"))
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("segment_id"), "text")
    return glossary.terms_in_segments(d, g).select(F.col("segment_id").alias("doc_id"), "id")


@query("""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS page, l_partkey AS block, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS number
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem)
""")
def display_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of blocks over all pages of a document."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("page"), F.col("l_partkey").alias("block")).distinct()
    return review.display_numbers(lines, "l_orderkey", "page", "block")


_SCRIPTS = "CASE doc_id % 3 WHEN 0 THEN substr(coalesce(text, ''), 1, 20) || ' نص' WHEN 1 THEN coalesce(text, '') ELSE 'ARABIC?' END"


@query(f"SELECT doc_id, regexp_matches({_SCRIPTS}, '[؀-ۿ]') AS arabic, CASE WHEN regexp_matches({_SCRIPTS}, '[؀-ۿ]') THEN 'right' ELSE NULL END AS side FROM documents")
def arabic_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in Arabic script, and the side on which a paragraph of them begins that says nothing."""
    text = F.expr(_SCRIPTS)
    d = read(spark, sf_dir, "documents").select("doc_id", tx.is_arabic(text).alias("arabic"))
    return d.select("doc_id", "arabic", F.when(F.col("arabic"), mirrored(F.lit(None).cast("string"))).alias("side"))


@query(f"""
WITH t AS (SELECT conv_id, n, x, (['Heading1', 'Title', 'ListBullet', 'Caption', 'Normal'])[n % 5 + 1] AS style FROM {_TURNS_SQL} WHERE x <> '')
SELECT conv_id, n, style, CASE n % 5 WHEN 0 THEN 'Section-header' WHEN 1 THEN 'Title' WHEN 2 THEN 'List-item' WHEN 3 THEN 'Caption' ELSE CASE WHEN n % 2 = 0 THEN 'List-item' ELSE 'Text' END END AS type,
  CASE WHEN n % 3 = 0 THEN 'Arial' END AS font, CASE WHEN n % 2 = 0 THEN 10.5::DOUBLE END AS size, CASE n % 3 WHEN 0 THEN true WHEN 1 THEN false END AS bold, CASE WHEN n % 4 = 0 THEN 'FF0000' END AS color
FROM t WHERE len({_sentence_sql('x')}) > 0
""")
def docx_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block types and formats of DOCX paragraphs whose first run is blank and formatted otherwise."""
    n = F.col("n")
    names = F.array(*map(F.lit, ("Heading1", "Title", "ListBullet", "Caption", "Normal")))
    when = lambda c, xml: F.when(c, xml).otherwise("")
    run = F.concat(
        F.lit('<w:r><w:rPr><w:b/><w:sz w:val="99"/></w:rPr><w:t xml:space="preserve"> </w:t></w:r><w:r><w:rPr>'), when(n % 3 == 0, '<w:rFonts w:ascii="Arial"/><w:b/>'),
        when(n % 3 == 1, '<w:b w:val="0"/>'), when(n % 4 == 0, '<w:color w:val="FF0000"/>'), when(n % 4 == 1, '<w:color w:val="auto"/>'), when(n % 2 == 0, '<w:sz w:val="21"/>'),
        F.lit('</w:rPr><w:t xml:space="preserve">'), tx.escape_xml(F.col("x")), F.lit("</w:t></w:r>"),
    )
    numbered = when((n % 5 == 4) & (n % 2 == 0), '<w:numPr><w:numId w:val="1"/></w:numPr>')
    paragraph = F.concat(F.lit('<w:p><w:pPr><w:pStyle w:val="'), names[(n % 5).cast("int")], F.lit('"/>'), numbered, F.lit("</w:pPr>"), run, F.lit("</w:p>"))
    made = _turns(spark, sf_dir).groupBy(F.col("conv_id").alias("document_id")).agg(F.array_sort(F.collect_list(F.struct("n", paragraph.alias("p")))).alias("p"))
    files = writers.packed(made.select("document_id", F.array_join(F.transform("p", lambda p: p["p"]), "").alias("body"), F.lit(None).cast("string").alias("footer")))
    b = exchange.docx_blocks(exchange.parsed(files, exchange.docx_paragraphs, exchange.DOCX)).where("i = 0")
    return b.select(F.col("path").cast("long").alias("conv_id"), (F.col("element") + 1).cast("long").alias("n"), "style", "type", "font", "size", "bold", "color")


_CELLS = "[l_returnflag, CASE WHEN l_quantity > 25 THEN '  ' ELSE l_linestatus END, CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE CAST(l_partkey AS VARCHAR) END][1:2 + l_linenumber % 2]"


@query(f"""
WITH d AS (SELECT l_orderkey, list({_CELLS} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS data FROM lineitem GROUP BY 1),
r AS (SELECT l_orderkey, len(data) AS rows, list_max(list_transform(data, lambda x: len(x))) AS cols, unnest(data) AS cells, unnest(range(len(data))) AS row FROM d),
c AS (SELECT l_orderkey, rows, cols, row, unnest(cells) AS text, unnest(range(len(cells))) AS col FROM r)
SELECT l_orderkey AS page, 0 AS num, row, col, rows, cols, text FROM c WHERE trim(coalesce(text, '')) <> ''
""")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of orders as cells with their places; rows differ in length, and some cells are blank or missing."""
    cells = F.array("l_returnflag", F.when(F.col("l_quantity") > 25, "  ").otherwise(F.col("l_linestatus")), F.when(F.col("l_linenumber") % 2 != 0, F.col("l_partkey").cast("string")))
    cells = F.slice(cells, F.lit(1), (2 + F.col("l_linenumber") % 2).cast("int"))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", cells.alias("cells"))
    data = F.transform(F.array_sort(F.collect_list(order)), lambda x: x["cells"])
    tables = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(data.alias("data")).withColumn("num", F.lit(0))
    return layout.table_cells(tables)


_DIGEST = "md5(page_id || chr(31) || coalesce(url, chr(0)))"


@query(f"""
SELECT substr({_DIGEST}, 1, 8) || '-' || substr({_DIGEST}, 9, 4) || '-' || substr({_DIGEST}, 13, 4) || '-' || substr({_DIGEST}, 17, 4) || '-' || substr({_DIGEST}, 21, 12) AS job_id,
       'xliff' AS file_type, 'en' AS source_lang, 'ar' AS target_lang, url AS file_name, CAST(NULL AS VARCHAR) AS glossary_id, CAST(NULL AS VARCHAR) AS tm_id, 'u' || page_id % 7 AS user_id, 'running' AS status FROM pages
""")
def new_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job records of requests for all pages."""
    said = lambda name, value: F.lit(value).alias(name)
    requests = read(spark, sf_dir, "pages").select("page_id", "url", said("file_type", "xliff"), said("source_lang", "en"), said("target_lang", "ar"), F.col("url").alias("file_name"), F.concat(F.lit("u"), F.col("page_id") % 7).alias("user_id"))
    return jobs.new_jobs(requests, "page_id", "url")
