"""Queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from babelmill.llm import chat, decontamination, fim, importance, licenses, lm_scoring, mixing, near_dedup, quality, secrets, sharding, substrings, warc

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_lm_scoring": lm_scoring.op2_lm_scoring,
    "op3_warc": warc.op3_warc,
    "op4_mixing": mixing.op4_mixing,
    "op5_feistel_sharding": sharding.op5_feistel_sharding,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_chat_format": chat.op7_chat_format,
    "op10_secret_scan": secrets.op10_secret_scan,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op1_proximity": decontamination.op1_proximity,
    "op11_importance_resampling": importance.op11_importance_resampling,
    "op12_fill_in_middle": fim.op12_fill_in_middle,
    "op13_substring_dedup": substrings.op13_substring_dedup,
}

ORACLES: dict[str, str] = {
    "op1_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM win
), g AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)
), hit AS (SELECT g.doc_id, g.i, g.k, win.item_id FROM g JOIN win ON g.phrase = win.phrase AND g.k = win.k
), words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1
), items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
""",
    "op3_warc": """
WITH p AS (
  SELECT page_id, url, sha1(coalesce(html, '')) AS payload_digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes
  FROM pages
), g AS (
  SELECT payload_digest, max(page_id) AS first_id FROM p WHERE payload_bytes >= 1000 GROUP BY 1 HAVING count(*) > 1
)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to,
       url, CAST(NULL AS VARCHAR) AS error
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest
""",
    "op8_license_scan": licenses.oracle(),
    "op11_importance_resampling": importance.ORACLE,
    "op12_fill_in_middle": fim.ORACLE,
    "op13_substring_dedup": substrings.ORACLE,
    "op9_near_dedup": r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT r, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT r, count(*) AS n FROM s GROUP BY r
), p AS (SELECT a.r AS x, b.r AS y, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.r < b.r GROUP BY ALL
), l AS (SELECT x, y FROM p JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * i >= 80 * (nx.n + ny.n - i)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), reach AS (SELECT DISTINCT x AS r, x AS z FROM e UNION SELECT reach.r, e.y FROM reach JOIN e ON reach.z = e.x
), low AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.z GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
       coalesce(component_id, doc_id) IS NOT DISTINCT FROM doc_id AS kept
FROM d LEFT JOIN n ON d.r = n.r LEFT JOIN low ON d.r = low.r
""",
    "op7_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), r AS (
  SELECT *, '### ' || replace(replace(replace(role, '\', '\\'), ':', '\c'), chr(10), '\n') || ': ' AS head,
         regexp_replace(text, '(### [A-Za-z]+: |</turn>)', '\\\1', 'g') AS body,
         regexp_replace(text, '\\(### [A-Za-z]+: |</turn>)', '\1', 'g') AS plain FROM t
), f AS (
  SELECT *, head || CASE WHEN plain = text AND NOT contains(text || chr(10), chr(10) || '</turn>' || chr(10)) THEN text ELSE body END
            || chr(10) || '</turn>' || chr(10) AS formatted FROM r
), g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS all_turns,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS masked,
         string_agg(formatted, '' ORDER BY turn, role, text) AS formatted
  FROM f GROUP BY conv_id
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(all_turns) AS turns_sha256,
       CAST(length(masked) AS BIGINT) AS loss_chars, sha256(masked) AS loss_sha256,
       CAST(length(formatted) AS BIGINT) AS formatted_chars FROM g
""",
}
