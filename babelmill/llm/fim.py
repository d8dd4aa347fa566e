"""Operator 12, fill-in-middle: texts cut at seeded unit boundaries and rewritten as prefix, suffix and middle.

The units of a text are the isolated matches of a regular expression, found by the tokenizers library's Split
pre-tokenizer, which needs no training and gives code-point offsets. The number of offsets is n; two seeded ranks among
the n + 1 boundaries are offsets where prefix and middle end. A text is given to the pre-tokenizer in blocks of BLOCK code
points, which bounds its memory: as units end at line ends only, a cut elsewhere adds one boundary, which is taken back.
Seeds depend on doc_id only, so a lost task gives the same rows again. `restore` rebuilds a text from what was written.

Defined cases: a null text is an empty one, and an empty text is plain with n 0; a null doc_id is seeded as an empty
string; a text with a sentinel in it stays plain, so the others can be read back without doubt; when both ranks are
equal the middle is empty; repeated rows, and rows of one doc_id and text, give equal rows; very long texts are cut
whole; an empty table gives an empty result; of other columns `transform` keeps all, whatever their names: its own come
in the struct `fim`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from babelmill.llm.common import column, fresh, table

#: Lines with their ends, the last one perhaps without.
UNITS = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_SHARE = 7, 100, 50
#: Code points that are given to the pre-tokenizer at once.
BLOCK = 1 << 18
#: Bytes of text a batch of results holds, beyond its last one.
BATCH = 8 << 20

FIM = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()),
])


def boundaries(text: str, split: Split) -> np.ndarray:
    """Code-point offsets of the boundaries before, between and after the units: one more than there are units."""
    ends = [0]
    for at in range(0, len(text), BLOCK):
        block = text[at : at + BLOCK]
        if at and text[at - 1] != "\n":
            ends.pop()  # the line goes on: the end of the block before was none of a unit
        ends.extend(at + end for _, (_, end) in split.pre_tokenize_str(block))
    return np.array(ends)


def cut(doc_id: int | None, text: str, split: Split, seed: int, rate: int, spm_share: int) -> tuple[int, str, int | None, int | None, str]:
    """The fields of FIM for one text."""
    ends = boundaries(text, split)
    n = len(ends) - 1
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((int(ends[h1 % (n + 1)]), int(ends[h2 % (n + 1)])))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h4 % 100 < spm_share:
        return n, "spm", low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE) -> DataFrame:
    """docs with a struct FIM (named `fim`, or `fim_` and so on where that is taken)."""
    name = fresh(docs, "fim")
    ids, texts = docs.columns.index(doc_id), docs.columns.index(text)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Split(Regex(UNITS), behavior="isolated")
        kind = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
        for batch in batches:
            first, held, size = 0, [], 0
            for i in range(batch.num_rows):
                held.append(cut(batch.column(ids)[i].as_py(), batch.column(texts)[i].as_py() or "", split, seed, rate, spm_share))
                size += len(held[-1][4])
                if size >= BATCH or i + 1 == batch.num_rows:
                    made = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), kind, strict=True)], fields=list(kind))
                    yield pa.RecordBatch.from_arrays([*batch.slice(first, len(held)).columns, made], [*batch.schema.names, name])
                    first, held, size = i + 1, [], 0

    return docs.mapInArrow(rewrite, T.StructType([*docs.schema.fields, T.StructField(name, FIM)]))


def restore(output: Column, form: Column) -> Column:
    """The text that was rewritten: of what is written only, without the cut's own lengths."""

    def between(start: str, end: str | None) -> Column:
        # Sentinels are in no rewritten text, so the first one found is the written one.
        at = F.instr(output, start) + len(start)
        return F.substring(output, at, F.length(output) if end is None else F.instr(output, end) - at)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select(
        column("doc_id").cast("long").alias("doc_id"), "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars",
        digest(F.col("fim.output")).alias("output_sha256"), digest(restore(F.col("fim.output"), F.col("fim.form"))).alias("restored_sha256"),
    )


ORACLE = r"""
WITH d AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), g AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d
), r AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM g
), c AS (
  SELECT *, array_to_string(u[1:low], '') AS prefix, array_to_string(u[low + 1:high], '') AS middle, array_to_string(u[high + 1:], '') AS suffix FROM r
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c
"""
