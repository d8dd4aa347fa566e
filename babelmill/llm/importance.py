"""Operator 11, target-distribution importance resampling on hashed n-gram features.

A bucket's gain compares how common it is in the target texts and in the raw ones; a text's weight is the floored mean of
its features' gains; seeded Gumbel noise on the weights turns the highest scores into a draw without replacement.

Long texts are skewed work, so a text of more than CHUNK bytes is split at word boundaries into overlapping chunks: each
owns the words that start in its CHUNK bytes and carries the n - 1 words after them, so that a feature is counted where
its first word starts, once. Chunks are dealt by (row, chunk) to all tasks; shorter texts are one chunk and stay where
they are. Buckets of the features are stored once, by chunk; counts by bucket are added up in each task before they are
shuffled (at most N_BUCKETS rows a task), and chunk counts and gains are summed by document with a partial sum in each task.

Ranks need no global sort: counts by score (integers, fewer than some 100,000 values whatever the size of the table, as gains
are logarithms) give the number of documents above each score, and only documents of one score are numbered together.
Rows repeated as they are share a key and are summed as one with its number of copies, so no key is hot.

Defined cases: null and empty texts have no words, features 0 and weight 0; a null doc_id is seeded as an empty string and
comes after all others in ties; of rows of one doc_id and score the order is that of their row keys; repeated rows get
ranks of their own; a very long text is cut into chunks, one very long word belongs whole to the chunk it starts in; an
empty target gives gains from the raw counts alone, empty documents an empty result; `resampled` keeps other columns
whatever their names, `drawn` only uses doc_id and text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from babelmill.llm import textnum as tn
from babelmill.llm.common import column, row_key, stored, table, whole_row

#: Longest features in words, buckets, seed, share of the eligible documents in percent, words of an eligible document.
NGRAM, N_BUCKETS, SEED, PERCENT, LEAST_WORDS = 1, 10000, 2024, 10, 20
#: Bytes of a text whose words a chunk owns.
CHUNK = 1 << 16

#: CRC-32 of one byte (polynomial 0xEDB88320, reflected).
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & np.uint32(1), (_CRC >> np.uint32(1)) ^ np.uint32(0xEDB88320), _CRC >> np.uint32(1))
#: Bytes of a word that are fed column by column; longer words by zlib.
COLUMNS = 48
_ONES = np.uint32(0xFFFFFFFF)


def _step(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return _CRC[(state ^ np.uint32(byte) if isinstance(byte, int) else state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


def _feed(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes of each word."""
    n = ends - starts
    out, which = state.copy(), np.flatnonzero(n <= COLUMNS)
    for i in np.flatnonzero(n > COLUMNS):
        out[i] = np.uint32(zlib.crc32(data[starts[i] : ends[i]], int(state[i] ^ _ONES))) ^ _ONES
    at, left, now = starts[which], n[which], state[which]
    while len(which):
        if not (more := left > 0).all():
            out[which[~more]] = now[~more]
            which, at, left, now = which[more], at[more], left[more], now[more]
        now = _step(now, data[at])
        at, left = at + 1, left - 1
    return out


def feature_buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, stop: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and bucket of every run of 1 to n words; stop: for each word, the number of words up to its text's end."""
    words = np.arange(len(starts))
    firsts, found, state = [], [], np.full(len(words), _ONES, np.uint32)
    for k in range(n):
        live = words + k < stop
        words, stop, state = words[live], stop[live], state[live]
        if k:
            state = _step(state, 32)
        state = _feed(state, data, starts[words + k], ends[words + k])
        firsts.append(words)
        found.append((state ^ _ONES) % np.uint32(buckets))
    order = np.argsort(np.concatenate(firsts), kind="stable") if n > 1 else slice(None)
    return np.concatenate(firsts)[order], np.concatenate(found)[order].astype(np.int32)


CHUNKS = "row_id binary, doc_id long, part long, owned long, text string"


def _cut(n: int, size: int):
    """Chunks of long texts: row_id, doc_id, part, owned bytes, text from the first owned word to the last carried one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py().encode()
                data = np.frombuffer(text, np.uint8)
                starts, ends, _ = tn.word_spans(tn.LOWER[data], np.array([0, len(data)]), tn.ALNUM)
                rows: list[tuple[int, int, str]] = []
                # The first words of the chunks: the first one that starts in or after each stretch of size bytes.
                first = np.unique(np.searchsorted(starts, np.arange(0, len(data), size))) if len(starts) else np.zeros(0, np.int64)
                first = np.append(first[first < len(starts)], len(starts))
                for a, b in zip(first[:-1], first[1:], strict=True):
                    last = min(b + n - 1, len(starts))
                    at = int(starts[a])
                    rows.append((len(rows), (int(starts[b]) if b < len(starts) else len(data)) - at, text[at : int(ends[last - 1])].decode()))
                rows = rows or [(0, 0, "")]
                for some in (rows[j : j + 64] for j in range(0, len(rows), 64)):
                    part, owned, pieces = zip(*some, strict=True)
                    again = pa.array(np.full(len(some), i))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("row_id").take(again), batch.column("doc_id").take(again), pa.array(part, pa.int64()), pa.array(owned, pa.int64()), pa.array(pieces, pa.string())],
                        ["row_id", "doc_id", "part", "owned", "text"],
                    )

    return cut


def chunked(docs: DataFrame, n: int = NGRAM, size: int = CHUNK) -> DataFrame:
    """CHUNKS of docs(row_id, doc_id, text); owned: a chunk owns the words that start in so many of its bytes."""
    docs = docs.select("row_id", F.col("doc_id").cast("long").alias("doc_id"), "text")
    long = F.coalesce(F.octet_length("text") > size, F.lit(False))
    short = docs.where(~long).select("row_id", "doc_id", F.lit(0).cast("long").alias("part"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("owned"), F.coalesce("text", F.lit("")).alias("text"))
    return short.unionByName(docs.where(long).mapInArrow(_cut(n, size), CHUNKS).repartition("row_id", "part"))


FEATURES = "row_id binary, doc_id long, part long, n_words long, buckets array<int>"


def features(docs: DataFrame, n: int = NGRAM, buckets: int = N_BUCKETS, size: int = CHUNK) -> DataFrame:
    """FEATURES of every chunk of docs(row_id, doc_id, text): the words it owns and the buckets of features they start."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owned = batch.column("owned").to_numpy()
            for at, offsets, data in tn.chunks(batch.column("text")):
                starts, ends, first = tn.word_spans(data, offsets, tn.ALNUM)
                rows = len(offsets) - 1
                text = np.repeat(np.arange(rows), np.diff(first))
                own = starts < (offsets[:-1] + owned[at : at + rows])[text]
                words, found = feature_buckets(data, starts, ends, first[1:][text], n, buckets)
                kept = own[words]
                ends_at = np.concatenate([[0], np.cumsum(np.bincount(text[words[kept]], minlength=rows))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends_at), pa.array(found[kept]))
                part = batch.slice(at, rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row_id"), part.column("doc_id"), part.column("part"), pa.array(np.bincount(text[own], minlength=rows).astype(np.int64)), lists],
                    ["row_id", "doc_id", "part", "n_words", "buckets"],
                )

    return chunked(docs, n, size).mapInArrow(find, FEATURES)


def bucket_counts(found: DataFrame, buckets: int) -> DataFrame:
    """bucket, n of FEATURES: added up in each task, then over the tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("buckets").flatten(), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return found.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain of every bucket, from the counts of both sides."""
    spark = raw.sparkSession
    counts = spark.range(buckets).withColumnRenamed("id", "bucket")
    counts = counts.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    held = stored(counts, "importance-counts")
    n_raw, n_target = held.agg(F.sum("s"), F.sum("t")).first()
    ratio = (F.col("t") + 1.0) * (float(n_raw) + float(buckets)) / ((F.col("s") + 1.0) * (float(n_target) + float(buckets)))
    return held.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def gumbel(doc_id: Column, seed: int) -> Column:
    """Seeded Gumbel noise of a document in thousandths, floored."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


WEIGHTS = "row_id binary, doc_id long, part long, n_words long, n_features long, gain long"


def weighed(docs: DataFrame, target: DataFrame, n: int = NGRAM, buckets: int = N_BUCKETS, seed: int = SEED, size: int = CHUNK) -> DataFrame:
    """row_id, doc_id, copies, n_words, n_features, weight, score: one row for each distinct row of docs(row_id, doc_id, text)."""
    found = stored(features(docs, n, buckets, size), "importance-features")
    wanted = features(target.select(F.lit(b"").alias("row_id"), F.lit(None).cast("long").alias("doc_id"), "text"), n, buckets, size)
    held = gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets), buckets).collect()  # a number a bucket, whatever the data
    gain = np.zeros(buckets, np.int64)
    for r in held:
        gain[r["bucket"]] = r["gain"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            sums = np.concatenate([[0], np.cumsum(gain[lists.flatten().to_numpy()])])
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("row_id", "doc_id", "part", "n_words")], pa.array(np.diff(ends)), pa.array(np.diff(sums[ends]))],
                [x.split()[0] for x in WEIGHTS.split(", ")],
            )

    copies = F.sum((F.col("part") == 0).cast("long"))
    total = found.mapInArrow(weigh, WEIGHTS).groupBy("row_id", "doc_id").agg(
        copies.alias("copies"), F.sum("n_words").alias("n_words"), F.sum("n_features").alias("n_features"), F.sum("gain").alias("gain")
    )
    each = lambda c: F.expr(f"{c} div copies")  # noqa: E731  rows of one key are alike, so this is exact
    total = total.select("row_id", "doc_id", "copies", each("n_words").alias("n_words"), each("n_features").alias("n_features"), each("gain").alias("gain"))
    # Integers, rounded down also below zero.
    mean = F.expr("(gain - pmod(gain, n_features)) div n_features")
    total = total.withColumn("weight", F.when(F.col("n_features") > 0, mean).otherwise(F.lit(0)).cast("long")).drop("gain")
    return total.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def drawn(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of weighed(), stored, with `first`, the rank of the first of their copies that is drawn, and `taken`, how many
    copies are."""
    scored = stored(scored, "importance-scores")
    eligible = F.col("n_words") >= least_words
    by_score = scored.where(eligible).groupBy("score").agg(F.sum("copies").alias("n"))
    wanted = by_score.agg(F.expr(f"coalesce(sum(n), 0) * {percent} div 100")).first()[0]
    # A bounded number of rows: scores are sums of two logarithms in thousandths.
    above = F.sum("n").over(Window.orderBy(F.col("score").desc())) - F.col("n")
    cut = by_score.select("score", above.alias("above")).where(F.col("above") < wanted)
    marked = scored.join(F.broadcast(cut), "score", "left")
    in_score = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "row_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = marked.where(eligible & F.col("above").isNotNull()).withColumn("first", F.col("above") + F.sum("copies").over(in_score) - F.col("copies") + 1)
    near = near.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("copies"), F.lit(wanted) - F.col("first") + 1)).cast("long"))
    rest = marked.where(~eligible | F.col("above").isNull()).withColumn("first", F.lit(None).cast("long")).withColumn("taken", F.lit(0).cast("long"))
    return near.unionByName(rest).drop("above")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(row_key(docs).alias("row_id"), column("doc_id").cast("long").alias("doc_id"), column("text").alias("text"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, **options: int) -> DataFrame:
    """The rows of docs that are drawn, columns as they are."""
    found = drawn(weighed(keyed(docs), target, **options), percent, least_words).where("taken > 0").select("row_id", "copies", "taken")
    held = docs.select(row_key(docs).alias("row_id"), whole_row(docs).alias("row")).join(found, "row_id")
    single = held.where("copies = 1").select("row.*")
    # Rows repeated as they are: as many of them as are taken (aggregated in each task first).
    several = held.where("copies > 1").groupBy("row_id").agg(F.first("row").alias("row"), F.max("taken").alias("taken"))
    return single.unionByName(several.select("row", F.explode(F.expr("sequence(1, taken)"))).select("row.*"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drawn(weighed(keyed(docs), table(spark, sf_dir, "benchmark").select("text")))
    out = out.withColumn("i", F.explode(F.expr("sequence(1, copies)")))
    rank = F.when(F.col("i") <= F.col("taken"), F.col("first") + F.col("i") - 1)
    return out.select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"))


ORACLE = r"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256)))
), d AS (
  SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), u AS (SELECT r, unnest(w) AS f FROM d
), v AS (SELECT unnest(w) AS f FROM b
), x AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM u UNION SELECT f FROM v)
), k AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))),
         lambda c, y: xor(c // 256, t[xor(c, y) % 256 + 1])), 4294967295) % 10000 AS bucket FROM x, crc
), sc AS (SELECT bucket, count(*) AS s FROM u JOIN k ON u.f = k.f GROUP BY 1
), tc AS (SELECT bucket, count(*) AS t FROM v JOIN k ON v.f = k.f GROUP BY 1
), n AS (SELECT (SELECT count(*) FROM u) AS n_raw, (SELECT count(*) FROM v) AS n_target
), g AS (
  SELECT range AS bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (n_raw + 10000.0::DOUBLE)
         / ((coalesce(s, 0) + 1.0::DOUBLE) * (n_target + 10000.0::DOUBLE)))) AS BIGINT) AS gain
  FROM range(10000) LEFT JOIN sc ON sc.bucket = range LEFT JOIN tc ON tc.bucket = range, n
), m AS (
  SELECT r, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM u JOIN k ON u.f = k.f JOIN g ON g.bucket = k.bucket GROUP BY 1
), o AS (
  SELECT d.r, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
         (CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN m ON d.r = m.r
), p AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () * 10 // 100 AS wanted FROM o WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= wanted THEN CAST(rank AS BIGINT) END AS rank FROM o LEFT JOIN p ON o.r = p.r
"""
