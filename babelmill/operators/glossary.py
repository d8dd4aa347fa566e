"""Glossary: overriding extracted terms by the best glossary match, and terms found in segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from babelmill.functions.text import normalised_term

#: Rows, and bytes of texts, of a glossary that a broadcast may hold.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def side(df: DataFrame) -> DataFrame:
    """Broadcast below a checked number of rows and bytes, an ordinary join side beyond."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(sum(texts, F.lit(0)).cast("long")), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def first_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, aggregated map-side."""
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), order).alias("_r")).select("_r.*")


def substrings(text: Column, k: int) -> Column:
    """All substrings of k characters (the whole text if it is shorter)."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - k + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(k)))


def override_terms(terms: DataFrame, glossary: DataFrame, tenths: int = 9) -> DataFrame:
    """terms(pos, term, translation) x glossary(id, source_term, target_term): the translation of the closest glossary
    term of similarity tenths / 10 or more, ties to the earliest row; other terms keep theirs.

    Similarity is 1 - Levenshtein / longer length of normalised terms, compared in integers. Such terms share length
    bounds and, split in d + 1 pieces for the d edits allowed, one piece: candidates come from an equi-join on
    (length, piece number, piece), not from all pairs.
    """
    g = glossary.select("id", "target_term", normalised_term(F.col("source_term")).alias("g")).where("g <> ''")
    g = first_by_key(g, "g", "id")
    t = terms.withColumn("t", normalised_term(F.col("term")))
    n = F.length("g")
    edits = F.floor(F.lit((10 - tenths)) * F.greatest(n, F.floor(n * 10 / tenths)) / 10).cast("int")  # most edits any partner allows
    pieces = F.transform(
        F.sequence(F.lit(0), F.col("_d")),
        lambda i: F.struct(
            i.alias("i"), F.floor(i * n / (F.col("_d") + 1)).cast("int").alias("at"),
            F.substring(F.col("g"), F.floor(i * n / (F.col("_d") + 1)).cast("int") + 1, F.floor((i + 1) * n / (F.col("_d") + 1)).cast("int") - F.floor(i * n / (F.col("_d") + 1)).cast("int")).alias("piece"),
        ),
    )
    index = g.withColumn("_d", edits).withColumn("_p", F.explode(pieces)).select("id", "g", "target_term", F.col("_p.piece").alias("piece"))
    lengths = [r["n"] for r in index.select(F.length("piece").alias("n")).distinct().collect()]  # a few short lengths
    grams = F.flatten(F.array(*[substrings(F.col("t"), k) for k in sorted(lengths)])) if lengths else F.array().cast("array<string>")
    parts = t.where("t <> ''").select("pos", "t", F.explode(F.array_distinct(grams)).alias("piece"))
    longest = F.greatest(F.length("t"), F.length("g"))
    distance = F.levenshtein("t", "g")
    found = parts.join(side(index), "piece").where(distance * 10 <= longest * (10 - tenths))
    # Order by distance / longer length as a decimal: two that differ do so by more than its last place.
    exact = (distance.cast("decimal(9,0)") / longest.cast("decimal(9,0)")).cast("decimal(38,24)")
    found = found.select("pos", "id", "target_term", F.round(1 - distance / longest, 9).alias("similarity"), exact.alias("_far")).distinct()
    best = found.groupBy("pos").agg(F.min_by(F.struct("target_term", "similarity"), F.struct("_far", "id")).alias("b"))
    return t.join(best, "pos", "left").select("pos", "term", F.coalesce("b.target_term", "translation").alias("translation"), "b.similarity")


def terms_in_segments(segments: DataFrame, glossary: DataFrame) -> DataFrame:
    """segments(segment_id, text) x glossary(id, source_term, target_term) -> segment_id, id, source_term, target_term.

    A single word is found as a word of the segment (Latin letters, digits and ', or Arabic), a term with inner space
    as a substring, both without regard to case; of terms equal but for case the first counts.
    """
    g = glossary.where(F.col("source_term") != "").withColumn("k", F.lower("source_term"))
    g = first_by_key(g, "k", "id")
    s = segments.select("segment_id", F.lower("text").alias("_t"))
    several = F.contains(F.trim("k"), F.lit(" "))
    words = F.array_distinct(F.regexp_extract_all("_t", F.lit(r"([a-z0-9']+|[؀-ۿݐ-ݿ]+)"), F.lit(0)))
    single = s.select("segment_id", F.explode(words).alias("k")).join(side(g.where(~several)), "k").drop("k")
    # A term of several words begins at the end of some word of the segment: they meet under that end, of which there are
    # as many a word as the glossary's first words have lengths.
    multi = g.where(several).withColumn("_w", F.element_at(F.split(F.ltrim("k"), r"\s"), 1))
    lengths = sorted(r["n"] for r in multi.select(F.length("_w").alias("n")).distinct().collect())
    spaced = F.array_distinct(F.split("_t", r"\s+"))
    ends = lambda w, n: F.transform(F.filter(w, lambda x: F.length(x) >= n), lambda x: F.substring(x, -n, n))
    suffixes = F.flatten(F.array(*[ends(F.col("_s"), n) for n in lengths])) if lengths else F.array().cast("array<string>")
    held = s.select("segment_id", "_t", spaced.alias("_s")).select("segment_id", "_t", F.explode(F.array_distinct(suffixes)).alias("_w"))
    phrase = held.join(side(multi), "_w").where(F.contains(F.col("_t"), F.col("k"))).drop("_t", "_w", "k")
    return single.unionByName(phrase)


def hits_per_segment(segments: DataFrame, glossary: DataFrame) -> DataFrame:
    """segment_id, n_terms: how many terms each segment holds, 0 where there is none."""
    n = terms_in_segments(segments, glossary).groupBy("segment_id").agg(F.count("*").alias("n"))
    found = n.withColumnRenamed("segment_id", "_id")
    joined = segments.join(found, F.col("segment_id").eqNullSafe(F.col("_id")), "left")
    return joined.select("segment_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_terms"))
