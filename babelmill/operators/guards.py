"""Rules that a job's input must keep, and calls that are made at most so many at a time or once a text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Segments (pages of a PDF) of a job, calls at a time.
MOST_SEGMENTS, AT_ONCE = 200, 5


def shape_error(item: Column, position: Column) -> Column:
    """What is wrong with a translation given as a VARIANT object, null if nothing: it must have `id` and `translated_text`."""
    lacks = lambda name: F.try_variant_get(item, f"$.{name}", "variant").isNull()
    missing = F.when(lacks("id"), "id").when(lacks("translated_text"), "translated_text")
    said = F.concat(
        F.lit("translations["), position.cast("string"), F.lit("] is missing required key(s) '"), missing,
        F.lit("'. Each entry must have both 'id' and 'translated_text'."),
    )
    return F.when(missing.isNotNull(), said)


def checked_translations(rows: DataFrame, item: str = "item", position: str = "position") -> DataFrame:
    """rows with id and translated_text of each item; the query fails at an item without one of them."""
    wrong = shape_error(F.col(item), F.col(position))
    field = lambda name: F.when(wrong.isNotNull(), F.raise_error(wrong)).otherwise(F.try_variant_get(F.col(item), f"$.{name}", "string")).alias(name)
    return rows.select("*", field("id"), field("translated_text"))


def guarded(segments: DataFrame, key: str, most: int = MOST_SEGMENTS) -> DataFrame:
    """key, segments of every document; the query fails if one has more than `most`."""
    n = segments.groupBy(key).agg(F.count("*").alias("segments"))
    told = F.concat(F.lit("max segments exceeded: "), F.col("segments").cast("string"), F.lit(f" > {most}"))
    return n.select(key, F.when(F.col("segments") > most, F.raise_error(told)).otherwise(F.col("segments")).alias("segments"))


def in_language(documents: DataFrame, requested: str, found: str = "detected") -> DataFrame:
    """documents; the query fails at one whose detected language is not the one in column `requested`."""
    told = F.concat(F.lit("Detected source language '"), F.coalesce(found, F.lit("")), F.lit("' does not match provided source language '"), F.col(requested), F.lit("'."))
    return documents.withColumn(found, F.when(F.col(found).eqNullSafe(F.col(requested)), F.col(found)).otherwise(F.raise_error(told)))


def mean_by_iteration(blocks: DataFrame, key: str, scores: str) -> DataFrame:
    """key, iteration, mean_score over the blocks of a run; every block must have as many scores, else the query fails."""
    sizes = W.partitionBy(key)
    held = blocks.select(key, scores, F.size(scores).alias("_n")).withColumns({"_low": F.min("_n").over(sizes), "_high": F.max("_n").over(sizes)})
    told = F.concat(F.lit("blocks with "), F.col("_low").cast("string"), F.lit(" and "), F.col("_high").cast("string"), F.lit(" scores"))
    whole = F.when(F.col("_low") != F.col("_high"), F.raise_error(told)).otherwise(F.col(scores))
    return held.select(key, F.posexplode(whole).alias("iteration", "score")).groupBy(key, "iteration").agg(F.avg("score").alias("mean_score"))


def renamed_blocks(pages: Column, old: str, new: str, kept: list[str]) -> Column:
    """Pages of blocks (array<array<struct>>) with field `old` named `new`; `kept` are the other fields that stay."""
    return F.transform(pages, lambda page: F.transform(page, lambda b: F.struct(b[old].alias(new), *[b[f].alias(f) for f in kept])))


def review_results(rows: DataFrame, key: str, order: str) -> DataFrame:
    """key, changed, xml: the review of a document as it is told to the assistant, a note only where there is one; rows have id,
    changed, source, original_translation, revised_translation, note."""
    line = lambda name: F.concat(F.lit(f"    <{name}>"), F.coalesce(name, F.lit("")), F.lit(f"</{name}>\n"))
    note = F.when(F.coalesce("note", F.lit("")) != "", line("note")).otherwise("")
    changed = F.coalesce("changed", F.lit(False))
    one = F.concat(
        F.lit('  <segment id="'), F.col("id"), F.lit('" changed="'), changed.cast("string"), F.lit('">\n'),
        *[line(c) for c in ("source", "original_translation", "revised_translation")], note, F.lit("  </segment>\n"),
    )
    held = rows.groupBy(key).agg(F.count_if(changed).alias("changed"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), one.alias("x")))).alias("s"))
    return held.select(key, "changed", F.concat(F.lit("<review_results>\n"), F.array_join(F.transform("s", lambda x: x["x"]), ""), F.lit("</review_results>")).alias("xml"))


def terms_of(wanted: DataFrame, headers: DataFrame, entries: DataFrame, key: str, order: str) -> DataFrame:
    """key, terms: of each wanted header its map of source to target term, of equal source terms the last; an empty map without
    entries, null where the header is missing."""
    last = entries.groupBy(key, "source_term").agg(F.max_by("target_term", order).alias("target_term"))
    held = last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_term", "target_term")))).alias("_terms"))
    there = headers.select(key).distinct().withColumn("_there", F.lit(True))
    found = wanted.join(there, key, "left").join(held, key, "left")
    none = F.create_map().cast("map<string,string>")
    return found.select(key, F.when(F.col("_there"), F.coalesce("_terms", none)).alias("terms"))


def searched_terms(terms: DataFrame, query: str, *columns: str) -> DataFrame:
    """terms that hold the query in one of the columns, without regard to case, and a value in each; all for a blank query."""
    if not query.strip():
        return terms
    held = F.lit(False)
    for c in columns:
        held = held | F.contains(F.lower(c), F.lower(F.lit(query)))
        terms = terms.where(F.col(c).isNotNull())
    return terms.where(held)


def called(rows: DataFrame, call: Callable[[str], str], text: str = "text", result: str = "result", at_once: int = AT_ONCE) -> DataFrame:
    """rows with what call gives for each text, at most `at_once` calls at a time, whatever the size of the cluster.

    Each of so many tasks makes one call after the other. A call that fails gives an empty result, and the others go on.
    """

    def one(value: str | None) -> str:
        try:
            return call(value or "")
        except Exception:  # noqa: BLE001  whatever a provider raises
            return ""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{result: [one(None if pd.isna(v) else v) for v in frame[text]]})

    return rows.repartition(at_once).mapInPandas(run, rows.withColumn(result, F.lit("")).schema)


def memoised(rows: DataFrame, call: Callable[[str], str], text: str = "text", result: str = "result", at_once: int = AT_ONCE) -> DataFrame:
    """As called(), but a text that stands in many rows is called once."""
    once = called(rows.select(F.coalesce(text, F.lit("")).alias("_text")).distinct(), call, "_text", "_result", at_once)
    return rows.join(once, F.coalesce(rows[text], F.lit("")) == F.col("_text"), "left").select(*[rows[c] for c in rows.columns], F.col("_result").alias(result))
