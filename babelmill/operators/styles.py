"""Paragraph styles: what a style takes over from its parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from babelmill.operators.lineage import stored


def inherited(styles: DataFrame) -> DataFrame:
    """styles(id, parent, alignment) -> id, alignment: the style's own, else the nearest parent's, else null.

    Each round looks twice as far as the one before, so a chain of n styles takes log2(n) rounds. Styles that name each
    other and set nothing end as null: no chain without a repetition is longer than the table.
    """
    up = F.when(F.col("alignment").isNull() & (F.col("parent") != F.col("id")), F.col("parent"))
    w = stored(styles.select("id", up.alias("up"), "alignment"), "styles")
    for _ in range(w.count().bit_length()):
        if not w.where("up is not null").head(1):
            break
        s = w.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("alignment").alias("_alignment"))
        j = w.where("up is not null").join(s, "up", "left")
        found = j.select("id", F.when(F.col("_alignment").isNull(), F.col("_up")).alias("up"), F.col("_alignment").alias("alignment"))
        w = stored(w.where("up is null").unionByName(found), "styles")
    return w.select("id", "alignment")


def mirrored(alignment: Column) -> Column:
    """The alignment for a text that runs the other way: left, also unsaid, and right change places."""
    return F.when(alignment.isNull() | (alignment == "left"), "right").when(alignment == "right", "left").otherwise(alignment)
