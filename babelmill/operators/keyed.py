"""Keyed merging: last wins, concatenation, upserts, replaced partitions, cascaded deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def first_wins(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(value, order).alias(value))


def concatenated(df: DataFrame, key: str | list[str], order: str, value: str, sep: str = " ") -> DataFrame:
    """Values of a key (a column or several) in order, joined."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return df.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["v"]), sep).alias(value))


def apply_updates(rows: DataFrame, updates: DataFrame, key: str, value: str) -> DataFrame:
    """rows with value taken from updates(key, value) where there is one."""
    u = updates.select(key, F.col(value).alias("_new"))
    return rows.join(u, key, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def unmatched(updates: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Keys of updates that no row has, in order."""
    return updates.where(F.col(key).isNotNull()).select(key).distinct().join(rows, key, "left_anti").orderBy(key)


def replace_partition(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys in `new` replaced by its rows."""
    return rows.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def cascade_delete(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return children.join(gone.select(key), key, "left_anti")


def shallow_merge(patches: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """The latest value that is there, field by field."""
    return patches.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields])


def any_true(flag: Column) -> Column:
    return F.coalesce(F.bool_or(flag), F.lit(False))
