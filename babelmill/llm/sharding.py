"""Operator 5, sharding [native]: a Feistel permutation of global row numbers gives each row its shard and slot.

Law `rows`: shard counts are at most one apart. With p the permuted row number, shard = p mod n_shards and slot =
p div n_shards, so any row's place can be computed from its number alone. Rows are numbered by buckets of a hash of all
their columns, then by a 128-bit key of them within a bucket; rows equal in all columns are interchangeable and are
numbered together from one counted row, so a hot document costs no more than a rare one until its rows are written.

Defined cases: null doc_id is a value like any other; null text has 8 bytes and the checksum 0 (of no bytes); repeated
rows each get a place of their own; a very long text is a row like any other, only its length and checksum are moved;
there are no ties, keys are distinct; an empty table gives an empty result; other columns only tell rows apart in
`places` and are kept by `shard_rows`, whatever their names and types, but that its own shard and slot replace theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from babelmill.llm.common import domain_bits, feistel, row_key, stored, table, whole_row

#: Rows a numbering bucket should hold, and rows of one repeated row that one task writes out.
BUCKET_ROWS, COPY_ROWS = 1 << 18, 1 << 14
MAX_BUCKETS = 1 << 16


def place(position: Column, n_shards: int) -> tuple[Column, Column]:
    """Shard and slot of a permuted row number."""
    return F.pmod(position, F.lit(n_shards)).cast("int"), F.floor(position / F.lit(n_shards)).cast("long")


def numbered(keys: DataFrame, cols: list[str]) -> tuple[DataFrame, int]:
    """Distinct rows of keys[cols], told apart by the first column, with n_rows and first_row: their run of global row
    numbers; and the number of rows."""
    counted = stored(keys.groupBy(*cols).agg(F.count("*").alias("n_rows")), "row-counts")
    total = counted.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    n_buckets = min(MAX_BUCKETS, max(64, 1 << (total // BUCKET_ROWS).bit_length()))
    bucketed = counted.withColumn("_bucket", F.pmod(F.xxhash64(cols[0]), F.lit(n_buckets)).cast("int"))
    # One row a bucket, MAX_BUCKETS at most: small enough for one task and for a broadcast.
    starts = (
        bucketed.groupBy("_bucket").agg(F.sum("n_rows").alias("_n"))
        .select("_bucket", (F.sum("_n").over(W.orderBy("_bucket")) - F.col("_n")).alias("_start"))
    )
    run = W.partitionBy("_bucket").orderBy(cols[0])
    within = bucketed.withColumn("_before", F.sum("n_rows").over(run) - F.col("n_rows"))
    out = within.join(F.broadcast(starts), "_bucket")
    return out.select(*cols, "n_rows", (F.col("_start") + F.col("_before")).alias("first_row")), total


def spread(runs: DataFrame) -> DataFrame:
    """One row for each row number of the runs: long runs are cut in pieces and dealt out before they are written."""
    cut = runs.withColumn(
        "_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_rows") - 1) / COPY_ROWS).cast("long")))
    )
    cut = cut.repartition(F.col("first_row"), F.col("_piece"))
    first = F.col("_piece") * COPY_ROWS
    last = F.least(F.col("n_rows"), first + COPY_ROWS) - 1
    return cut.withColumn("row_number", F.explode(F.sequence(F.col("first_row") + first, F.col("first_row") + last))).drop(
        "_piece", "n_rows", "first_row"
    )


def size_columns(text: Column) -> tuple[Column, Column]:
    filled = F.coalesce(text, F.lit(""))
    return (F.octet_length(filled) + 8).cast("long"), F.crc32(filled.cast("binary")).cast("long")


def places(docs: DataFrame, n_shards: int, seed: int = 20) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of docs; the places that shard_rows gives the same rows."""
    own = docs.drop("shard", "slot")
    size, crc = size_columns(F.col("text"))
    keys = own.select(row_key(own).alias("key"), "doc_id", size.alias("size"), crc.alias("text_crc32"))
    runs, total = numbered(keys, ["key", "doc_id", "size", "text_crc32"])
    shard, slot = place(F.col("position"), n_shards)
    return spread(runs).withColumn("position", feistel(F.col("row_number"), total, domain_bits(total), seed)).select(
        "doc_id", "size", "text_crc32", shard.alias("shard"), slot.alias("slot")
    )


def shard_rows(docs: DataFrame, n_shards: int, seed: int = 20) -> DataFrame:
    """docs with shard and slot: whole rows, ready for a writer that partitions by shard.

    Rows that are equal in all columns are interchangeable: one of them, found map-side first, stands for the others.
    """
    own = docs.drop("shard", "slot")
    held = own.select(row_key(own).alias("key"), whole_row(own).alias("row"))
    runs, total = numbered(held.select("key"), ["key"])
    one = held.join(runs.where("n_rows = 1").select("key", F.col("first_row").alias("row_number")), "key")
    many = runs.where("n_rows > 1")
    again = held.join(many.select("key"), "key", "left_semi").groupBy("key").agg(F.first("row").alias("row")).join(spread(many), "key")
    shard, slot = place(F.col("position"), n_shards)
    rows = one.unionByName(again).withColumn("position", feistel(F.col("row_number"), total, domain_bits(total), seed))
    return rows.select(*[F.col("row")[c].alias(c) for c in own.columns], shard.alias("shard"), slot.alias("slot"))


def op5_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(table(spark, sf_dir, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
