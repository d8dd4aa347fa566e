"""Operator 4, mixing sources to target weights [native]: Sainte-Lague apportionment of equal-token blocks.

A source's documents are dealt to cells (source, shard) by a content hash; within a cell they are laid end to end in a
seeded order and cut into blocks of equal numbers of words (at most one word apart). Blocks are seats: they go first to
sources, then to the cells of each source, by the highest quotients target / (2 a + 1), never more than twice the
blocks there are. A cell with q seats over n blocks takes every block q div n times and a seeded cyclic run of q mod n
blocks once more. What a document gives is therefore arithmetic on its interval: no block is ever made a row. Repeated
rows are counted before they are laid out, as one run of their words, and dealt out again afterwards. A source has
MAX_SHARDS cells at most, so neither cells nor the documents of one grow without bound; sources are one row each.

Targets: the mix has `share` times all words, dealt by weight; a source stops at `most` times its words, and what it
leaves goes to the others by weight until none is above. That is the water level L with sum(min(cap, L * weight)) =
total, found on the sources ordered by cap / weight.

Defined cases: null text has no words and gives none; null source is a source and comes last; null doc_id is a value;
rows repeated in all columns lie side by side in a cell and are interchangeable; a very long text spans many blocks of
its cell; equal quotients go by source, then by shard; an empty table gives an empty result; other columns are kept by
`mix`, whatever their names and types, and ignored by `taken` (but that they tell rows apart).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from babelmill.llm.common import SPACE_WORD, column, fresh, row_key, stored, table, whole_row

BLOCK_WORDS, SHARD_WORDS, MAX_SHARDS = 128, 1 << 20, 1 << 16
#: Copies of one repeated row that one task writes out.
COPY_ROWS = 1 << 14
WEIGHTS = (5.0, 2.0, 1.0)


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size -> with weight and target. One row a source, so one task orders them (it can spill)."""
    order = W.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("weight", w).withColumn("_cap", F.col("source_size") * most)
    up = W.orderBy(F.col("_cap") / F.col("weight"), F.col("source").isNull(), "source")
    every = W.partitionBy(F.lit(1))
    s = s.withColumns({
        "_full": F.coalesce(F.sum("_cap").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
        "_rest": F.sum("weight").over(up.rowsBetween(0, W.unboundedFollowing)),
        "_total": F.sum("source_size").over(every) * share,
    })
    # The level if all before this source are full and none from it on; the first that holds,
    # which is the highest, is the level.
    level = (F.col("_total") - F.col("_full")) / F.col("_rest")
    s = s.withColumn("_level", F.max(F.when(level * F.col("weight") <= F.col("_cap"), level)).over(every))
    return s.select(
        "source", "source_size", "weight",
        F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("weight"), F.col("_cap"))).alias("target"),
    )


def apportion(units: DataFrame, group: list[str], name: list[str], votes: str, limit: str, seats: str) -> DataFrame:
    """Sainte-Lague: deals `seats` of each group to its units by the highest quotients votes / (2 a + 1), `limit` at most.

    With the level L at which all min(limit, L * votes) make up the seats, a unit first gets min(limit, L * votes rounded):
    that is what the highest quotients give but for a few seats, fewer than there are units. These are found among the
    quotients next to the rounded ones. How many of a unit's are looked at follows from its share; if one uses up all of
    them, more might be needed, and the search is made again four times as wide. Adds column `quota`.
    """
    g = W.partitionBy(*group) if group else W.partitionBy(F.lit(1))
    up = g.orderBy(F.when(F.col(votes) > 0, F.col(limit) / F.col(votes)).otherwise(float("inf")), *name)
    some = F.when(F.col(votes) > 0, F.col(limit)).otherwise(F.lit(0).cast("long"))
    u = units.withColumns({
        "_full": F.coalesce(F.sum(some).over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "_rest": F.sum(votes).over(up.rowsBetween(0, W.unboundedFollowing)),
    })
    level = F.when(F.col("_rest") > 0, (F.col(seats) - F.col("_full")) / F.col("_rest"))
    u = u.withColumn("_level", F.max(F.when(level * F.col(votes) <= F.col(limit), level)).over(g))
    # Without a level there are more seats than all limits allow: every unit with votes is full.
    share = F.when(F.col("_level").isNull(), some.cast("double")).otherwise(F.greatest(F.col("_level"), F.lit(0.0)) * F.col(votes))
    u = u.withColumn("_share", share).withColumn("_q", F.least(F.floor(F.col("_share") + 0.5), some).cast("long"))
    open_ = F.when(F.col("_q") < some, F.col(votes)).otherwise(0.0)
    u = u.withColumns({"_d": F.col(seats) - F.sum("_q").over(g), "_open": F.sum(open_).over(g), "_k": F.count("*").over(g)})
    keys = [*group, *name]
    u = stored(u.withColumn("_some", some).drop("_full", "_rest", "_level", "_share"), "mix-seats")
    wide = 1
    while True:
        gain = F.ceil(F.try_divide(F.col(votes) * (F.abs("_d") + F.col("_k")), F.col("_open"))) * wide + 1
        more = F.least(gain, F.abs("_d"), F.col("_some") - F.col("_q"))
        fewer = F.least(gain, F.abs("_d"), F.col("_q"))
        steps = F.coalesce(F.when(F.col("_d") > 0, more).when(F.col("_d") < 0, fewer).otherwise(0), F.lit(0)).cast("long")
        tried = u.withColumn("_steps", steps).where("_steps > 0")
        tried = tried.select(*keys, "_d", "_q", "_some", "_steps", votes, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_steps"))).alias("_i"))
        quotient = F.when(F.col("_d") > 0, -F.col(votes) / (2 * (F.col("_q") + F.col("_i") - 1) + 1)).otherwise(
            F.col(votes) / (2 * (F.col("_q") - F.col("_i")) + 1)
        )
        tie = [F.when(F.col("_d") > 0, F.col(c)).asc_nulls_last() for c in name] + [F.when(F.col("_d") < 0, F.col(c)).desc_nulls_first() for c in name]
        best = (W.partitionBy(*group) if group else W.partitionBy(F.lit(1))).orderBy(quotient, *tie)
        moved = (
            tried.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= F.abs("_d"))
            .groupBy(*keys).agg((F.count("*") * F.signum(F.first("_d"))).cast("long").alias("_moved"), F.first(F.struct("_d", "_q", "_some", "_steps")).alias("_was"))
        )
        moved = stored(moved, "mix-moved")
        was = F.col("_was")
        bound = F.least(F.abs(was["_d"]), F.when(was["_d"] > 0, was["_some"] - was["_q"]).otherwise(was["_q"]))
        if not moved.where((F.abs("_moved") == was["_steps"]) & (was["_steps"] < bound)).head(1):
            break
        wide *= 4
    m = moved.select(*[F.col(c).alias(f"_m_{c}") for c in keys], "_moved")
    on = None
    for c in keys:
        same = F.col(c).eqNullSafe(F.col(f"_m_{c}"))
        on = same if on is None else on & same
    joined = u.join(m, on, "left").withColumn("quota", F.col("_q") + F.coalesce("_moved", F.lit(0)))
    return joined.select(*units.columns, "quota")


def plan(docs: DataFrame, seed: int = 4, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """key, doc_id, source, size, source_size, target and the words taken: `whole` times all, and the spans [a0, a1) and
    [b0, b1) (word offsets in the document) once more; taken is their sum. One row a row of docs; key is row_key()."""
    size = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(SPACE_WORD), F.lit(0))).cast("long")
    d = docs.select(row_key(docs).alias("key"), "doc_id", "source", size.alias("size"))
    d = stored(d.groupBy("key", "doc_id", "source", "size").agg(F.count("*").alias("n_copies")), "mix-sizes")
    sources = d.groupBy("source").agg(F.sum(F.col("size") * F.col("n_copies")).alias("source_size"))
    targets = source_targets(sources, share=share, most=most)
    # Cells: as many shards a source as its words need; a hot source is cut like any other.
    shards = F.least(F.lit(MAX_SHARDS), F.floor(F.col("source_size") / SHARD_WORDS) + 1).cast("long")
    targets = stored(targets.withColumn("n_shards", shards), "mix-targets")
    t = targets.withColumnsRenamed({"source": "_source"})
    if targets.count() <= 100_000:  # a row a source; beyond that an ordinary join
        t = F.broadcast(t)
    d = d.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    d = d.withColumn("_deal", F.xxhash64("key", F.lit(seed)))
    d = d.withColumn("shard", F.pmod(F.col("_deal"), F.col("n_shards")))
    cells = (
        d.groupBy("source", "shard").agg(F.sum(F.col("size") * F.col("n_copies")).alias("cell_size"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
        .where("cell_size > 0")
        .withColumn("n_blocks", F.greatest(F.lit(1), F.round(F.col("cell_size") / BLOCK_WORDS)).cast("long"))
    )
    cells = stored(cells, "mix-cells")
    seats = (
        cells.groupBy("source").agg(F.sum("n_blocks").alias("_blocks"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
        .withColumn("votes", F.col("target") * F.col("_blocks") / F.col("source_size"))
        .withColumn("limit", F.floor(F.col("_blocks") * most).cast("long"))
        .withColumn("seats", F.round(F.sum("votes").over(W.partitionBy(F.lit(1)))).cast("long"))
    )
    quotas = apportion(seats, [], ["source"], "votes", "limit", "seats").select(F.col("source").alias("_source"), F.col("quota").alias("seats"))
    cells = cells.join(quotas, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # A cell's limit is rounded up: with one block, one and a half times it are not one time it. No document exceeds
    # `most` times its words by more than a block's run for that.
    cells = cells.withColumns({"votes": F.col("n_blocks").cast("double"), "limit": F.ceil(F.col("n_blocks") * most).cast("long")})
    cells = apportion(cells, ["source"], ["shard"], "votes", "limit", "seats")
    cells = cells.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "cell_size", "n_blocks", "quota")
    run = W.partitionBy("source", "shard").orderBy(F.xxhash64("_deal", F.lit(seed + 1)), "key")
    d = d.withColumn("_lo", F.sum(F.col("size") * F.col("n_copies")).over(run) - F.col("size") * F.col("n_copies"))
    d = d.join(cells, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")), "left")
    d = stored(d, "mix-places")
    one = d.where("n_copies = 1").withColumn("_copy", F.lit(0).cast("long"))
    many = d.where("n_copies > 1").withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_copies") - 1) / COPY_ROWS).cast("long"))))
    many = many.repartition("key", "_piece")
    copies = F.sequence(F.col("_piece") * COPY_ROWS, F.least(F.col("n_copies"), (F.col("_piece") + 1) * COPY_ROWS) - 1)
    d = one.unionByName(many.withColumn("_copy", F.explode(copies)).drop("_piece"))
    d = d.withColumn("_lo", F.col("_lo") + F.col("_copy") * F.col("size"))
    n, r = F.col("n_blocks"), F.pmod(F.col("quota"), F.col("n_blocks"))
    start = F.pmod(F.xxhash64("source", "shard", F.lit(seed + 2)), n)
    edge = lambda b: F.floor(b * F.col("cell_size") / n).cast("long")  # noqa: E731  first word of block b
    d = d.withColumns({"_r": r, "_start": start}).withColumns({
        "_a0": edge(F.col("_start")), "_a1": edge(F.least(F.col("_start") + F.col("_r"), n)),
        "_b1": edge(F.greatest(F.col("_start") + F.col("_r") - n, F.lit(0))),
    })
    lo, hi = F.col("_lo"), F.col("_lo") + F.col("size")
    clip = lambda x: F.least(F.greatest(x, lo), hi) - lo
    none = F.lit(0).cast("long")
    d = d.withColumns({
        "whole": F.coalesce(F.floor(F.col("quota") / n).cast("long"), none),
        "a0": F.coalesce(clip(F.col("_a0")), none), "a1": F.coalesce(clip(F.col("_a1")), none), "b0": none, "b1": F.coalesce(clip(F.col("_b1")), none),
    })
    taken = F.col("whole") * F.col("size") + F.col("a1") - F.col("a0") + F.col("b1") - F.col("b0")
    return d.withColumn("taken", taken).select(
        "key", "doc_id", "source", "size", "n_copies", "source_size", "target", "whole", "a0", "a1", "b0", "b1", "taken"
    )


def taken(docs: DataFrame, seed: int = 4) -> DataFrame:
    return plan(docs, seed).select("doc_id", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, seed: int = 4) -> DataFrame:
    """The mixed corpus, columns as docs: each document as often as it is taken, partial takes as the text of their words.

    n_chars, where there is one, is made to fit the text. Documents of which no word is taken are left out.
    """
    # Names that docs does not have. (Its columns keep theirs: renaming them beside a key made of them would let the
    # constraints that Catalyst infers double with each column.)
    key, take, piece, copies, row = (fresh(docs, x) for x in ("key", "take", "piece", "n_copies", "row"))
    takes = plan(docs, seed).where("taken > 0").select(F.col("key").alias(key), F.col("n_copies").alias(copies), F.struct("size", "whole", "a0", "a1", "b0", "b1").alias(take))
    takes = stored(takes, "mix-takes")
    held = docs.withColumn(key, row_key(docs))
    one = held.join(takes.where(F.col(copies) == 1).drop(copies), key)
    # One of the rows that are repeated, found map-side first, stands for all of them.
    many = takes.where(F.col(copies) > 1).drop(copies)
    again = held.join(many.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.first(whole_row(docs)).alias(row))
    t = one.unionByName(again.join(many, key).select(key, f"{row}.*", take))
    span = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    got, p = F.col(take), F.col(piece)
    zero, size = F.lit(0).cast("long"), got["size"]
    pieces = F.concat(
        F.array_repeat(span(zero, size), got["whole"].cast("int")),
        F.filter(F.array(span(got["b0"], got["b1"]), span(got["a0"], got["a1"])), lambda x: x["b"] > x["a"]),
    )
    t = t.withColumn(piece, F.explode(pieces))
    # Words with the white space after them: a span of them is the text as it stands there.
    words = F.regexp_extract_all("text", F.lit(SPACE_WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    part = F.array_join(F.slice(words, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")), "")
    t = t.withColumn("text", F.when(p["b"] - p["a"] == size, F.col("text")).otherwise(part))
    if "n_chars" in docs.columns:
        t = t.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return t.select(*[column(c) for c in docs.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
