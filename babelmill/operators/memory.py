"""Translation-memory search: for each query segment the k most similar memory entries, as a metric join.

The score is 200 * LCS / (n + m); the indel distance behind it, n + m - 2 * LCS, is a metric. Entries of one key (the text,
or its sorted tokens) are one key with its k first entries. Keys are dealt by their nearest pivot and a band of lengths into
cells, and cells are cut into blocks of bounded size; a cell knows the ranges of its lengths and of its distances to all
pivots. What bounds the distance of a query and a key from below, and so their score from above:

* the triangle inequality over each pivot, |d(q, p) - d(e, p)|, for whole cells and then for single keys;
* the difference of the bags of characters, and of the lengths.

Queries first meet the blocks of their best cell, which gives a score to beat; then those of every cell that can reach
it. Only pairs that pass all bounds are compared, many at once (functions/lcs.py). The join's keys are (cell, group of
blocks), so a large cell is dealt to many tasks; nothing that grows is collected or broadcast: pivots and cells are
bounded by PIVOTS and the number of length bands. A memory whose distinct keys are one block, checked before, needs none of
this: its keys go to the tasks of the queries.

hits() needs no entries, only how many there are up to k and the best score. Queries first meet the key that is equal and a
few with the same first or last characters; a query with k entries then looks only for a better score than its best one,
and one with k entries and a score of 100 for nothing. The others meet all keys, without pivots, and a task raises what
a key has to reach as it finds them.

Defined cases: a null or blank query matches nothing, a null memory text neither; equal scores by position; rows repeated
in the memory are entries of their own; queries of one id are searched one by one and ranked together.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from babelmill.functions.lcs import Columns, Texts, lcs_lengths
from babelmill.operators.lineage import stored

#: Pivots, the most characters of one, classes of characters in a bag.
PIVOTS, PIVOT_CHARS, CLASSES = 8, 256, 64
#: Keys in a block, blocks in a group, queries that meet a block together, factor between bands of lengths.
BLOCK, GROUP, TOGETHER, BAND = 1024, 32, 256, 1.25
#: Characters of keys that may be sent to every task, where all keys are one block, or stand side by side in hits().
BLOCK_CHARS = 1 << 20
#: Characters at either end of a key by which hits() finds near ones first, and how many of an end.
ENDS, NEAR = 12, 32


def _sorted_tokens(text: str) -> str:
    return " ".join(sorted(text.split()))


def keyed(memory: DataFrame, mode: str, k: int) -> DataFrame:
    """key_id, key, first, held: each distinct key of memory(position, source_text, target_text) with its k first entries."""
    make = _sorted_tokens if mode == "token" else str

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([make(t) for t in batch.column("source_text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, "key"])

    rows = memory.select(F.col("position").cast("long").alias("position"), F.col("source_text").cast("string").alias("source_text"), F.col("target_text").cast("string").alias("target_text"))
    rows = rows.where("source_text is not null").mapInArrow(keys, "position long, source_text string, target_text string, key string")
    # Cut to k in each task before the shuffle, so a text that is repeated very often is no hot key.
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("key").orderBy("position"))).where(F.col("_n") <= k)
    found = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("position", "source_text", "target_text"))).alias("held"))
    return stored(found.select("key", F.col("held")[0]["position"].alias("first"), "held", F.monotonically_increasing_id().alias("key_id")), "memory-keys")


def checked(mode: str, k: int) -> None:
    if mode not in ("token", "char") or not 1 <= k <= 20:
        raise ValueError("mode is token or char, k from 1 to 20")


def query_keys(queries: DataFrame, mode: str) -> DataFrame:
    """query_id, key: of queries(query_id, text), without null and blank ones."""
    make = _sorted_tokens if mode == "token" else str

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            kept = pa.array([i for i, t in enumerate(texts) if t and t.strip()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(kept), pa.array([make(texts[i]) for i in kept.to_pylist()], pa.string())], ["query_id", "key"])

    rows = queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(keys_of, "query_id string, key string")


def pivots_of(keys: DataFrame) -> list[str]:
    """A few keys, the same at every run: the least hashes. Their number and lengths are bounded."""
    short = keys.where(F.length("key").between(1, PIVOT_CHARS))
    return [r["key"] for r in short.orderBy(F.xxhash64("key"), "key").select("key").limit(PIVOTS).collect()]


def distances(texts: Texts, pivots: Texts) -> np.ndarray:
    """Indel distances, one row a text and one column a pivot."""
    n, p = len(texts), len(pivots)
    of, to = np.divmod(np.arange(n * p), max(p, 1))
    return (texts.lengths[of] + pivots.lengths[to] - 2 * lcs_lengths(pivots, texts, to, of)).reshape(n, p)


def band(lengths: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(lengths, 1)) / math.log(BAND)).astype(np.int64)


def nearest(texts: Texts, pivots: Texts, far: np.ndarray) -> np.ndarray:
    if not len(pivots):
        return np.zeros(len(texts), np.int64)
    return np.argmin(far / np.maximum(texts.lengths[:, None] + pivots.lengths[None, :], 1), axis=1)


def described(rows: DataFrame, pivots: list[str], ids: str) -> DataFrame:
    """rows with n, cell and the distances to the pivots of their key; ids: the schema of the columns that are kept."""
    names = [x.split()[0] for x in ids.split(", ")]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Texts(pivots)
        for batch in batches:
            texts = Texts(batch.column("key").to_pylist())
            far = distances(texts, held)
            cell = nearest(texts, held, far) * 1000 + band(texts.lengths)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * far.shape[1]), pa.array(far.reshape(-1).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(texts.lengths), pa.array(cell), lists], [*names, "n", "cell", "far"])

    return rows.select(names).mapInArrow(describe, f"{ids}, n long, cell long, far array<int>")


BLOCKS = "cell long, block long, ids array<long>, firsts array<long>, keys array<string>, far array<int>"


def blocks_of(keys: DataFrame, pivots: list[str]) -> DataFrame:
    """BLOCKS: keys of one cell, at most BLOCK of them, near ones together."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            at = 0
            while at < len(cell):
                stop = min(at + int(np.searchsorted(cell[at:], cell[at], "right")), at + BLOCK)
                part = batch.slice(at, stop - at)
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                number = int(part.column("key_id")[0].as_py())  # a key is in one block, so its id names the block
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(cell[at])]), pa.array([number]), one(part.column("key_id")), one(part.column("first")), one(part.column("key")), one(part.column("far").flatten())],
                    [x.split()[0] for x in BLOCKS.split(", ")],
                )
                at = stop

    found = stored(described(keys, pivots, "key_id long, first long, key string"), "memory-described")
    # Dealt by ranges, so that a cell with very many keys is cut among tasks.
    order = ["cell", "n", *([F.col("far")[0]] if pivots else []), "key_id"]
    return found.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, BLOCKS)


def cells_of(blocks: DataFrame, n_pivots: int) -> DataFrame:
    """cell, n_blocks, ranges of the lengths and of the distances: a bounded number of rows."""

    def column_of(p: int) -> Column:
        return F.filter("far", lambda x, i: i % n_pivots == p).alias(f"f{p}")

    lengths = F.transform("keys", lambda x: F.length(x))
    each = blocks.select("cell", F.array_min(lengths).alias("low"), F.array_max(lengths).alias("high"), *[column_of(p) for p in range(n_pivots)])
    ends = [y for p in range(n_pivots) for y in (F.min(F.array_min(f"f{p}")).alias(f"near{p}"), F.max(F.array_max(f"f{p}")).alias(f"far{p}"))]
    return each.groupBy("cell").agg(F.count("*").alias("n_blocks"), F.min("low").alias("low"), F.max("high").alias("high"), *ends)


ASKED = "asked long, query_id string, key string, far array<int>, cell long, most double, best boolean"


def reachable(asked: DataFrame, cells: list[dict], n_pivots: int, min_score: float) -> DataFrame:
    """ASKED: each query with every cell that can hold a key of min_score or more, the most that it can reach there, and whether
    that is the cell where it can reach most."""
    number, low, high = (np.array([c[x] for c in cells], np.int64) for x in ("cell", "low", "high"))
    near = np.array([[c[f"near{p}"] for p in range(n_pivots)] for c in cells], np.int64).reshape(len(cells), n_pivots)
    far = np.array([[c[f"far{p}"] for p in range(n_pivots)] for c in cells], np.int64).reshape(len(cells), n_pivots)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n = len(batch.column("key")[i].as_py())
                mine = np.array(batch.column("far")[i].as_py(), np.int64)
                least = np.maximum(np.maximum(mine - far, near - mine), 0).max(axis=1, initial=0)
                close = np.clip(n, low, high)
                least_sum = n + high
                most = np.minimum(100.0 * (least_sum - least) / np.maximum(least_sum, 1), 200.0 * np.minimum(n, close) / np.maximum(n + close, 1))
                some = np.flatnonzero(most + 1e-6 >= min_score)
                best = np.zeros(len(some), bool)
                if len(some):
                    best[np.argmax(most[some])] = True
                again = pa.array(np.full(len(some), i))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(again) for c in ("asked", "query_id", "key", "far")], pa.array(number[some]), pa.array(most[some]), pa.array(best)], [x.split()[0] for x in ASKED.split(", ")])

    return asked.select("asked", "query_id", "key", "far").mapInArrow(reach, ASKED)


MET = "asked long, query_id string, key_id long, first long, score double, compared long"


def best_of(asked: list[int], query_ids: list[str], mine: Texts, least: np.ndarray, texts: Texts, ids: np.ndarray, firsts: np.ndarray, gap: np.ndarray, k: int, counted: bool) -> pa.RecordBatch:
    """MET: of a block's keys the k best of each query that reach its least score, where gap bounds their distances from
    below; rows without a key tell how many were compared, if they are counted."""
    score = lambda lcs, n: np.where(n > 0, 200.0 * lcs / np.maximum(n, 1), 100.0)
    sums = mine.lengths[:, None] + texts.lengths[None, :]
    q, e = np.nonzero(score((sums - gap) // 2, sums) >= least[:, None])
    bags, wanted, fits = texts.bags(CLASSES), mine.bags(CLASSES), np.ones(len(q), bool)
    for at in range(0, len(q), 1 << 16):  # characters in common bound the subsequence
        some = slice(at, at + (1 << 16))
        fits[some] = score(np.minimum(wanted[q[some]], bags[e[some]]).sum(axis=1), sums[q[some], e[some]]) >= least[q[some]]
    q, e = q[fits], e[fits]
    got = score(lcs_lengths(mine, texts, q, e), sums[q, e])
    compared = np.bincount(q, minlength=len(asked))
    enough = got >= least[q]
    q, e, got = q[enough], e[enough], got[enough]
    order = np.lexsort((firsts[e], -got, q))
    q, e, got = q[order], e[order], got[order]
    first = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
    q, e, got = q[first], e[first], got[first]
    out = [(asked[i], query_ids[i], int(ids[j]), int(firsts[j]), float(s), None) for i, j, s in zip(q.tolist(), e.tolist(), got.tolist(), strict=True)]
    if counted:
        out += [(asked[i], query_ids[i], None, None, None, int(n)) for i, n in enumerate(compared)]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
    columns = zip(*out, strict=True) if out else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in MET.split(", ")])


def _meet(k: int, n_pivots: int, counted: bool):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                of = lambda c: batch.column(c)[row].values  # noqa: B023, E731
                texts, queries = Texts(of("keys").to_pylist()), of("queries")
                asked, query_ids, least = (queries.field(f).to_pylist() for f in ("asked", "query_id", "least"))
                mine = Texts(queries.field("key").to_pylist())
                gap = np.abs(mine.lengths[:, None] - texts.lengths[None, :])
                if n_pivots:
                    theirs = of("far").to_numpy().reshape(-1, n_pivots).astype(np.int64)
                    for p, far in enumerate(np.array(queries.field("far").to_pylist(), np.int64).reshape(-1, n_pivots).T):
                        np.maximum(gap, np.abs(far[:, None] - theirs[None, :, p]), out=gap)
                yield best_of(asked, query_ids, mine, np.array(least), texts, of("ids").to_numpy(), of("firsts").to_numpy(), gap, k, counted)

    return meet


def met_at_once(asked: DataFrame, keys: list, k: int, min_score: float, counted: bool) -> DataFrame:
    """MET of the queries in asked(asked, query_id, key) and keys(key_id, first, key) that are one block: sent to every task."""
    ids, firsts, spelled = np.array([r["key_id"] for r in keys], np.int64), np.array([r["first"] for r in keys], np.int64), [r["key"] for r in keys]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = Texts(spelled)
        for batch in batches:
            for part in (batch.slice(i, TOGETHER) for i in range(0, batch.num_rows, TOGETHER)):
                mine = Texts(part.column("key").to_pylist())
                gap = np.abs(mine.lengths[:, None] - texts.lengths[None, :])
                yield best_of(part.column("asked").to_pylist(), part.column("query_id").to_pylist(), mine, np.full(len(mine), min_score), texts, ids, firsts, gap, k, counted)

    return asked.select("asked", "query_id", "key").mapInArrow(meet, MET)


def met(asked: DataFrame, blocks: DataFrame, cells: DataFrame, k: int, n_pivots: int, counted: bool) -> DataFrame:
    """MET of the queries in asked(ASKED, least) and the blocks of their cells."""
    groups = F.greatest(F.lit(1), F.ceil(F.col("n_blocks") / GROUP)).cast("long").alias("groups")
    n_queries = asked.groupBy("cell").agg(F.ceil(F.count("*") / TOGETHER).cast("long").alias("parts"))
    sizes = cells.select("cell", groups).join(n_queries, "cell")  # a bounded number of rows
    together = asked.join(F.broadcast(sizes), "cell").groupBy("cell", "groups", F.pmod(F.xxhash64("asked"), F.col("parts")).alias("_part")).agg(
        F.collect_list(F.struct("asked", "query_id", "key", "far", "least")).alias("queries")
    )
    together = together.select("cell", "queries", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group"))
    dealt = blocks.join(F.broadcast(cells.select("cell", groups)), "cell").withColumn("group", F.pmod(F.xxhash64("block"), F.col("groups")))
    # As many tasks as shuffles have, though the rows are few: the work is in comparing them.
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = dealt.repartition(tasks, "cell", "group").join(together, ["cell", "group"]).select("ids", "firsts", "keys", blocks["far"], "queries")
    return pairs.mapInArrow(_meet(k, n_pivots, counted), MET)


def search_memory(queries: DataFrame, memory: DataFrame, mode: str = "token", k: int = 5, min_score: float = 60.0) -> DataFrame:
    """queries(query_id, text) x memory(position, source_text, target_text) -> query_id, position, source_text, target_text,
    score and rank; ties by position.

    mode "char" compares texts as they are, "token" their sorted tokens.
    """
    return _search(queries, memory, mode, k, min_score, False)[0]


def comparisons(queries: DataFrame, memory: DataFrame, mode: str = "token", k: int = 5, min_score: float = 60.0) -> DataFrame:
    """query_id, compared: how many distinct keys of the memory each query was compared with beyond the bounds."""
    return _search(queries, memory, mode, k, min_score, True)[1]


def _search(queries: DataFrame, memory: DataFrame, mode: str, k: int, min_score: float, counted: bool) -> tuple[DataFrame, DataFrame]:
    checked(mode, k)
    keys = keyed(memory, mode, k)
    asked = query_keys(queries, mode)
    asked = asked.withColumn("asked", F.monotonically_increasing_id())
    entries = keys.select("key_id", "held")

    def ranked(found: DataFrame, by: str) -> DataFrame:
        n = F.row_number().over(W.partitionBy(by).orderBy(F.desc("score"), "first"))
        found = found.where("key_id is not null").withColumn("_n", n).where(F.col("_n") <= k).drop("_n")
        found = found.join(entries, "key_id").select("asked", "query_id", "score", F.explode("held").alias("e")).select("asked", "query_id", "score", "e.*")
        return found.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc("score"), "position"))).where(F.col("rank") <= k)

    few = keys.select("key_id", "first", "key").limit(BLOCK + 1).agg(F.count("*"), F.coalesce(F.sum(F.length("key")), F.lit(0))).first()
    if few[0] <= BLOCK and few[1] <= BLOCK_CHARS:
        both = met_at_once(asked, keys.select("key_id", "first", "key").collect(), k, float(min_score), counted)
    else:
        both = _in_cells(asked, keys, ranked, k, float(min_score), counted)
    out = ranked(both, "query_id").select("query_id", "position", "source_text", "target_text", F.round("score", 6).alias("score"), "rank")
    return out, both.where("compared is not null").groupBy("query_id").agg(F.sum("compared").alias("compared"))


def _in_cells(asked: DataFrame, keys: DataFrame, ranked: Callable[[DataFrame, str], DataFrame], k: int, min_score: float, counted: bool) -> DataFrame:
    """MET of all queries: their best cells first, then every cell that can reach the score of the k-th entry found there."""
    pivots = pivots_of(keys)
    blocks = stored(blocks_of(keys, pivots), "memory-blocks")
    held = cells_of(blocks, len(pivots)).collect()  # bounded: pivots times bands
    cells = asked.sparkSession.createDataFrame([(r["cell"], r["n_blocks"]) for r in held], "cell long, n_blocks long")
    asked = described(asked, pivots, "asked long, query_id string, key string").drop("cell", "n")
    asked = stored(reachable(asked, [r.asDict() for r in held], len(pivots), min_score), "memory-reach")
    first = stored(met(asked.where("best").withColumn("least", F.lit(min_score)), blocks, cells, k, len(pivots), counted), "memory-first")
    beat = ranked(first, "asked").where(F.col("rank") == k).select("asked", F.col("score").alias("beat"))
    rest = asked.where("not best").join(beat, "asked", "left").withColumn("least", F.coalesce("beat", F.lit(min_score))).where(F.col("most") + 1e-6 >= F.col("least"))
    return first.unionByName(stored(met(rest, blocks, cells, k, len(pivots), counted), "memory-second"))


def counted(memory: DataFrame, mode: str, k: int) -> DataFrame:
    """key, n, copies: each distinct key of memory(source_text), its length and the number of its entries, k at most."""

    def sorted_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_sorted_tokens(t) for t in batch.column("key").to_pylist()], pa.string())], ["key"])

    rows = memory.select(F.col("source_text").cast("string").alias("key")).where("key is not null")
    rows = rows.mapInArrow(sorted_keys, "key string") if mode == "token" else rows
    found = rows.groupBy("key").agg(F.least(F.count("*"), F.lit(k)).alias("copies"))
    return stored(found.select("key", F.length("key").cast("long").alias("n"), "copies"), "memory-counted")


def near(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """asked, wanted, key, copies: each query of asked(asked, key) with the key that equals it and at most NEAR that share an end."""
    ends = lambda c: F.explode(F.array(F.concat(F.lit("<"), F.substring(c, 1, ENDS)), F.concat(F.lit(">"), F.substring(c, -ENDS, ENDS)))).alias("end")
    wanted = asked.select("asked", F.col("key").alias("wanted"))
    equal = wanted.join(keys.select("key", "copies"), F.col("wanted") == F.col("key")).select("asked", "wanted", "key", "copies")
    asked_ends = wanted.select("asked", "wanted", ends("wanted"))
    # Cut for each end before the queries are met, so an end that is very frequent stays one row a key.
    some = keys.select("key", "n", "copies", ends("key")).join(asked_ends.select("end").distinct(), "end", "left_semi")
    some = some.withColumn("_n", F.row_number().over(W.partitionBy("end").orderBy("n", "key"))).where(F.col("_n") <= NEAR)
    return equal.unionByName(some.join(asked_ends, "end").select("asked", "wanted", "key", "copies")).distinct()


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wanted, keys = (Texts(batch.column(c).to_pylist()) for c in ("wanted", "key"))
        each = np.arange(batch.num_rows)
        score = 200.0 * lcs_lengths(wanted, keys, each, each) / (wanted.lengths + keys.lengths)
        yield pa.RecordBatch.from_arrays([batch.column("asked"), batch.column("copies"), pa.array(score)], ["asked", "copies", "score"])


def _cut(chars: int):
    """Rows of keys and copies: keys of about one length, in its order, that take that many places side by side, or one key."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            order, at = np.argsort(n, kind="stable"), 0
            batch, n = batch.take(pa.array(order)), n[order]
            while at < len(n):
                stop = at + max(1, int(np.searchsorted(n[at:] * np.arange(1, len(n) - at + 1), chars, "right")))
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays([one(batch.column(c).slice(at, stop - at)) for c in ("key", "copies")], ["keys", "copies"])  # noqa: B023
                at = stop

    return cut


class _Tally:
    """Queries that meet block after block, the entries found (k are enough) and the best score, which the next have to beat."""

    def __init__(self, queries: pa.StructArray, k: int, min_score: float) -> None:
        self.k, self.min_score = k, min_score
        self.asked = queries.field("asked").to_numpy()
        self.texts = Texts(queries.field("key").to_pylist())
        self.bags = self.texts.bags(CLASSES)
        self.known = queries.field("found").to_numpy().copy()
        self.found = np.zeros_like(self.known)
        self.best = queries.field("best").to_numpy().copy()
        self.first = self.best.copy()

    def wanted(self, i: int, score: np.ndarray) -> np.ndarray:
        return score > self.best[i] if max(self.found[i], self.known[i]) >= self.k else score >= self.min_score

    def meet(self, texts: Texts, copies: np.ndarray) -> None:
        """texts by length."""
        bags, columns = np.ascontiguousarray(texts.bags(CLASSES).T), Columns(texts)
        for i, n in enumerate(self.texts.lengths.tolist()):
            sums = texts.lengths + n
            fits = np.flatnonzero(self.wanted(i, 200.0 * np.minimum(texts.lengths, n) / sums))
            if not len(fits):
                continue
            some = slice(int(fits[0]), int(fits[-1]) + 1)  # the bound rises up to n and falls after it
            common = np.zeros(some.stop - some.start, np.int32)
            for c in np.flatnonzero(self.bags[i]).tolist():
                common += np.minimum(bags[c, some], self.bags[i, c])
            e = some.start + np.flatnonzero(self.wanted(i, 200.0 * common / sums[some]))
            score = 200.0 * columns.lcs(self.texts.codes[self.texts.starts[i] : self.texts.starts[i + 1]], e) / sums[e]
            hit = score >= self.min_score
            self.found[i] += copies[e[hit]].sum()
            self.best[i] = score[hit].max(initial=self.best[i])

    def rows(self) -> pa.RecordBatch:
        some = np.flatnonzero((self.found > 0) | (self.best > self.first))
        return pa.RecordBatch.from_arrays([pa.array(self.asked[some]), pa.array(np.minimum(self.found[some], self.k)), pa.array(self.best[some])], ["asked", "found", "best"])


def _tallied(k: int, min_score: float):
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, _Tally] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.column("part")[row].as_py()
                if part not in parts:
                    parts[part] = _Tally(batch.column("queries")[row].values, k, min_score)
                parts[part].meet(Texts(batch.column("keys")[row].values.to_pylist()), batch.column("copies")[row].values.to_numpy())
        for done in parts.values():
            yield done.rows()

    return tally


def tallies(asked: DataFrame, keys: DataFrame, k: int, min_score: float) -> DataFrame:
    """asked, found, best: of asked(asked, key, n, found, best) those that meet more keys of min_score, or better ones if k are
    found. A row a task, found at most k in each."""
    least = F.least(F.lit(100.0), F.when(F.col("found") >= k, F.col("best")).otherwise(F.lit(min_score)))
    some = asked.select(F.count("*").alias("queries"), F.min(F.col("n") * least / (200 - least)).alias("low"), F.max(F.col("n") * (200 - least) / F.nullif(least, F.lit(0.0))).alias("high"), F.min(least).alias("least")).first()
    if some["queries"]:
        reach = keys.where(F.col("n") >= math.floor(some["low"]))
        reach = reach.where(F.col("n") <= math.ceil(some["high"])) if some["least"] > 0 else reach
    else:
        reach = keys.limit(0)
    parts = asked.groupBy(F.pmod(F.xxhash64("asked"), F.lit(max(1, -(-some["queries"] // TOGETHER)))).alias("part")).agg(F.collect_list(F.struct("asked", "key", "found", "best")).alias("queries"))
    # As many tasks as shuffles have: the work is in comparing.
    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = reach.repartition(tasks, "key").select("key", "n", "copies").mapInArrow(_cut(BLOCK_CHARS), "keys array<string>, copies array<long>")
    return blocks.crossJoin(stored(parts, "memory-parts")).mapInArrow(_tallied(k, min_score), "asked long, found long, best double")


def hits(queries: DataFrame, memory: DataFrame, mode: str = "token", k: int = 5, min_score: float = 60.0) -> DataFrame:
    """query_id, hits, best: of every query, also those without any, how many entries it is shown and the best score."""
    checked(mode, k)
    min_score = float(min_score)
    keys = counted(memory, mode, k)
    asked = stored(query_keys(queries, mode), "memory-queries")
    each = stored(asked.select("key").distinct().select("key", F.length("key").cast("long").alias("n"), F.monotonically_increasing_id().alias("asked")), "memory-asked")
    first = near(each, keys).mapInArrow(_scores, "asked long, copies long, score double").where(F.col("score") >= min_score)
    first = first.groupBy("asked").agg(F.sum("copies").alias("found"), F.max("score").alias("best"))
    first = stored(each.join(first, "asked", "left").select("asked", "key", "n", F.coalesce("found", F.lit(0)).cast("long").alias("found"), F.coalesce("best", F.lit(-1.0)).alias("best")), "memory-near")
    more = tallies(first.where((F.col("found") < k) | (F.col("best") < 100)), keys, k, min_score).groupBy("asked").agg(F.sum("found").alias("more"), F.max("best").alias("better"))
    # A query that had k is full; the others have met every key, those found at first again.
    n = F.when(F.col("found") >= k, F.lit(k)).otherwise(F.least(F.coalesce("more", F.lit(0)), F.lit(k)))
    of = first.join(stored(more, "memory-tallies"), "asked", "left").select("key", n.alias("n"), F.greatest("best", "better").alias("best"))
    found = asked.join(of, "key").groupBy("query_id").agg(F.least(F.sum("n"), F.lit(k)).alias("hits"), F.max(F.when(F.col("n") > 0, F.col("best"))).alias("best"))
    every = queries.select(F.col("query_id").cast("string").alias("query_id")).distinct()
    return every.join(found, "query_id", "left").select("query_id", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), F.round("best", 6).alias("best"))
