"""Operator 9, MinHash near-dedup: a multi-index Hamming join on b-bit signatures.

A signature holds CHUNKS * WIDTH MinHash values cut to 16 bits; distance is the number of differing values. By the
pigeonhole principle two signatures at distance below CHUNKS * 2 agree, in at least one chunk, in all values or all
but one. Every chunk is therefore indexed under WIDTH keys, each leaving one value out: that enumerates the allowed
error of a chunk, and all pairs within the distance share a key. Two texts of similarity 0.8 miss every key with a
probability of about 1e-7 (0.263 ** 12).

Texts of equal shingle sets are one class, found by a 128-bit digest and the size of the set; classes get numbers of
their own, and only they are indexed. Candidates are pairs that share a key and whose signatures differ in at most
DISTANCE of SIZE values (a pair of similarity 0.8 differs in more with a probability of about 1e-8); a parity sketch,
which bounds the difference of two sets from below, and the sizes of the sets leave out pairs that can't be linked.
Within a key, classes are compared with the smallest class first (a star, not all pairs); links are confirmed on the
words of both texts, all of them, and joined to components. Then members of a key that are still in different components
meet: by further centres in keys that hold more than LARGE of them apart, up to TURNS times, and then each with each,
in a join whose conditions are sizes, components and sketches; both ways find the same links, so the numbers change
the work, not the result. Hot keys are pre-aggregated and joined under adaptive skew splitting; components are found by
alternating large and small stars in stored tables.

Defined cases: null or blank text has an empty set, is linked with nothing and kept; rows of equal doc_id are separate
documents with one id; a null doc_id is never the smallest unless all are null; repeated rows share a class and their
component; of rows with the least doc_id the one of the least key stays, and one of those repeated in all columns; a
very long text is described in one piece and its class compared like any other; an empty table gives an empty result;
other columns only tell rows apart and are kept by `deduplicated`, whatever their names and types.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from babelmill.llm import textnum as tn
from babelmill.llm.common import row_key, stored, table, whole_row

SHINGLE, CHUNKS, WIDTH = 4, 12, 5
SIZE = CHUNKS * WIDTH
LANES = SIZE // 4
#: Signature values in which candidates may differ.
DISTANCE = 32
#: Bits of the parity sketch of a set.
SKETCH = 1024
#: Keys that a broadcast may hold (16 bytes each); beyond that the join is an ordinary one.
BROADCAST_IDS = 1 << 20
#: Further centres tried for keys that hold more than LARGE classes apart, before all that are apart meet.
TURNS, LARGE = 3, 4096


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, offsets, data in tn.chunks(texts):
        starts, ends, first = tn.word_spans(data, offsets, tn.SPACED)
        words = tn.word_hashes(data, starts, ends)
        for a, b in zip(first[:-1], first[1:], strict=True):
            n = int(b - a)
            yield np.unique(tn.shingle_hashes(words[a:b], min(k, n))) if n else np.zeros(0, np.uint64)


_MULT = tn.mix64(np.arange(1, SIZE + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """SIZE MinHash values of a set, cut to 16 bits."""
    low = np.empty(SIZE, np.uint64)
    for i in range(SIZE):
        low[i] = (shingles * _MULT[i]).min()
    return (tn.mix64(low) & np.uint64(0xFFFF)).astype(np.uint16)


def parities(shingles: np.ndarray) -> np.ndarray:
    """SKETCH bits, each the parity of the shingles that fall on it: two sets differ in at least as many shingles as their
    sketches in bits."""
    return np.packbits(np.bincount((shingles >> np.uint64(54)).astype(np.int64), minlength=SKETCH) & 1).view(np.int64)


DESCRIBED = "row_id binary, doc_id long, n long, d1 long, d2 long, sig array<long>, sketch array<long>"


def lists(rows: list[np.ndarray], width: int) -> pa.ListArray:
    flat = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), flat)


def described(docs: DataFrame, shingle: int) -> DataFrame:
    """DESCRIBED for each row of docs(row_id, doc_id, text)."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2, sigs, sketches = [], [], [], [], []
            for s in shingle_sets(batch.column("text"), shingle):
                n.append(len(s))
                if not len(s):
                    d1.append(0), d2.append(0), sigs.append(np.zeros(LANES, np.int64)), sketches.append(np.zeros(SKETCH // 64, np.int64))
                    continue
                d1.append(int(tn.signed(tn.mix64(np.array([s.sum()])))[0]))
                d2.append(int(tn.signed(np.array([tn.mix64(s).sum()]))[0]))
                sigs.append(signature(s).view(np.int64)), sketches.append(parities(s))
            ids = [batch.column("row_id"), batch.column("doc_id").cast(pa.int64())]
            columns = [*ids, pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), lists(sigs, LANES), lists(sketches, SKETCH // 64)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in DESCRIBED.split(", ")])

    return docs.select("row_id", "doc_id", "text").mapInArrow(describe, DESCRIBED)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each class under its chunk keys."""
    for batch in batches:
        for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
            cid, n = part.column("cid"), part.column("n")
            sig = part.column("sig")
            lanes = sig.flatten().to_numpy(zero_copy_only=False)
            values = np.ascontiguousarray(lanes).view(np.uint16).astype(np.uint64).reshape(-1, CHUNKS, WIDTH)
            keys = np.empty((len(values), CHUNKS, WIDTH), np.uint64)
            for left_out in range(WIDTH):
                key = np.zeros(values.shape[:2], np.uint64)
                for v in (values[:, :, i] for i in range(WIDTH) if i != left_out):
                    key = (key << np.uint64(16)) | v
                keys[:, :, left_out] = tn.mix64(key + np.uint64(left_out)) ^ tn._WEIGHTS[:CHUNKS]
            again = np.repeat(np.arange(part.num_rows), SIZE)
            yield pa.RecordBatch.from_arrays([pa.array(tn.signed(keys.reshape(-1))), cid.take(pa.array(again)), n.take(pa.array(again))], ["key", "cid", "n"])


def close(a: Column, b: Column, n: Column, m: Column) -> Column:
    """Sketches that a similarity of 0.8 allows: then the sets differ in (n + m) / 9 shingles at most. Loses no pair."""
    bits = sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(SKETCH // 64)), F.lit(0))
    return bits * 9 <= n + m


def alike(n: Column, m: Column) -> Column:
    """Sizes that a similarity of 0.8 allows."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * 80


def distance(a: Column, b: Column) -> Column:
    """In how many of their 16-bit values, four to a long, two signatures differ."""
    low, high = F.lit(0x7FFF7FFF7FFF), F.lit(0x800080008000)
    out = F.lit(0)
    for i in range(LANES):
        x = a[i].bitwiseXOR(b[i])
        # A value of the lower three that is not zero carries into, or has, its high bit.
        three = (x.bitwiseAND(low) + low).bitwiseOR(x).bitwiseAND(high)
        out = out + F.bit_count(three) + (F.shiftrightunsigned(x, 48) != 0).cast("int")
    return out


def apart(df: DataFrame) -> DataFrame:
    """df for a join by sorting and merging. Spark sizes a stored table by its compressed file, an array by one element and what
    comes from Arrow or an explode by what goes in, and would broadcast more than the driver can hold."""
    return df.hint("merge")


def texts_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """cid, text of the classes in wanted(cid): one text a class, also where rows are repeated."""
    wanted = stored(apart(wanted.distinct()).join(classes.select("cid", "row_id"), "cid"), "near-wanted")
    ids = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else apart(wanted)
    return stored(docs.join(ids, "row_id").groupBy("cid").agg(F.first("text").alias("text")), "near-texts")


def near(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs (u, v) of classes those that their sizes, signatures and sketches allow."""
    held = lambda x: classes.select(F.col("cid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "sketch", "sig")])
    found = pairs.join(apart(held("u")), "u").join(apart(held("v")), "v")
    found = found.where(alike(F.col("n_u"), F.col("n_v")) & close(F.col("sketch_u"), F.col("sketch_v"), F.col("n_u"), F.col("n_v")))
    found = found.where(distance(F.col("sig_u"), F.col("sig_v")) <= DISTANCE)
    return stored(found.select("u", "v"), "near-pairs")


def words_of(text: str, shingle: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves: runs of words of the text, A-Z lower-cased, cut at ASCII white space."""
    words = text.encode().lower().split()
    k = min(shingle, len(words))
    return set(zip(*(words[i:] for i in range(k)), strict=False))


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Of near() pairs those with 100 * intersection >= 80 * union on the words of both texts."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple] = {"u": (None, set()), "v": (None, set())}
        for batch in batches:
            keep = []
            for i, (u, v) in enumerate(zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True)):
                for x, cid in (("u", u), ("v", v)):
                    if held[x][0] != cid:
                        held[x] = (cid, words_of(batch.column(f"text_{x}")[i].as_py() or "", shingle))
                a, b = held["u"][1], held["v"][1]
                same = len(a & b)
                if 100 * same >= 80 * (len(a) + len(b) - same):
                    keep.append(i)
            yield batch.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    of = lambda x: texts.select(F.col("cid").alias(x), F.col("text").alias(f"text_{x}"))
    return stored(pairs.join(apart(of("u")), "u").join(apart(of("v")), "v").mapInArrow(compare, "u long, v long"), "near-links")


def mixed_keys(labelled: DataFrame) -> DataFrame:
    """Rows (key, cid, root, ...) of the keys whose classes are in different components."""
    mixed = labelled.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a < _b").select("key")
    return labelled.join(apart(mixed), "key")


def components(edges: DataFrame) -> DataFrame:
    """cid, root of every class in an edge: alternating large and small stars until nothing changes."""
    e = stored(edges.select("u", "v").where("u <> v").distinct(), "stars")
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(apart(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(apart(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).where("u <> v").distinct()
        e = stored(small, "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("cid"), F.col("v").alias("root"))
        before = now


def classes_of(rows: DataFrame) -> DataFrame:
    """One row a distinct shingle set: cid, the least (doc_id, row_id) of its rows, the row, its size and signature.

    cid is a number given when the table is written, so two classes never share one.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "row_id")).alias("first")
    found = rows.where("n > 0").groupBy("d1", "d2", "n", "sig", "sketch").agg(first)
    return stored(found.select("*", F.col("first.row_id").alias("row_id"), F.monotonically_increasing_id().alias("cid")), "near-classes")


def deduplicated(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs with one row of each component, columns as they are: the one of the least doc_id."""
    found = stored(near_duplicates(docs, shingle).select(F.col("row_id").alias("key"), "stays"), "near-verdicts")
    held = docs.select(row_key(docs).alias("key"), whole_row(docs).alias("row"))
    left = without_keys(held, found.where(~F.col("stays")).select("key").distinct())
    # Rows repeated as they are share a key: of those that stay, one is left (aggregated map-side, so none is hot).
    again = found.where("stays").groupBy("key").count().where("count > 1").select("key")
    if not again.head(1):
        return left.select("row.*")
    one = left.join(again, "key", "left_semi").groupBy("key").agg(F.first("row").alias("row"))
    return without_keys(left, again).unionByName(one).select("row.*")


def without_keys(held: DataFrame, keys: DataFrame) -> DataFrame:
    """held without the rows whose key is in keys(key); keys are broadcast only below a checked number."""
    keys = stored(keys, "keys")
    side = F.broadcast(keys) if keys.count() <= BROADCAST_IDS else apart(keys)
    return held.join(side, "key", "left_anti")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """row_id, doc_id, n_shingles, component_id, kept and stays.

    row_id is row_key() of the row. kept says that doc_id is the component's least; stays is true for just one row_id of
    each component, also where ids are null or repeated.
    """
    docs = docs.select(row_key(docs).alias("row_id"), "doc_id", "text")
    rows = stored(described(docs, shingle), "near-described")
    classes = classes_of(rows)
    keys = classes.select("cid", "n", "sig").mapInArrow(_index, "key long, cid long, n long")
    # Keys with more than one class; the smallest class of a key is its star's centre.
    shared = keys.groupBy("key").agg(F.min("cid").alias("centre"), F.max("cid").alias("_last")).where("centre < _last").drop("_last")
    members = stored(keys.join(apart(shared), "key"), "near-members")
    pairs = members.where("cid <> centre").select(F.col("centre").alias("u"), F.col("cid").alias("v")).distinct()
    pairs = near(classes, pairs)
    links = confirmed(pairs, texts_of(docs, classes, pairs.select(F.explode(F.array("u", "v")).alias("cid"))), shingle)
    done = pairs.select("u", "v")
    roots = components(links)

    def with_roots(rows: DataFrame) -> DataFrame:
        return rows.join(apart(roots), "cid", "left").withColumn("root", F.coalesce("root", "cid"))

    # Members of a key that are still in different components.
    rest = stored(mixed_keys(with_roots(members.select("key", "cid", "n"))), "near-mixed")
    for turn in range(TURNS + 1):
        counts = rest.groupBy("key", "root").agg(F.count("*").alias("_n")).groupBy("key").agg(F.sum("_n").alias("_n"), F.sum(F.col("_n") * F.col("_n")).alias("_s"))
        work = counts.agg(F.coalesce(F.sum(F.col("_n") * F.col("_n") - F.col("_s")), F.lit(0)), F.coalesce(F.sum("_n"), F.lit(0))).first()
        if not work[1]:
            break
        if last := (work[0] <= LARGE * work[1] or turn == TURNS):
            # All members of different components meet; those whose sketches allow a link are pairs.
            # A pair is made under the least key it shares, so once.
            keys = rest.groupBy("cid").agg(F.collect_list("key").alias("keys"))
            full = rest.join(apart(classes.select("cid", "sketch").join(apart(keys), "cid")), "cid")
            a = full.select("key", *[F.col(c).alias(f"{c}_a") for c in ("cid", "n", "root", "sketch", "keys")])
            b = full.select("key", *[F.col(c).alias(f"{c}_b") for c in ("cid", "n", "root", "sketch", "keys")])
            on = (a.key == b.key) & (F.col("cid_a") < F.col("cid_b")) & (F.col("root_a") != F.col("root_b")) & alike(F.col("n_a"), F.col("n_b"))
            on = on & close(F.col("sketch_a"), F.col("sketch_b"), F.col("n_a"), F.col("n_b"))
            on = on & (a.key == F.array_min(F.array_intersect("keys_a", "keys_b")))
            new = a.join(apart(b), on).select(F.col("cid_a").alias("u"), F.col("cid_b").alias("v"))
        else:
            # Very large keys: another centre for each first, met by the members of other components.
            centre = rest.groupBy("key").agg(F.min_by(F.struct("cid", "root", "n"), F.xxhash64("cid", F.lit(turn))).alias("_c"))
            met = rest.join(apart(centre), "key").where("root <> _c.root").where(alike(F.col("n"), F.col("_c.n")))
            new = met.select(F.least("cid", F.col("_c.cid")).alias("u"), F.greatest("cid", F.col("_c.cid")).alias("v"))
        new = near(classes, new.distinct().join(apart(done), ["u", "v"], "left_anti"))
        found = confirmed(new, texts_of(docs, classes, new.select(F.explode(F.array("u", "v")).alias("cid"))), shingle)
        done = done.union(new.select("u", "v"))
        links = links.union(found)
        roots = components(links)
        if last:
            break
        rest = stored(mixed_keys(with_roots(rest.drop("root"))), "near-mixed")
    least = classes.select("cid", "first").join(apart(roots), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    lowest = least.groupBy("root").agg(F.min("first").alias("lowest"))
    by_class = least.join(apart(lowest), "root").select("cid", F.col("lowest.doc_id").alias("component_id"), F.col("lowest.row_id").alias("_stays"))
    by_class = by_class.join(apart(classes.select("cid", "d1", "d2", "n")), "cid").drop("cid")
    out = rows.select("row_id", "doc_id", "d1", "d2", "n").join(apart(by_class), ["d1", "d2", "n"], "left").withColumnRenamed("n", "n_shingles")
    empty = F.col("n_shingles") == 0
    component = F.when(empty, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "row_id", "doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"),
        (empty | (F.col("row_id") == F.col("_stays"))).alias("stays"),
    )


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept")
