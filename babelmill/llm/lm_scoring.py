"""Operator 2, LM scoring: a weighted backoff automaton of smoothed n-grams.

States are histories: the empty one, the start of a text, and each run of up to ORDER - 1 tokens that training texts
hold. A state h of c(h) training tokens has an arc for every token w seen after it, of probability
p(w|h) = (c(hw) + m p(w|h')) / (c(h) + m), and a failure arc of weight m / (c(h) + m) to h', the history without its
first token; m is the prior's strength at that order (MASS). So relative frequencies are discounted by c(h) / (c(h) + m)
and the rest goes over the failure arc. The empty state has an arc for every token, p(w) = (c(w) + 1) / (N + V + 1).
The probabilities of a state sum to one. An arc over an n-gram of k tokens leads to the state of its last
min(k, ORDER - 1) tokens, an unknown token to the empty state.

A text is scored in one traversal from left to right: the state is carried; while it has no arc for the next token, the
failure arc is followed and its weight added; then the arc is taken. `Automaton.traverse` does just that.

The automaton grows with the corpus and is never held in one place. Texts become segments of local token numbers; a
segment asks for the counts of just the n-grams it holds, packed by bucket of their keys; a bucket sums what all
segments counted and answers each of them; a segment then has its part of the automaton and is traversed. N-grams are
counted in segments first, so a hot one costs a segment one key. Buckets grow in number with the corpus, so that one
fits a task; a bucket row of a segment never is more than the n-grams it holds. Keys of n-grams have KEY_BITS bits beside
their bucket, 46 of them a hash: of about a million n-grams of an order in a bucket, two are expected to share a key, and so
their counts, in one of some 128 buckets. All 64 bits would need more disk than the query may use.

Defined cases: null text is empty and has the end token alone; a null doc_id counts as the text '' and is for
training; repeated rows count as often as they stand there; with no training text every token has p = 1 / 1; a very
long text is one segment, whole; ties do not arise, each n-gram has one count; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from babelmill.llm import textnum as tn
from babelmill.llm.common import stored, table

#: Strength of the prior at histories of one token, two tokens, ...; the order is one more than their number.
MASS = (500.0, 4.0)
#: Tokens of a segment, and tokens of the corpus for each bucket.
SEGMENT_TOKENS, BUCKET_TOKENS, LEAST_BUCKETS = 1 << 19, 1 << 20, 64
#: Bits of an n-gram's key beside its bucket; the two lowest are its order.
KEY_BITS = 48
END, START = np.uint64(0xE0E0E0E0E0E0E0E1), np.uint64(0xB0B0B0B0B0B0B0B1)
FOLDS, HELD_OUT = 7, 2
SEGMENTS = "segment long, doc_ids array<long>, held_out array<boolean>, n_tokens array<int>, vocabulary binary, tokens binary"


def packed(x: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(held: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(held), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, made, size = TaskContext.get().partitionId() << 32, 0, 0
    held: list[tuple] = []
    schema = pa.schema([("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int32())), ("vocabulary", pa.binary()), ("tokens", pa.binary())])

    def done() -> pa.RecordBatch:
        known, inverse, counts = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True, return_counts=True)
        rank = np.empty(len(known), np.uint32)
        order = np.argsort(-counts, kind="stable")  # frequent words get small numbers, whose high bytes pack well
        rank[order] = np.arange(len(known), dtype=np.uint32)
        values = [[task + made], [sum((h[1] for h in held), [])], [sum((h[2] for h in held), [])], [np.concatenate([h[3] for h in held]).tolist()], [known[order].tobytes()], [packed(rank[inverse])]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    for batch in batches:
        ids, out = batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist()
        for first_row, offsets, data in tn.chunks(batch.column("text")):
            starts, ends, first = tn.word_spans(data, offsets, tn.SPACED)
            words = np.insert(tn.word_hashes(data, starts, ends), first[1:], END)
            rows = slice(first_row, first_row + len(offsets) - 1)
            held.append((words, ids[rows], out[rows], np.diff(first) + 1))
            size += len(words)
            if size >= SEGMENT_TOKENS:
                yield done()
                made, size, held = made + 1, 0, []
    if held:
        yield done()


class Grams:
    """The n-grams of a segment's texts, numbered by order.

    `at[k]` is the number of the k-gram that ends at each token (a start stands before each text), -1 where there is
    none; `history[k]` and `suffix[k]` are, for each k-gram, the numbers of the (k - 1)-grams that it begins and ends with.
    """

    def __init__(self, vocabulary: bytes, tokens: bytes, n_tokens: np.ndarray, held_out: np.ndarray, order: int) -> None:
        words = np.frombuffer(vocabulary, np.uint64)
        ids = unpacked(tokens, np.uint32).astype(np.int64)
        self.train = np.repeat(~held_out, n_tokens)
        self.first = np.cumsum(n_tokens) - n_tokens
        self.n_tokens = n_tokens
        place = np.arange(len(ids)) - np.repeat(self.first, n_tokens)
        start = len(words)  # the number of the start among the histories of one token
        hashes = tn.mix64(np.append(words, START))
        self.at, self.history, self.suffix, self.keys = [None, ids], [None, None], [None, None], [None, hashes[:-1]]
        self.end = int(np.flatnonzero(words == END)[0])
        for k in range(2, order + 1):
            before = np.concatenate([[0], self.at[k - 1][:-1]])
            if k == 2:
                before[self.first] = start
            some = np.flatnonzero(place >= k - 2)
            found, where, inverse = np.unique(before[some] * len(words) + ids[some], return_index=True, return_inverse=True)
            number = np.full(len(ids), -1)
            number[some] = inverse
            h, w = found // len(words), found % len(words)
            self.at.append(number)
            self.history.append(h)
            self.suffix.append(self.at[k - 1][some[where]])
            self.keys.append(tn.mix64(hashes[h] * tn._WEIGHTS[0] + tn.mix64(words)[w] * tn._WEIGHTS[1]))
            hashes = self.keys[-1]

    def counts(self, k: int) -> np.ndarray:
        """How often the training texts of the segment hold each k-gram."""
        return np.bincount(self.at[k][self.train & (self.at[k] >= 0)], minlength=len(self.keys[k]))

    def asked(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The keys of all n-grams, of `bits` bits, in order, and where each n-gram's key stands among them."""
        keys = np.concatenate([(h >> np.uint64(64 - bits)) & ~np.uint64(3) | np.uint64(k - 1) for k, h in enumerate(self.keys[1:], 1)])
        order = np.argsort(keys, kind="stable")
        back = np.empty(len(keys), np.int64)
        back[order] = np.arange(len(keys))
        return keys[order], back


def rows_of(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[tuple[dict, Grams]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            held = np.array(row["held_out"].values.to_pylist(), bool)
            yield row, Grams(row["vocabulary"].as_py(), row["tokens"].as_py(), np.asarray(row["n_tokens"].values, np.int64), held, order)


REQUESTS = "bucket int, segment long, keys binary, counts binary"


def requests(segments: DataFrame, order: int, buckets: int) -> DataFrame:
    """What each segment asks of each bucket: keys in order, as steps, and how often its training texts hold them."""
    bits = KEY_BITS + buckets.bit_length() - 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, g in rows_of(batches, order):
            keys, back = g.asked(bits)
            counts = np.empty(len(keys), np.int64)
            counts[back] = np.concatenate([g.counts(k) for k in range(1, order + 1)])
            bucket = (keys >> np.uint64(KEY_BITS)).astype(np.int64)
            some, first = np.unique(bucket, return_index=True)
            ends = np.append(first[1:], len(keys))
            low = keys & np.uint64((1 << KEY_BITS) - 1)
            yield pa.RecordBatch.from_arrays([
                pa.array(some, pa.int32()), pa.array([row["segment"].as_py()] * len(some), pa.int64()),
                pa.array([packed(np.diff(low[a:b], prepend=np.uint64(0))) for a, b in zip(first, ends, strict=True)], pa.binary()),
                pa.array([packed(counts[a:b]) for a, b in zip(first, ends, strict=True)], pa.binary()),
            ], ["bucket", "segment", "keys", "counts"])

    return segments.mapInArrow(ask, REQUESTS)


ANSWERS = "bucket int, segment long, n_words long, counts binary"


def answer(group: pd.DataFrame) -> pd.DataFrame:
    """For each segment the sums of all segments' counts of the keys it asked for; and how many words the bucket knows."""
    group = group.sort_values("segment")
    keys = [np.cumsum(unpacked(x, np.uint64)) for x in group["keys"]]
    known, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(known), np.int64)
    np.add.at(total, inverse, np.concatenate([unpacked(x, np.int64) for x in group["counts"]]))
    n = int(((total > 0) & (known & np.uint64(3) == 0)).sum())
    parts = np.split(total[inverse], np.cumsum([len(k) for k in keys])[:-1])
    return pd.DataFrame({"bucket": group.bucket, "segment": group.segment, "n_words": [n] + [0] * (len(group) - 1), "counts": [packed(x) for x in parts]})


class Automaton:
    """The part of the automaton that a segment's texts can reach: arcs and failure arcs as log10 weights by n-gram."""

    def __init__(self, g: Grams, counts: list[np.ndarray], n_train: int, n_words: int, mass: tuple[float, ...]) -> None:
        self.order = len(mass) + 1
        p = (counts[1] + 1) / (n_train + n_words + 1.0)
        self.known = counts[1] > 0
        #: arcs[k]: the weight of the arc over each k-gram, from the state of its first k - 1 tokens; nan where there is none.
        self.arcs: list[np.ndarray | None] = [None, np.log10(p)]
        #: failures[k]: the weight of the failure arc of each history of k tokens; the start's is the last at k = 1.
        self.failures: list[np.ndarray | None] = [None]
        for k, m in enumerate(mass, 2):
            states = np.append(counts[1], counts[1][g.end]) if k == 2 else counts[k - 1]  # a text that begins also ends
            self.failures.append(np.log10(m / (states + m)))
            p = (counts[k] + m * p[g.suffix[k]]) / (states[g.history[k]] + m)
            self.arcs.append(np.where(counts[k] > 0, np.log10(p), np.nan))

    def traverse(self, g: Grams) -> np.ndarray:
        """log10 probability of each text: one pass over its tokens that carries the state, as the length of its history."""
        arcs = [None] + [np.where(g.at[k] >= 0, self.arcs[k][g.at[k]], np.nan).tolist() for k in range(1, self.order + 1)]
        fails: list[list | None] = [None]
        for k in range(1, self.order):
            before = np.concatenate([[0], g.at[k][:-1]])  # the history that stands before each token
            if k == 1:
                before[g.first] = len(self.failures[1]) - 1
            fails.append(self.failures[k][before].tolist())
        known = self.known[g.at[1]].tolist()
        longest, out, i = self.order - 1, [], 0
        for n in g.n_tokens.tolist():
            state, total = 1, 0.0  # the start
            for i in range(i, i + n):
                arc = arcs[state + 1][i]
                while arc != arc:  # no arc for this token: over the failure arc
                    total += fails[state][i]
                    state -= 1
                    arc = arcs[state + 1][i]
                total += arc
                state = state + 1 if state < longest else longest
                if not known[i]:
                    state = 0
            out.append(total)
            i += 1
        return np.array(out)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, mass: tuple[float, ...] = MASS) -> DataFrame:
    """SCORES of every row of docs(doc_id, held_out, text); rows that are not held out are the training texts.

    The model's order is len(mass) + 1, from 2 to 4.
    """
    order = len(mass) + 1
    if not 2 <= order <= 4:
        raise ValueError("orders are 2 to 4")
    segments = stored(docs.select("doc_id", "held_out", "text").mapInArrow(_segments, SEGMENTS), "lm-segments")
    train = F.aggregate(F.zip_with("n_tokens", "held_out", lambda n, h: F.when(h, 0).otherwise(n).cast("long")), F.lit(0).cast("long"), lambda s, n: s + n)
    every = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda s, n: s + n)
    n_train, n_all = segments.agg(F.coalesce(F.sum(train), F.lit(0)), F.coalesce(F.sum(every), F.lit(0))).first()
    buckets = LEAST_BUCKETS
    while buckets * BUCKET_TOKENS < n_all:
        buckets *= 2
    answers = stored(requests(segments, order, buckets).groupBy("bucket").applyInPandas(answer, ANSWERS), "lm-answers", "none")
    n_words = answers.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    each = answers.groupBy("segment").agg(F.collect_list(F.struct("bucket", "counts")).alias("answers"))
    bits = KEY_BITS + buckets.bit_length() - 1

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, g in rows_of(batches, order):
            got = sorted(row["answers"].as_py(), key=lambda a: a["bucket"])
            held = np.concatenate([unpacked(a["counts"], np.int64) for a in got])[g.asked(bits)[1]]
            counts = [None, *np.split(held, np.cumsum([len(k) for k in g.keys[1:]])[:-1])]
            model = Automaton(g, counts, n_train, n_words, mass)
            total = lambda x: pa.array(np.add.reduceat(x, g.first))  # noqa: B023, E731  every text has a token, its end
            yield pa.RecordBatch.from_arrays([
                row["doc_ids"].values, row["held_out"].values, pa.array(g.n_tokens), total(model.known[g.at[1]].astype(np.int64)),
                pa.array(np.full(len(g.first), n_train, np.int64)), total(model.arcs[1][g.at[1]]), pa.array(model.traverse(g)),
            ], [x.split()[0] for x in SCORES.split(", ")])

    return segments.join(each, "segment").mapInArrow(traverse, SCORES)


def with_fold(docs: DataFrame) -> DataFrame:
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    return docs.select("doc_id", "text", (fold == HELD_OUT).alias("held_out"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(with_fold(table(spark, sf_dir, "documents")))
