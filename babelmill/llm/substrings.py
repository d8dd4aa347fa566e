"""Operator 13, substring dedup: passages of at least WINDOW words that a document of a smaller id has too.

Documents of equal words are one class, described once. Every window of WINDOW words has an anchor, the least hash of
its runs of GRAM words; windows that follow each other under one anchor are a segment. Equal windows have equal anchors,
so only segments whose anchor is in two classes are looked at, and dealing them by anchor brings all places of a window
together. A task takes its anchors in order, in shards of about SHARD words.

Each shard gets an FM-index of its segments (FmIndex): the Burrows-Wheeler transform in a wavelet matrix shaped by the
code lengths of its words, so about as large as their entropy. The shard's documents are streamed through it from right to left by
backward search: each step takes the interval of the match one word to the left and, once the match has WINDOW words, cuts it back to
them; the statistic kept is the least id among the documents of the interval. Where it is smaller than the streamed
document's, the window is reported, and windows that follow each other as one interval.

An anchor whose segments have more than HOT pieces of words (or the HOT_KEYSth part of all, if that is more) would make one
shard hot. Its windows are therefore cut singly, dealt by their own 128-bit hashes, and pre-aggregated to the least id in
each task before the shuffle; one window is then all there is to a key and nothing is left to search for.

Defined cases: null and blank texts have no words, n_removed 0; texts shorter than a window lose nothing; a null doc_id
counts as larger than all others; rows of one doc_id don't take words from each other, repeated rows neither; of exact copies the rows
of the smallest id are judged against other documents, the rest lose all words; very long texts are described, cut and
indexed whole, a long repetition being one segment streamed in overlapping pieces; an empty table gives an empty
result; `cleaned` keeps other columns, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from babelmill.llm import textnum as tn
from babelmill.llm.common import column, row_key, stored, table, whole_row

WINDOW, GRAM, SHARD = 50, 8, 1 << 20
#: Windows that a piece of a long segment owns when it is streamed.
PIECE = 128
#: A key with more rows (an anchor: pieces of words) than this, or with more than the 2**20th part of all rows, is hot: so there are at most 2**20 hot ones.
HOT, HOT_KEYS = 1 << 13, 1 << 20
#: Bytes of text that are described or cut at once, beyond the last one.
BATCH = 4 << 20
#: The place of a null doc_id in the order of ids.
LAST = (1 << 63) - 1


def joined_words(text: str | None) -> bytes:
    """The words of a text, each followed by one space."""
    words = (text or "").encode().split()  # at ASCII white space, as the word class is defined
    return b" ".join(words) + b" " if words else b""


def word_ends(data: np.ndarray) -> np.ndarray:
    return np.flatnonzero(data == 32)


def least_of_runs(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` values that follow each other."""
    n, step, out = len(values) - width + 1, 1, values
    while step < width:
        by = min(step, width - step)
        out = np.minimum(out[:-by], out[by:])
        step += by
    return out[:n]


def segments_of(words: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first word and number of windows of the segments of texts whose words (hashes) begin at `first`."""
    nothing = np.zeros(0, np.int64)
    if len(words) < window:
        return np.zeros(0, np.uint64), nothing, nothing
    gram = min(GRAM, window)
    anchors = least_of_runs(tn.shingle_hashes(words, gram), window - gram + 1)
    ends = first[1:][np.searchsorted(first[1:], np.arange(len(anchors)), "right")]
    inside = np.arange(len(anchors)) + window <= ends
    change = np.ones(len(anchors), bool)
    change[1:] = (anchors[1:] != anchors[:-1]) | ~inside[:-1]
    # One text's windows and the next one's are apart: no window reaches over an end.
    edges = np.flatnonzero(change | ~inside)
    starts = edges[inside[edges]]
    stops = np.append(edges, len(anchors))[np.searchsorted(edges, starts) + 1]
    return anchors[starts], starts, stops - starts


DESCRIBED = "row_id binary, doc_id long, place long, n_words long, words binary, anchors array<long>, starts array<int>, runs array<int>"


def described(docs: DataFrame, window: int) -> DataFrame:
    """DESCRIBED of docs(row_id, doc_id, text); words: the SHA-256 of the words joined by one space."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        row_ids, doc_ids, held, shas = zip(*rows, strict=True)
        data = np.frombuffer(b"".join(held), np.uint8)
        ends = word_ends(data)
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        first = np.searchsorted(ends, np.concatenate([[0], np.cumsum([len(x) for x in held])]))
        anchors, at, runs = segments_of(tn.word_hashes(data, starts, ends), first, window)
        text = np.searchsorted(first, at, "right") - 1
        lists = pa.array(np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(held)))]).astype(np.int32))
        of = lambda x: pa.ListArray.from_arrays(lists, pa.array(x))
        places = [LAST if x is None else x for x in doc_ids]
        return pa.RecordBatch.from_arrays([
            pa.array(row_ids, pa.binary()), pa.array(doc_ids, pa.int64()), pa.array(places, pa.int64()), pa.array(np.diff(first)), pa.array(shas, pa.binary()),
            of(tn.signed(anchors)), of((at - first[text]).astype(np.int32)), of(runs.astype(np.int32)),
        ], [x.split()[0] for x in DESCRIBED.split(", ")])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for row_id, doc_id, text in zip(*batch.columns, strict=True):
                held = joined_words(text.as_py())
                rows.append((row_id.as_py(), doc_id.as_py(), held, hashlib.sha256(held[:-1]).digest()))
                size += len(held)
                if size >= BATCH:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)

    return docs.select("row_id", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(describe, DESCRIBED)


class Bits:
    """A bit vector with rank: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        below = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)


class Wavelet:
    """A wavelet matrix with one bit vector a level, in which symbol c has as many levels as its code has bits.

    Codes are Shannon's, canonical: ceil(log2(n / count)) bits. Symbols must be numbered by falling counts.
    """

    def __init__(self, symbols: np.ndarray, counts: np.ndarray) -> None:
        n = max(len(symbols), 1)
        self.lengths = np.maximum(np.ceil(np.log2(n / counts)).astype(np.int64), 1)
        most = int(self.lengths.max())
        sizes = 1 << (most - self.lengths)
        codes = (np.cumsum(sizes) - sizes) >> (most - self.lengths)
        self.levels: list[Bits] = []
        #: By level and symbol: where its node begins, the ones before that, its bit.
        self.starts, self.ones, self.bits = [], [], []
        start = np.zeros(len(counts), np.int64)
        for level in range(most):
            code_bits = ((codes >> np.maximum(self.lengths - 1 - level, 0)) & 1).astype(bool)
            bits = code_bits[symbols]
            vector = Bits(bits)
            self.levels.append(vector)
            before = vector.rank(np.minimum(start, len(symbols)))
            self.starts.append(start), self.ones.append(before), self.bits.append(code_bits)
            start = np.where(code_bits, len(symbols) - int(bits.sum()) + before, start - before)
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
            # Symbols whose code ends here leave; nodes after theirs move up.
            leaves = np.flatnonzero(self.lengths == level + 1)
            if len(leaves):
                leaves = leaves[np.argsort(start[leaves])]
                gone = np.concatenate([[0], np.cumsum(counts[leaves])])
                start = start - gone[np.searchsorted(start[leaves], start)]
                symbols = symbols[self.lengths[symbols] > level + 1]

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place; symbols by falling code lengths, so that each level is a prefix."""
        out = at.copy()
        lengths = self.lengths[symbols]
        live = np.searchsorted(-lengths, -np.arange(int(lengths[0])), "left")
        for level, m in enumerate(live.tolist()):
            c, i = symbols[:m], out[:m]
            ones = self.levels[level].rank(self.starts[level][c] + i) - self.ones[level][c]
            out[:m] = np.where(self.bits[level][c], ones, i - ones)
        return out


class FmIndex:
    """Backward search over token sequences: `tokens` ends each sequence with 0, `places` has the id place of each token."""

    def __init__(self, tokens: np.ndarray, places: np.ndarray, window: int) -> None:
        self.window = window
        # Symbols by falling counts.
        counts = np.bincount(tokens)
        order = np.argsort(-counts, kind="stable")
        symbol = np.empty(len(order), np.int64)
        symbol[order] = np.arange(len(order))
        self.tokens, counts = symbol[tokens], counts[order]
        suffixes, rank, upto = self.sorted_suffixes(self.tokens, window + 1, 1 << (window.bit_length() - 1))
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.wavelet = Wavelet(self.tokens[suffixes - 1], counts)
        # Suffixes that agree in `window` tokens: those of the two powers of two that cover it.
        padded = np.append(rank, np.full(window, -1))
        a, b = padded[suffixes], padded[suffixes + window - upto]
        edge = np.ones(len(suffixes), bool)
        edge[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.group = np.cumsum(edge) - 1
        self.edges = np.append(np.flatnonzero(edge), len(suffixes))
        self.least = np.minimum.reduceat(places[suffixes], self.edges[:-1])

    @staticmethod
    def sorted_suffixes(tokens: np.ndarray, depth: int, keep: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Suffixes in the order of at least their first `depth` tokens, by doubling; the ranks by the first `keep` tokens."""
        n, rank, done, kept = len(tokens), tokens, 1, tokens
        while True:
            after = np.zeros(n, np.int64)
            after[: max(n - done, 0)] = rank[done:] + 1
            key = rank * (int(rank.max()) + 2) + after
            suffixes = np.argsort(key)
            ordered = key[suffixes]
            rank = np.empty(n, np.int64)
            rank[suffixes] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            done *= 2
            if done == keep:
                kept = rank
            if done >= depth:
                return suffixes, kept, keep

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the matches with one token more on their left."""
        order = np.argsort(-symbols)  # the rarest, so the longest codes, first
        c = symbols[order]
        ranks = self.wavelet.rank(np.repeat(c, 2), np.stack([low[order], high[order]], 1).reshape(-1)).reshape(-1, 2)
        out = np.empty_like(ranks)
        out[order] = ranks + self.first[c][:, None]
        return out[:, 0], out[:, 1]

    def stream(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The least place of the documents that have the window that starts at each token; stretches of tokens are matched from
        right to left, all in step. Elsewhere LAST."""
        found = np.full(len(self.tokens), LAST)
        order = np.argsort(starts - stops)  # longest first
        starts, stops = starts[order], stops[order]
        lengths = stops - starts
        low = high = np.zeros(0, np.int64)
        for step in range(int(lengths[0]) if len(lengths) else 0):
            m = int(np.searchsorted(-lengths, -step, "left"))
            at = stops[:m] - 1 - step
            symbols = self.tokens[at]
            if step:
                low, high = self.extend(symbols, low[:m], high[:m])
            else:
                low, high = self.first[symbols], self.first[symbols + 1]
            if step + 1 >= self.window:
                # The match is longer than a window by one word at most: cut it back.
                group = self.group[low]
                low, high = self.edges[group], self.edges[group + 1]
                found[at] = self.least[group]
        return found


def stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - edge[::2]


def search(texts: pa.Array, places: np.ndarray, window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each segment the windows, as starts and lengths of runs, that one of a smaller place has too."""
    distinct = texts.dictionary_encode()
    which, spelled = distinct.indices.to_numpy(), distinct.dictionary
    least = np.full(len(spelled), LAST)
    np.minimum.at(least, which, places)
    split = pc.split_pattern(spelled, " ")
    n = split.value_lengths().to_numpy().astype(np.int64)
    words = split.flatten().dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    begin = np.concatenate([[0], np.cumsum(n + 1)])
    tokens = np.zeros(begin[-1], np.int64)
    inside = np.ones(len(tokens), bool)
    inside[begin[1:] - 1] = False
    tokens[inside] = words
    index = FmIndex(tokens, np.repeat(least, n + 1), window)
    pieces = np.maximum(-(-(n - window + 1) // PIECE), 0)
    piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(begin[:-1], pieces) + piece * PIECE
    stops = np.minimum(starts + PIECE + window - 1, np.repeat(begin[1:] - 1, pieces))
    found = index.stream(starts, stops)
    own = [stretches(found[a : a + m] < p) for a, m, p in zip(begin[:-1], np.maximum(n - window + 1, 0), least, strict=True)]
    whole = lambda i: (np.zeros(1, np.int64), n[i : i + 1] - window + 1)
    return [own[i] if p == least[i] else whole(i) for i, p in zip(which, places, strict=True)]


RUNS = "cid long, start long, windows long"
CUT = "anchor long, cid long, place long, start long, text string"


def _searched(window: int, shard: int):
    """RUNS found among rows of CUT that come in the order of their anchors."""

    def emitted(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(rows).combine_chunks()
        cid, start = held.column("cid").to_numpy(), held.column("start").to_numpy()
        found = search(held.column("text").combine_chunks(), held.column("place").to_numpy(), window)
        again = np.repeat(np.arange(len(found)), [len(a) for a, _ in found])
        at = np.concatenate([a for a, _ in found])
        if len(again):
            yield pa.RecordBatch.from_arrays([pa.array(cid[again]), pa.array(start[again] + at), pa.array(np.concatenate([b for _, b in found]))], ["cid", "start", "windows"])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            anchors = batch.column("anchor").to_numpy()
            sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.flatnonzero(anchors[1:] != anchors[:-1]) + 1, [len(anchors)]])
            sums, begun = np.concatenate([[0], np.cumsum(sizes)]), 0
            for a in edges[:-1].tolist() if len(anchors) else []:
                # A shard ends only between two anchors.
                if size + sums[a] - sums[begun] >= shard * 6 and anchors[a] != (anchors[a - 1] if a else last):
                    if a > begun:
                        rows.append(batch.slice(begun, a - begun))
                    yield from emitted(rows)
                    rows, size, begun = [], 0, a
            rows.append(batch.slice(begun))
            size += int(sums[-1] - sums[begun])
            last = anchors[-1] if len(anchors) else last
        if rows and sum(r.num_rows for r in rows):
            yield from emitted(rows)

    return searched


def _cut(window: int):
    """CUT rows of (cid, place, text, segments)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for cid, place, text, segments in zip(*(batch.column(c) for c in ("cid", "place", "text", "segments")), strict=True):
                held = joined_words(text.as_py())
                ends = np.concatenate([[-1], word_ends(np.frombuffer(held, np.uint8))])
                cid, place, parts = cid.as_py(), place.as_py(), segments.values
                for anchor, start, run in zip(*(parts.field(f).to_pylist() for f in ("anchor", "start", "run")), strict=True):
                    piece = held[ends[start] + 1 : ends[start + run + window - 1]]
                    rows.append((anchor, cid, place, start, piece))
                    size += len(piece)
                    if size >= BATCH:
                        yield made(rows)
                        rows, size = [], 0
            if rows:
                yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        anchor, cid, place, start, text = zip(*rows, strict=True)
        long = lambda x: pa.array(x, pa.int64())
        return pa.RecordBatch.from_arrays([long(anchor), long(cid), long(place), long(start), pa.array(text, pa.binary()).cast(pa.string())], [x.split()[0] for x in CUT.split(", ")])

    return cut


SINGLE = "cid long, place long, start long, h1 long, h2 long"


def _single(window: int):
    """SINGLE rows, one a window, of (cid, place, text, segments)."""

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, place, text, segments in zip(*(batch.column(c) for c in ("cid", "place", "text", "segments")), strict=True):
                data = np.frombuffer(joined_words(text.as_py()), np.uint8)
                ends = word_ends(data)
                words = tn.word_hashes(data, np.concatenate([[0], ends[:-1] + 1]), ends)
                one, two = tn.shingle_hashes(words, window), tn.shingle_hashes(tn.mix64(words ^ np.uint64(tn.BASE)), window)
                parts = segments.values
                starts = np.concatenate([np.arange(a, a + n) for a, n in zip(parts.field("start").to_pylist(), parts.field("run").to_pylist(), strict=True)])
                for at in (starts[i : i + 100_000] for i in range(0, len(starts), 100_000)):
                    same = lambda x: pa.array(np.full(len(at), x.as_py()))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([same(cid), same(place), pa.array(at), pa.array(tn.signed(one[at])), pa.array(tn.signed(two[at]))], [x.split()[0] for x in SINGLE.split(", ")])

    return single


def split_hot(big: DataFrame, small: DataFrame, on: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """big joined with small(on, n, ...), n rows of big to a key: the part of the keys of more than limit rows, and the rest.

    Hot keys are few (all rows of big / limit at most), so they are broadcast and their rows stay where they are.
    """
    hot = stored(small.where(F.col("n") > limit), "substring-hot").drop("n")
    cold = small.where(F.col("n") <= limit).drop("n")
    if not hot.head(1):
        return big.join(F.broadcast(hot), on), big.join(cold, on)
    return big.join(F.broadcast(hot), on), big.join(F.broadcast(hot.select(on)), on, "left_anti").join(cold, on)


def limit_of(rows: int) -> int:
    return max(HOT, -(-rows // HOT_KEYS))


def with_segments(found: DataFrame, texts: DataFrame) -> DataFrame:
    """cid, place, text, segments of the classes in found(cid, anchor, start, run)."""
    lists = found.groupBy("cid").agg(F.collect_list(F.struct("anchor", "start", "run")).alias("segments"))
    return texts.join(lists, "cid")


VERDICT = "cid long, n_removed long, kept binary, spans array<struct<first:long,length:long>>"


def _judged(window: int):
    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cid, text, runs in zip(*(batch.column(c) for c in ("cid", "text", "runs")), strict=True):
                words = (text.as_py() or "").encode().split()
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, runs.values.field("start").to_numpy(), 1)
                np.add.at(gone, runs.values.field("start").to_numpy() + runs.values.field("windows").to_numpy() + window - 1, -1)
                gone = np.cumsum(gone[:-1]) > 0
                kept = hashlib.sha256(b" ".join(w for w, x in zip(words, gone.tolist(), strict=True) if not x)).digest()
                spans = [{"first": int(a), "length": int(b)} for a, b in zip(*stretches(gone), strict=True)]
                rows.append((cid.as_py(), int(gone.sum()), kept, spans))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("first", pa.int64()), ("length", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["cid", "n_removed", "kept", "spans"])

    return judged


def repeats(docs: DataFrame, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """row_id, doc_id, n_words, n_removed, kept (SHA-256 of the kept words), spans (first word and length of what is removed)
    of every row of docs(row_id, doc_id, text)."""
    docs = docs.select("row_id", "doc_id", "text")
    rows = stored(described(docs, window), "substring-rows")
    long = rows.where(F.col("n_words") >= window)
    classes = long.groupBy("words").agg(F.count("*").alias("n"), F.min(F.struct("place", "row_id")).alias("one"), *[F.first(c).alias(c) for c in ("anchors", "starts", "runs")])
    # cid is given when the table is written, so no two classes share one.
    classes = stored(classes.select("words", "n", "one.place", "one.row_id", "anchors", "starts", "runs", F.monotonically_increasing_id().alias("cid")), "substring-classes")
    zipped = F.arrays_zip(F.col("anchors").alias("anchor"), F.col("starts").alias("start"), F.col("runs").alias("run"))
    segments = classes.select("cid", F.explode(zipped).alias("s")).select("cid", "s.anchor", "s.start", "s.run")
    # An anchor's size is that of its words, in pieces: a few long repetitions are as much as many common segments.
    pieces = F.sum(F.ceil((F.col("run") + (window - 1)) / PIECE)).cast("long")
    counts = segments.groupBy("anchor").agg(pieces.alias("n"), F.min("cid").alias("a"), F.max("cid").alias("b")).where("a < b").select("anchor", "n")
    counts = stored(counts, "substring-anchors")
    n_pieces = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot, cold = (stored(x, "substring-segments") for x in split_hot(segments, counts, ["anchor"], limit_of(n_pieces)))
    wanted = stored(hot.select("cid").union(cold.select("cid")).distinct().join(classes.select("cid", "place", "row_id"), "cid"), "substring-wanted")
    ids = F.broadcast(wanted) if wanted.count() <= HOT_KEYS else wanted
    texts = stored(docs.select("row_id", "text").join(ids, "row_id").dropDuplicates(["cid"]).select("cid", "place", "text"), "substring-texts")
    cut = with_segments(cold, texts).mapInArrow(_cut(window), CUT)
    found = cut.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_searched(window, shard), RUNS)
    if hot.head(1):
        single = stored(with_segments(hot, texts).mapInArrow(_single(window), SINGLE), "substring-windows")
        least = single.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("place").alias("low"), F.max("place").alias("high")).where("low < high").drop("high")
        least = stored(least, "substring-least")
        both = split_hot(single, least, ["h1", "h2"], limit_of(single.count()))
        for some in both:
            found = found.union(some.where("low < place").select("cid", "start", F.lit(1).cast("long").alias("windows")))
    found = stored(found, "substring-runs")
    gone = found.groupBy("cid").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
    verdicts = texts.select("cid", "text").join(gone, "cid").mapInArrow(_judged(window), VERDICT)
    judged = classes.select("words", "n", "place", "cid").withColumnRenamed("place", "least").join(verdicts, "cid", "left").drop("cid")
    judged = stored(judged, "substring-judged")
    later = F.col("place") > F.col("least")
    everything = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_words").alias("length")))
    nothing = F.array().cast("array<struct<first:long,length:long>>")
    out = []
    for some in split_hot(long.drop("anchors", "starts", "runs"), judged, ["words"], limit_of(long.count())):
        out.append(some.select(
            "row_id", "doc_id", "n_words", F.when(later, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(later, F.lit(hashlib.sha256(b"").digest())).otherwise(F.coalesce("kept", "words")).alias("kept"),
            F.when(later, everything).otherwise(F.coalesce("spans", nothing)).alias("spans"),
        ))
    short = rows.where(F.col("n_words") < window).select("row_id", "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("words").alias("kept"), nothing.alias("spans"))
    return out[0].union(out[1]).union(short)


@F.pandas_udf(T.StringType())
def _without(text: pd.Series, first: pd.Series, length: pd.Series) -> pd.Series:
    out = []
    for held, starts, lengths in zip(text, first, length, strict=True):
        words = np.array(held.encode().split(), object)
        stays = np.ones(len(words), bool)
        for a, n in zip(starts, lengths, strict=True):
            stays[a : a + n] = False
        out.append(b" ".join(words[stays]).decode())
    return pd.Series(out, dtype=object)


def cleaned(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with texts that lose words written as the kept words, joined by one space; other texts and columns as they are."""
    found = repeats(keyed(docs), window).where("n_removed > 0")
    # Rows repeated as they are have one key and equal spans (a partial choice in each task, so no key is hot).
    spans = stored(found.select("row_id", "spans").dropDuplicates(["row_id"]), "substring-spans")
    held = docs.select(row_key(docs).alias("row_id"), whole_row(docs).alias("row"))
    changed = held.join(spans, "row_id").withColumn("_text", _without(F.col("row")["text"], F.col("spans.first"), F.col("spans.length")))
    changed = changed.select(F.struct(*[(F.col("_text") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns]).alias("row"))
    return held.join(spans.select("row_id"), "row_id", "left_anti").select("row").unionByName(changed).select("row.*")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(row_key(docs).alias("row_id"), column("doc_id").cast("long").alias("doc_id"), column("text").alias("text"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats(keyed(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", "n_words", "n_removed", F.lower(F.hex("kept")).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT r, doc_id, i, array_to_string(w[i:i + 49], ' ') AS phrase
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), f AS (SELECT phrase, min(coalesce(doc_id, 9223372036854775807)) AS low FROM g GROUP BY 1
), x AS (
  SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM g JOIN f ON g.phrase = f.phrase WHERE low < coalesce(doc_id, 9223372036854775807)
), y AS (SELECT r, count(*) AS n, list(p) AS gone FROM x GROUP BY 1
), k AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS kept FROM (SELECT d.r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) a
  ANTI JOIN x ON a.r = x.r AND a.p = x.p GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN y ON d.r = y.r LEFT JOIN k ON d.r = k.r
"""
