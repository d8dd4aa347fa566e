"""Operator 1, benchmark decontamination: a distributed positional inverted index.

`build_index` stores the training text as index segments of about SEGMENT_TOKENS tokens of whole documents: the
segment's terms in order, the posting list of each (positions in the segment, a gap between documents), and the
documents' places. A segment is self-contained, so building needs no shuffle and a lost one is rebuilt from its input.
`search` takes the benchmark in blocks of bounded size; each block goes to all segments. A phrase's candidates are the
postings of its rarest term in the segment, adjusted by the term's offset; the lists of the other terms, rarest first,
are intersected with them until none is left. Terms are found by 64-bit word hashes and compared with the segment's
spelling of them, so that no other word passes for one. `proximity` finds stretches of at most span
words of one document that hold all terms of a window, each as often as the window does, in any order, from the same lists.

Defined cases: null text has no words, so the document is clean with n_words 0 and the benchmark item has no window; a
null item_id is one item named `null`; rows of one item_id count as one item, each row's windows on their own; rows of
documents, repeated or not, are judged one by one; a very long document makes one large segment, a very long item one
large block, both whole; ties in rarity keep the phrase's order, which changes no result; an empty benchmark leaves all
documents clean; an empty table gives an empty result; other columns are ignored by `judge`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from babelmill.llm import textnum as tn
from babelmill.llm.common import stored, table

WINDOW, SEGMENT_TOKENS, GAP = 13, 1 << 18, 64
#: Bytes of benchmark text that one block (sent to every task) may hold.
BLOCK_BYTES = 2 << 20
INDEX = "segment long, row_ids array<{}>, n_words array<int>, terms binary, spellings binary, ends binary, counts binary, postings binary"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId() << 32
    made = 0
    hashes: list[np.ndarray] = []
    ids: list[list] = []
    sizes: list[np.ndarray] = []
    held_bytes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    tokens = 0

    def done() -> pa.RecordBatch:
        words, n = np.concatenate(hashes), np.concatenate(sizes)
        starts = doc_starts(n)
        place = np.arange(len(words)) + np.repeat(starts - (np.cumsum(n) - n), n)
        order = np.argsort(words, kind="stable")
        terms, first, counts = np.unique(words[order], return_index=True, return_counts=True)
        held = place[order]
        delta = np.diff(held, prepend=0)  # within a term's list: steps; its first place stays as it is
        delta[first] = held[first]
        spellings, ends = spelled(held_bytes, order[first])
        row = [
            [task + made], [sum(ids, [])], [n.tolist()], [terms.tobytes()], [spellings.tobytes()], [ends.tobytes()],
            [counts.astype(np.int32).tobytes()], [delta.astype(np.int32).tobytes()],
        ]
        kinds = [pa.int64(), pa.list_(kind), pa.list_(pa.int32()), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["segment", "row_ids", "n_words", "terms", "spellings", "ends", "counts", "postings"])

    for batch in batches:
        row_ids, kind = batch.column("row_id").to_pylist(), batch.schema.field("row_id").type
        for first_row, offsets, data in tn.chunks(batch.column("text")):
            starts, ends, first = tn.word_spans(data, offsets, tn.ALNUM)
            hashes.append(tn.word_hashes(data, starts, ends))
            held_bytes.append((data, starts, ends))
            sizes.append(np.diff(first))
            ids.append(row_ids[first_row : first_row + len(offsets) - 1])
            tokens += len(starts)
            if tokens >= SEGMENT_TOKENS:
                yield done()
                made, tokens, hashes, ids, sizes, held_bytes = made + 1, 0, [], [], [], []
    if hashes:
        yield done()


def spelled(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some words of the runs (data, starts, ends) of texts, end to end, and where each ends."""
    begin = np.cumsum([0] + [len(data) for data, _, _ in held[:-1]])
    starts = np.concatenate([a + b for (_, a, _), b in zip(held, begin, strict=True)])[which]
    sizes = np.concatenate([z - a for _, a, z in held])[which].astype(np.int64)
    ends = np.cumsum(sizes)
    at = np.repeat(starts - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
    return np.concatenate([data for data, _, _ in held])[at], ends


def doc_starts(n: np.ndarray) -> np.ndarray:
    """Place of each document's first word: documents stand GAP places apart."""
    return np.cumsum(n + GAP) - n - GAP


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of docs(row_id, text); row_id may be of any simple type."""
    docs = docs.select("row_id", "text")
    return stored(docs.mapInArrow(_segments, INDEX.format(docs.schema["row_id"].dataType.simpleString())), "positional-index", large_rows=True)


class Phrases:
    """Windows of benchmark items as a matrix of terms: -1 pads windows of fewer words."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW) -> None:
        rows, owner = [], []
        spelled: dict[int, bytes] = {}
        self.items = [i for i, _ in items]
        for at, (_, text) in enumerate(items):
            for _, offsets, data in tn.chunks(pa.array([text], pa.large_string())):
                starts, ends, _ = tn.word_spans(data, offsets, tn.ALNUM)
                words = tn.word_hashes(data, starts, ends)
                spelled |= {h: data[a:b].tobytes() for h, a, b in zip(words.tolist(), starts, ends, strict=True)}
                if 0 < len(words) < window:
                    rows.append(np.concatenate([words, np.zeros(window - len(words), np.uint64)])[None])
                    owner.append(np.array([[at, len(words)]]))
                elif len(words):
                    rows.append(np.lib.stride_tricks.sliding_window_view(words, window))
                    owner.append(np.column_stack([np.full(len(rows[-1]), at), np.full(len(rows[-1]), window)]))
        words = np.concatenate(rows) if rows else np.zeros((0, window), np.uint64)
        owner = np.concatenate(owner) if owner else np.zeros((0, 2), np.int64)
        self.item, self.length = owner[:, 0], owner[:, 1]
        self.terms, inverse = np.unique(words.reshape(-1), return_inverse=True)
        self.spellings = [spelled.get(t, b"") for t in self.terms.tolist()]
        self.windows = inverse.reshape(words.shape).astype(np.int64)
        self.windows[np.arange(window)[None, :] >= self.length[:, None]] = -1


class Segment:
    def __init__(self, terms: bytes, spellings: bytes, ends: bytes, counts: bytes, postings: bytes) -> None:
        self.terms = np.frombuffer(terms, np.uint64)
        self.spellings, self.ends = spellings, np.frombuffer(ends, np.int64)
        self.counts = np.frombuffer(counts, np.int32).astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        steps = np.frombuffer(postings, np.int32).astype(np.int64)
        total = np.cumsum(steps)
        before = total[self.first] - steps[self.first] if len(steps) else total
        self.postings = total - np.repeat(before, self.counts)
        #: (term, place) as one number, ascending: what membership is looked up in.
        self.keys = (np.repeat(np.arange(len(self.terms)), self.counts) << 34) + self.postings

    def look_up(self, phrases: Phrases) -> np.ndarray:
        """This segment's number of each term of the phrases, or -1; terms are compared by their bytes."""
        terms = phrases.terms
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        found = np.where(self.terms[at] == terms, at, -1)
        for i in np.flatnonzero(found >= 0).tolist():
            t = int(at[i])
            if self.spellings[self.ends[t - 1] if t else 0 : self.ends[t]] != phrases.spellings[i]:
                found[i] = -1
        return found

    def holds(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = (term << 34) + place
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (self.keys[at] == key) & (place >= 0)

    def candidates(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Alive windows with their terms in order of rarity, and the places of each one's rarest term."""
        term = np.where(windows >= 0, windows, 0)
        n = np.where(windows >= 0, self.counts[term], np.iinfo(np.int64).max)
        order = np.argsort(n, axis=1, kind="stable")
        rarest = term[np.arange(len(term)), order[:, 0]]
        many = self.counts[rarest]
        which = np.repeat(np.arange(len(term)), many)
        place = self.postings[np.repeat(self.first[rarest] - (np.cumsum(many) - many), many) + np.arange(len(which))]
        return order, which, place, term

    def exact(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(window, first place) of every occurrence of every window."""
        local = self.look_up(phrases)
        windows = np.where(phrases.windows >= 0, local[phrases.windows], -2)
        alive = np.flatnonzero((windows != -1).all(axis=1))
        if not len(alive) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        windows = windows[alive]
        order, which, place, term = self.candidates(windows)
        start = place - order[which, 0]
        for k in range(1, windows.shape[1]):
            offset = order[which, k]
            wanted = windows[which, offset] >= 0
            ok = ~wanted | self.holds(term[which, offset], start + offset)
            which, start = which[ok], start[ok]
            if not len(which):
                break
        return alive[which], start

    def proximity(self, phrases: Phrases, span: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, first place, last place) of the shortest stretches within `span` words of a document that hold all
        terms of a window, each as often as the window does. `starts` are the places where documents begin."""
        none = np.zeros(0, np.int64)
        local = self.look_up(phrases)
        windows = np.where(phrases.windows >= 0, local[phrases.windows], -2)
        alive = np.flatnonzero((windows != -1).all(axis=1))
        if not len(alive) or not len(self.keys):
            return none, none, none
        # The same terms in another order are one search.
        sets, back = np.unique(np.sort(windows[alive], axis=1), axis=0, return_inverse=True)
        back = back.reshape(-1)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for terms in sets:
            term, times = np.unique(terms[terms >= 0], return_counts=True)
            order = np.argsort(self.counts[term], kind="stable")
            ends = None
            for i in order:
                place = self.postings[self.first[term[i]] : self.first[term[i]] + self.counts[term[i]]]
                if ends is None:
                    rare, ends = place, np.zeros(0, np.int64)
                # Only what stands near the rarest term can be in a match.
                if i != order[0]:
                    at = np.searchsorted(rare, place)
                    near = np.minimum(np.abs(rare[np.minimum(at, len(rare) - 1)] - place), np.abs(rare[np.maximum(at - 1, 0)] - place)) < span
                    place = place[near]
                if len(place) < times[i]:
                    ends = None
                    break
                ends = np.concatenate([ends, place])
            if ends is None:
                held.append((none, none))
                continue
            # For every end, the latest place at which each term has been seen often enough since.
            ends = np.sort(ends)
            low = np.full(len(ends), np.iinfo(np.int64).max)
            for t, n in zip(term, times, strict=True):
                place = self.postings[self.first[t] : self.first[t] + self.counts[t]]
                at = np.searchsorted(place, ends, "right") - n
                low = np.minimum(low, np.where(at >= 0, place[np.maximum(at, 0)], -1))
            same = np.searchsorted(starts, np.maximum(low, 0), "right") == np.searchsorted(starts, ends, "right")
            ok = (low >= 0) & (ends - low < span) & same
            low, ends = low[ok], ends[ok]
            first = np.flatnonzero(np.diff(low, prepend=-1))  # the shortest of those that begin at one place
            held.append((low[first], ends[first]))
        which = np.repeat(np.arange(len(alive)), [len(held[i][0]) for i in back])
        return alive[which], np.concatenate([held[i][0] for i in back]), np.concatenate([held[i][1] for i in back])


SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
FOUND = "segment long, ordinal int, row_id {}, n_words long, spans array<struct<a:int,b:int>>, items array<string>"


def search(index: DataFrame, block: list[tuple[str, str | None]], all_rows: bool, span: int | None = None) -> DataFrame:
    """segment, ordinal (a document row), row_id, n_words, spans (words [a, b) hit, merged), items: matches of a block of
    (item, text) in each document.

    With `span`, proximity matches: a hit is then a shortest stretch of at most span words that holds all terms.
    """
    phrases = index.sparkSession.sparkContext.broadcast(Phrases(block))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = phrases.value
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(name)[row]  # noqa: B023, E731
                n = np.asarray(get("n_words").values, np.int64)
                ids = get("row_ids").values
                starts = doc_starts(n)
                segment = Segment(*(get(x).as_py() for x in ("terms", "spellings", "ends", "counts", "postings")))
                if span is None:
                    window, place = segment.exact(p)
                    length = p.length[window]
                else:
                    window, place, last_place = segment.proximity(p, span, starts)
                    length = last_place - place + 1
                doc = np.searchsorted(starts, place, "right") - 1
                found: dict[int, tuple[list, list]] = {}
                by_doc = np.argsort(doc, kind="stable")
                cut = np.flatnonzero(np.diff(doc[by_doc])) + 1
                for group in np.split(by_doc, cut) if len(by_doc) else []:
                    d = int(doc[group[0]])
                    a = place[group] - starts[d]
                    b = a + length[group]
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], np.maximum.accumulate(b[order])
                    new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
                    last = np.concatenate([new[1:] - 1, [len(a) - 1]])
                    found[d] = ([{"a": int(x), "b": int(y)} for x, y in zip(a[new], b[last], strict=True)], [p.items[i] for i in np.unique(p.item[window[group]])])
                rows = list(range(len(n))) if all_rows else sorted(found)
                out = [found.get(i, ([], [])) for i in rows]
                at = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([get("segment").as_py()] * len(rows), pa.int64()), at, ids.take(at), pa.array(n[rows], pa.int64()), pa.array([x[0] for x in out], SPANS), pa.array([x[1] for x in out], pa.list_(pa.string()))],
                    ["segment", "ordinal", "row_id", "n_words", "spans", "items"],
                )

    return index.mapInArrow(find, FOUND.format(index.schema["row_ids"].dataType.elementType.simpleString()))


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark's items, some BLOCK_BYTES at a time."""
    held, size = [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), "text").toLocalIterator():
        held.append((row["i"], row["text"]))
        size += len((row["text"] or "").encode())
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    yield held


def match(docs: DataFrame, benchmark: DataFrame, span: int | None = None) -> DataFrame:
    """row_id, n_words, spans, items: one row a row of docs(row_id, text); row_id need not be unique."""
    index = build_index(docs)
    parts = [search(index, block, at == 0, span) for at, block in enumerate(blocks(benchmark))]
    found = reduce(DataFrame.unionByName, parts)
    return found if len(parts) == 1 else found.groupBy("segment", "ordinal").agg(
        F.first("row_id").alias("row_id"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )


def covered(spans: str) -> F.Column:
    """Words in at least one of the spans, which are in order."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda s, x: F.struct(
        (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["end"]))).cast("long").alias("n"), F.greatest(s["end"], x["b"]).alias("end")
    )
    return F.aggregate(spans, start, step, lambda s: s["n"])


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """row_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans of every row of docs(row_id, text)."""
    found = match(docs, benchmark)
    items = F.array_sort(F.array_distinct("items"))
    found = found.select("row_id", "n_words", covered("spans").alias("n_hit"), items.alias("items"), "spans")
    return found.select(
        "row_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"), "items", "spans",
    )


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")
    return judge(docs, table(spark, sf_dir, "benchmark")).withColumnRenamed("row_id", "doc_id").drop("items", "spans")


def op1_proximity(spark: SparkSession, sf_dir: str, span: int = 2 * WINDOW) -> DataFrame:
    """doc_id, n_words, n_near, n_near_items, near_items_sha256: the proximity matches of every document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")
    found = match(docs, table(spark, sf_dir, "benchmark"), span)
    items = F.array_sort(F.array_distinct("items"))
    return found.select(
        F.col("row_id").alias("doc_id"), "n_words", covered("spans").alias("n_near"), F.size(items).cast("long").alias("n_near_items"),
        F.sha2(F.array_join(items, ","), 256).alias("near_items_sha256"),
    )
