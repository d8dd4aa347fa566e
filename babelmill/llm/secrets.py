"""Operator 10, secret scans: candidates judged by a random forest that removes false positives.

Candidates are, anywhere in a whole text: runs of at least LEAST key characters, digits or not; such runs joined by dots,
as a whole and each long part; and every value that follows a name holding a key word, after `=` or `:` or in quotes,
whatever its characters and length. An assignment's name is left out. What is a secret is left to the forest. Features: length, entropy, shares of character kinds, how usual the candidate's character transitions are in the
corpus (counted over all texts), the share of it that words of the dictionary cover (the LEXICON most frequent words of the
corpus, counted over all texts, and a short fixed list), what its path looks like, and its neighbouring words. The forest
(Spark ML) is trained on labelled findings; `scan` takes any table of them. Without one it learns from TRAIN_ROWS findings made from seeded
public key formats and look-alikes, and from up to TABLE_ROWS findings of each label in the texts themselves: those are
the documented bounds of the training sample. `labelled` says how findings of the texts get their labels; documents whose hash is in HELD_OUT
are never learned from. All candidates of all texts are then scored in the JVM.

Defined cases: null text has no candidates; a null path is empty; findings of repeated rows are repeated; candidates
may overlap (a dotted run and its parts, a value with and without the marks that end it), and a place is judged once for
each start and end; a value that is not in quotes ends at white space; a null doc_id is kept; very long texts are searched whole;
words of equal counts enter the dictionary in the order of their spelling, findings the sample in that of their hashes, so
that runs agree; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from babelmill.llm import textnum as tn
from babelmill.llm.common import stored, table

LEAST, TRAIN_ROWS, AROUND, SEED = 12, 6000, 48, 10
#: Words of the corpus in the dictionary, the letters of one; findings of the texts to learn from, of each label.
LEXICON, SHORT, LONG, TABLE_ROWS = 20000, 4, 20, 3000
#: Documents whose hash modulo the first is the second are never learned from.
HELD_OUT = (5, 3)
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}={0,2}(?![A-Za-z0-9+/_-])", re.ASCII)
DOTTED = re.compile(r"(?<![A-Za-z0-9+/_-])(?<![A-Za-z0-9+/_-]\.)[A-Za-z0-9+/_-]+(?:\.[A-Za-z0-9+/_-]+)+={0,2}", re.ASCII)

MARK = re.compile("[=:\"'`]")
_QUOTED = "|".join(rf"{q}(?P<{name}>(?:\\.|[^{q}\\\n])+){q}" for q, name in (('"', "double"), ("'", "single"), ("`", "back")))
QUOTED = re.compile(_QUOTED)
#: What follows an assignment's mark: a quoted value, else all up to white space.
ASSIGNED = re.compile(rf"(?:=>|:=|={{1,3}}|:)\s*(?:{_QUOTED}|[\"'`]?(?P<bare>\S+))")

# Words that speak for or against a secret beside or in a candidate.
KEY_WORDS = ("access", "api", "auth", "bearer", "credential", "key", "passwd", "password", "private", "pwd", "secret", "token")
PLAIN_WORDS = ("build", "checksum", "commit", "digest", "file", "html", "http", "https", "id", "image", "md5", "page", "ref", "sha", "sha1", "sha256", "uuid", "version", "www")
DICTIONARY = (
    "about", "action", "address", "android", "application", "archive", "article", "backup", "build", "button", "center", "chapter", "class", "client",
    "color", "commit", "config", "content", "core", "data", "default", "document", "download", "error", "example", "feature", "figure", "file", "folder",
    "form", "general", "header", "history", "home", "html", "http", "image", "index", "item", "library", "line", "link", "list", "local", "log", "mail",
    "main", "manager", "media", "message", "model", "module", "name", "network", "number", "office", "order", "page", "part", "photo", "picture", "post",
    "print", "product", "project", "public", "query", "record", "release", "report", "resource", "result", "sample", "screen", "script", "section",
    "server", "service", "session", "setting", "site", "source", "standard", "static", "style", "system", "table", "test", "text", "thumb", "title",
    "update", "upload", "user", "value", "version", "video", "view", "web", "widget", "window",
)
#: A name that holds a key word, at the end of what stands before a mark.
_NAME = rf"(?:{'|'.join(KEY_WORDS)})[\w.-]*"
NAMED = re.compile(rf"{_NAME}[\"'`)\]]*\s*$")
NAMED_QUOTE = re.compile(rf"{_NAME}(?:\s+(?:is|was|of|to))?(?:\s+|\s*[(\[]\s*)$")
#: A key word stands at most so many characters before its value's mark.
NAME_CHARS = 512
ENDING = ".,;:!?)]}>\"'`"
WORD = re.compile(rf"(?<![a-z0-9])[a-z]{{{SHORT},{LONG}}}(?![a-z0-9])")
FEATURES = (
    "length", "entropy", "digits", "uppers", "lowers", "marks", "changes", "hex", "transition", "coverage", "path_test", "in_path",
    "key_before", "plain_before", "assigned", "quoted",
)


def transitions(docs: DataFrame) -> np.ndarray:
    """log2 probability of each byte after each byte, within all texts of the corpus; the same however these are dealt."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(65536, np.int64)
        for batch in batches:
            for _, offsets, data in tn.chunks(batch.column("text")):
                if len(data) > 1:
                    inside = np.ones(len(data) - 1, bool)
                    inside[[x - 1 for x in offsets[1:-1] if 0 < x < len(data)]] = False  # no step leads from one text to the next
                    total += np.bincount((data[:-1].astype(np.int32) * 256 + data[1:])[inside], minlength=65536)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pair", "n"])

    counts = np.ones((256, 256))
    # At most 65536 rows: pairs of bytes.
    for r in docs.select("text").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["pair"] >> 8, r["pair"] & 255] += r["n"]
    return np.log2(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def lexicon(docs: DataFrame, size: int = LEXICON) -> frozenset[str]:
    """The most frequent words of all texts, lower case: a bounded number, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text"):
                held.update(WORD.findall((text.as_py() or "").lower()))
                if len(held) >= 1 << 17:  # handed on before a task holds too many
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
                    held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    counts = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    return frozenset(r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(size).select("word").collect()) | frozenset(DICTIONARY)


def covered(text: str, words: frozenset[str]) -> int:
    """Characters of a text under words, the longest at each place from left to right."""
    at = total = 0
    while at + SHORT <= len(text):
        for n in range(min(LONG, len(text) - at), SHORT - 1, -1):
            if text[at : at + n] in words:
                at, total = at + n, total + n
                break
        else:
            at += 1
    return total


def features(found: str, before: str, after: str, path: str, steps: np.ndarray, words: frozenset[str] = frozenset(DICTIONARY)) -> list[float]:
    n = len(found)
    lower = found.lower()
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "m" for c in found]
    share = lambda k: kinds.count(k) / n
    counts = [found.count(c) for c in set(found)]
    codes = np.frombuffer(lower.encode(), np.uint8)
    near = re.findall(r"[a-z0-9]+", before.lower())[-3:]
    return [
        float(n), -sum(c / n * math.log2(c / n) for c in counts), share("d"), share("u"), share("l"), share("m"),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n, float(all(c in "0123456789abcdef" for c in lower)),
        float(steps[codes[:-1], codes[1:]].mean()) if len(codes) > 1 else 0.0, covered(lower, words) / n,
        float(bool(re.search(r"test|example|sample|mock|doc", path.lower()))), float(bool(re.search(r"[./@]$", before) or re.match(r"[./@]\w", after))),
        float(any(w in KEY_WORDS for w in near)), float(any(w in PLAIN_WORDS for w in near)),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))), float(bool(re.search(r"[\"']$", before) and re.match(r"[\"']", after))),
    ]


def spans(text: str) -> list[tuple[int, int]]:
    """Start and end of every candidate of a text, in order."""
    found = {m.span() for m in RUN.finditer(text)} | {m.span() for m in DOTTED.finditer(text) if m.end() - m.start() >= LEAST}
    for m in MARK.finditer(text):
        a = m.start()
        before = text[max(0, a - NAME_CHARS) : a].lower()
        if not any(k in before for k in KEY_WORDS):
            continue
        if m[0] in "=:":
            value = ASSIGNED.match(text, a) if NAMED.search(before) else None
        else:
            value = QUOTED.match(text, a) if NAMED_QUOTE.search(before) else None
        if value:
            start, end = value.span(value.lastgroup)
            found.add((start, end))
            if value.lastgroup == "bare":
                short = len(text[start:end].rstrip(ENDING))
                if short:
                    found.add((start, start + short))
    return sorted(found)


CANDIDATES = "doc_id long, start long, length int, digest string, features array<double>"


def candidates(docs: DataFrame, steps: np.ndarray, words: frozenset[str] = frozenset(DICTIONARY)) -> DataFrame:
    """CANDIDATES of docs(doc_id, text, path): where each is, the SHA-256 of it, and its features."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text, path in zip(batch.column("doc_id"), batch.column("text"), batch.column("path"), strict=True):
                text = text.as_py() or ""
                for a, b in spans(text):
                    held = features(text[a:b], text[max(0, a - AROUND) : a], text[b : b + AROUND], path.as_py() or "", steps, words)
                    rows.append((doc_id.as_py(), a, b - a, hashlib.sha256(text[a:b].encode()).hexdigest(), held))
                if len(rows) >= 5000:
                    yield made(rows)
                    rows = []
            if rows:
                yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in CANDIDATES.split(", ")])

    return docs.select("doc_id", "text", "path").mapInArrow(find, CANDIDATES)


def example(i: int) -> tuple[str, str, str, str, float]:
    """A labelled finding: before, found, after, path, label."""
    r = random.Random(f"{SEED}:{i}")
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    hexes, upper, mixed = "0123456789abcdef", string.ascii_uppercase + "234567", string.ascii_letters + string.digits
    words = lambda n: " ".join(r.choice(DICTIONARY) for _ in range(n))
    word = lambda: r.choice(DICTIONARY)
    path = r.choice(["", "", f"{word()}/{word()}", f"test/{word()}", f"src/{word()}"])
    if i % 2:
        kind = r.randrange(10)
        marked = "".join(r.choice([r.choice(mixed), r.choice("!@$%^&*#?")]) for _ in range(r.randrange(6, 20)))
        found = [
            "AKIA" + pick(upper, 16), pick(hexes, r.choice([18, 32, 40, 64])), pick(mixed, r.randrange(20, 48)), "ghp_" + pick(mixed, 36), pick(mixed + "+/", 40),
            "AKIA" + pick(string.ascii_uppercase, 16), "ghp_" + pick(string.ascii_letters, 36), "eyJ" + ".".join(pick(mixed + "_-", r.randrange(8, 40)) for _ in range(3)),
            r.choice([marked, f"{word()}{r.randrange(100)}{r.choice('!@$%*#')}{word()[:3]}"]), r.choice([pick(mixed, r.randrange(6, 16)), f"{pick(string.ascii_lowercase, 3)}{r.randrange(100, 100000)}", "".join(word() for _ in range(r.randrange(3, 5)))]),
        ][kind]
        lead = r.choice(KEY_WORDS)
        tight = [f"{lead}=", f'{lead} = "', f"{lead}: "]
        before = f"{words(3)} " + r.choice(["", *tight[::2]] if kind in (0, 3, 5, 6, 7) else tight if kind > 7 else [*tight, f"{lead} "])
        label = 1.0
    else:
        kind = r.randrange(13)
        found = [
            f"{word()}-{word()}-{r.randrange(3000)}", f"{word()}_{word()}_{r.randrange(100)}", pick(hexes, 40), f"{pick(hexes, 8)}-{pick(hexes, 4)}-{pick(hexes, 4)}-{pick(hexes, 12)}",
            pick(string.digits, r.randrange(12, 18)), f"{word()}{r.randrange(10)}{word()}{word()}", f"{word()}/{word()}/{word()}{r.randrange(100)}",
            f"{word()}{r.choice(['', '-', '/', '_'])}{word()}-{word()}", f"{word()}.{word()}.{r.choice(['com', 'org', word()])}", word(), r.choice([str(r.randrange(1000)), word().capitalize(), f"{word()},", "none", "true"]),
            "".join(word().capitalize() for _ in range(r.randrange(2, 4))), r.choice([f"{word()}{word()}".upper(), f"{word()}{word()}".capitalize()]),
        ][kind]
        plain = r.choice(PLAIN_WORDS)
        lead = r.choice(KEY_WORDS)
        before = f"{words(3)} " + (f"{plain}{r.choice([' ', ': ', '='])}" if kind in (2, 3) else r.choice([f"{lead}=", f"{lead}: ", f'{lead} = "']) if 8 < kind < 11 else r.choice(["", "", f"{plain} ", f"{plain}/", "www."]))
        label = 0.0
    if len(found) < LEAST and i % 2 == 0 and kind < 7:
        found += pick(string.digits, LEAST - len(found))
    after = '"' + words(2) if before.endswith('"') else f"{r.choice([' ', '. ', ', ', '.'])}{words(2)}"
    return before, found, after, path, label


def findings(spark: SparkSession, steps: np.ndarray, rows: int = TRAIN_ROWS, words: frozenset[str] = frozenset(DICTIONARY)) -> DataFrame:
    """label, features: the seeded training sample, of a fixed number of rows."""

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held = [example(int(i)) for i in frame.id]
            yield pd.DataFrame({"label": [x[4] for x in held], "features": [features(x[1], x[0], x[2], x[3], steps, words) for x in held]})

    return spark.range(0, rows, 1, 4).mapInPandas(make, "label double, features array<double>")


def labelled(found: DataFrame) -> DataFrame:
    """doc_id, digest, label, features of the CANDIDATES that say themselves what they are.

    1: a value of 16 or more letters and digits, both, that is assigned to a name with a key word. 0: no key word before it
    and nothing assigned, and letters only (a word), digits only (a number), or a part of a path, host or address. All
    others are not labelled.
    """
    f = lambda name: F.col("features")[FEATURES.index(name)]
    letters = f("lowers") + f("uppers")
    key = (f("key_before") > 0) & (f("assigned") > 0) & (f("length") >= 16) & (f("digits") > 0) & (letters > 0) & (f("marks") == 0)
    plain = (f("key_before") == 0) & (f("assigned") == 0) & ((letters == 1) | (f("digits") == 1) | (f("in_path") > 0))
    return found.select("doc_id", "digest", F.when(key, 1.0).when(plain, 0.0).alias("label"), "features").where("label is not null")


def is_held_out(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), doc_id), F.lit(HELD_OUT[0])) == HELD_OUT[1]


def sampled(told: DataFrame, rows: int = TABLE_ROWS) -> DataFrame:
    """label, features of at most so many of each label: the first by hash, each distinct finding once.

    Only findings whose hash lies below a bound are gathered: a bound that lets some times as many pass as are wanted, raised
    until enough distinct ones do. So no more than that is shuffled, whatever the corpus holds.
    """
    top = 1 << 31
    told = told.where(~is_held_out(F.col("doc_id"))).withColumn("_h", F.pmod(F.xxhash64(F.lit(SEED), "digest"), F.lit(top)))
    parts = []
    for label, n in ((r["label"], r["count"]) for r in told.groupBy("label").count().collect()):  # two labels
        times = 8
        while True:
            bound = min(top, top * times * rows // n)
            some = told.where((F.col("label") == label) & (F.col("_h") < bound))
            some = stored(some.groupBy("digest", "label", "_h").agg(F.min("features").alias("features")), "secret-sample")
            if bound == top or some.count() >= rows:
                break
            times *= 16
        parts.append(some.orderBy("_h", "digest").limit(rows).select("label", "features"))
    return reduce(DataFrame.unionByName, parts) if parts else told.select("label", "features")


def train(labelled: DataFrame) -> RandomForestClassificationModel:
    forest = RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=40, maxDepth=8, seed=SEED)
    return forest.fit(labelled.select("label", array_to_vector("features").alias("v")))


def scan(docs: DataFrame, known: DataFrame | None = None, steps: np.ndarray | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, start, length, digest, probability, is_secret of every candidate of docs(doc_id, text, path).

    `known` are findings (label 0 or 1, features) to learn from; without any the seeded ones and those of the texts are used.
    """
    steps = transitions(docs) if steps is None else steps
    words = lexicon(docs)
    found = stored(candidates(docs, steps, words), "secret-candidates")
    if known is None:
        known = findings(docs.sparkSession, steps, TRAIN_ROWS, words).unionByName(sampled(labelled(found)))
    known = known.where("label is not null and features is not null")
    kinds = known.agg(F.min("label").alias("low"), F.max("label").alias("high")).first()
    if kinds["low"] == kinds["high"]:
        scored = found.withColumn("probability", F.lit(1.0 if kinds["low"] is None else float(kinds["low"])))
    else:
        scored = train(known).transform(found.withColumn("v", array_to_vector("features")))
        scored = scored.withColumn("probability", F.round(vector_to_array("probability")[1], 6))
    return scored.select("doc_id", "start", "length", "digest", "probability", (F.col("probability") >= threshold).alias("is_secret"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("path"))
    return scan(docs)
