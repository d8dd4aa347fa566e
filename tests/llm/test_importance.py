"""Importance resampling against a plain version, with chunks far shorter than the texts."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from babelmill.llm import importance

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, score string, weight string"


def corpus():
    texts = [" ".join(f"Word{(i * j) % 57} é{j % 5}" for j in range(10 + i)) + "\n" for i in range(60)]
    texts += [None, "", " .,; ", "x" * 300, "one two", ("long " + "y" * 70 + " ") * 900 + "end", " ".join(f"tail{i % 91}" for i in range(4000)), "a" * 100 + " b " * 30]
    rows = [(i, t, "s", "w") for i, t in enumerate(texts)]
    return rows + [rows[40]] * 5 + [(None, texts[50], "s", "w"), (None, texts[51], "s", "w"), (12, texts[52], "s", "w"), (12, texts[52], "s", "other")]


TARGET = [("word3 é1 word4 tail7 long",), (None,), ("",), ("word3 é1 " * 40,)]


def found(text, n):
    words = WORDS.findall((text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + k]) for i in range(len(words)) for k in range(1, n + 1) if i + k <= len(words)]


def brute(rows, target, n, buckets, percent=10, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for r in rows for f in found(r[1], n)[1])
    t = Counter(bucket(f) for r in target for f in found(r[0], n)[1])
    every, wanted = float(sum(s.values())), float(sum(t.values()))
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (every + buckets) / ((s[b] + 1.0) * (wanted + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text, *_ in rows:
        n_words, held = found(text, n)
        weight = sum(gain[bucket(f)] for f in held) // len(held) if held else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(held), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    eligible = sorted(((-o[3], o[0] is None, o[0] or 0) for o in out if o[4] >= least))
    return out, [(-e[0], None if e[1] else e[2]) for e in eligible[: percent * len(eligible) // 100]]


@pytest.mark.parametrize(("n", "size", "buckets", "percent"), [(1, 1 << 16, 10000, 10), (1, 50, 97, 40), (3, 64, 1000, 100), (2, 1000, 50, 7)])
def test_weights_and_draw(spark, n, size, buckets, percent):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    target = spark.createDataFrame(TARGET, "text string")
    got = importance.drawn(importance.weighed(importance.keyed(docs), target, n, buckets, size=size), percent).collect()
    want, order = brute(rows, TARGET, n, buckets, percent)
    held = [(r.doc_id, r.n_features, r.weight, r.score, r.n_words) for r in got for _ in range(r.copies)]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(held, key=key) == sorted(want, key=key)
    ranks = {r.first + i: (r.score, r.doc_id) for r in got for i in range(r.taken)}
    assert [ranks.get(i) for i in range(1, len(order) + 1)] == order and len(ranks) == len(order)


def test_resampled_rows(spark):
    docs = spark.createDataFrame(corpus(), DOCS).repartition(4)
    target = spark.createDataFrame(TARGET, "text string")
    out = importance.resampled(docs, target, percent=60)
    assert out.columns == docs.columns
    order = brute(corpus(), TARGET, 1, 10000, 60)[1]
    key = lambda x: (x is None, x or 0)
    assert sorted((r.doc_id for r in out.collect()), key=key) == sorted((d for _, d in order), key=key)


def test_crc_registers():
    words = [b"", b"a", b"z" * 47, b"z" * 48, b"z" * 49, b"q" * 5000, "é".encode()]
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    state = np.full(len(words), importance._ONES, np.uint32)
    got = importance._feed(state, data, ends - np.array([len(w) for w in words]), ends) ^ importance._ONES
    assert got.tolist() == [zlib.crc32(w) for w in words]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    target = spark.createDataFrame(TARGET, "text string")
    assert importance.drawn(importance.weighed(importance.keyed(none), target)).collect() == []
    rows = corpus()
    got = importance.weighed(importance.keyed(spark.createDataFrame(rows, DOCS)), target.where(F.lit(False)))
    totals = defaultdict(int)
    for r in got.collect():
        totals[r.weight] += r.copies
    assert totals == Counter(o[2] for o in brute(rows, [], 1, 10000)[0])
