"""Substring dedup against plain versions: the index by itself, the operator over partitions, the hot path."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from babelmill.llm import substrings

DOCS = "doc_id long, text string, spans string"
LAST = substrings.LAST


def corpus():
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared, other = prose(60), prose(70)
    texts = [prose(r.randrange(1, 150)) for _ in range(25)]
    texts += [f"{prose(r.randrange(40))} {shared}\n{prose(r.randrange(40))}" for _ in range(12)]
    texts += [f"{prose(5)}\t{other}  {shared} {prose(3)}", f"{shared} {other}", f"{shared} {shared} {shared}", shared.title(), " ".join(shared.split()[:49]), " ".join(shared.split()[3:53])]
    texts += [texts[2], texts[2], texts[30], texts[30] + " \n", None, "", "  \n", "one", "a " * 300, "a " * 299 + "b", "a b " * 200, "x\x1cy " * 60 + "é中 " * 60]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    r.shuffle(rows)
    return rows + [rows[0], rows[0], rows[7], (None, texts[27], "s"), (None, f"{shared} z", "s"), (None, prose(80), "s"), (30, texts[31], "s"), (2, texts[2], "t")]


def brute(rows, window):
    low = {}
    split = [(LAST if d is None else d, (t or "").encode().split()) for d, t, _ in rows]
    for place, words in split:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            low[key] = min(low.get(key, LAST), place)
    out = []
    for (doc_id, *_), (place, words) in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(words) - window + 1):
            if low[tuple(words[i : i + window])] < place:
                gone |= set(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


def ordered(rows):
    return sorted(rows, key=lambda x: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in x))


@pytest.mark.parametrize(("window", "hot", "shard"), [(50, 1 << 13, 1 << 20), (50, 1, 1 << 20), (50, 6, 100), (7, 3, 50), (2, 20, 1000)])
def test_repeats(spark, monkeypatch, window, hot, shard):
    monkeypatch.setattr(substrings, "HOT", hot)
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = substrings.repeats(substrings.keyed(docs), window, shard).collect()
    want = brute(rows, window)
    assert ordered([(r.doc_id, r.n_words, r.n_removed, r.kept.hex()) for r in got]) == ordered([w[:4] for w in want])
    for r in got:
        assert r.n_removed == sum(s.length for s in r.spans)


def test_cleaned(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    out = substrings.cleaned(docs)
    assert out.columns == docs.columns
    want = [(d, kept if n else t, s) for (d, t, s), (_, _, n, _, kept) in zip(rows, brute(rows, 50), strict=True)]
    assert ordered([tuple(r) for r in out.collect()]) == ordered(want)


def test_empty_and_short_tables(spark):
    assert substrings.repeats(substrings.keyed(spark.createDataFrame([], DOCS))).collect() == []
    got = substrings.repeats(substrings.keyed(spark.createDataFrame([(1, None, "s"), (2, "a b", "s")], DOCS))).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(1, 0, 0), (2, 2, 0)]


@pytest.mark.parametrize("seed", range(12))
def test_index_finds_the_least_place_of_every_window(seed):
    r = random.Random(seed)
    window, size = r.choice([2, 3, 8, 50]), r.choice([1, 2, 20])
    line = [f"w{r.randrange(size)}" for _ in range(600)]
    texts = []
    for _ in range(30):
        a, n = r.randrange(200), window + r.choice([0, 3, 300])
        texts.append(" ".join(line[a : a + n] if r.random() < 0.5 else (f"w{r.randrange(size)}" for _ in range(n))))
    places = [r.randrange(9) for _ in texts]
    low = {}
    for t, p in zip(texts, places, strict=True):
        words = t.split(" ")
        for i in range(len(words) - window + 1):
            low[tuple(words[i : i + window])] = min(low.get(tuple(words[i : i + window]), LAST), p)
    got = substrings.search(pa.array(texts), np.array(places), window)
    for t, p, (starts, lengths) in zip(texts, places, got, strict=True):
        words = t.split(" ")
        found = {int(a) + i for a, n in zip(starts, lengths, strict=True) for i in range(n)}
        assert found == {i for i in range(len(words) - window + 1) if low[tuple(words[i : i + window])] < p}


def test_wavelet_counts_symbols():
    r = np.random.default_rng(3)
    symbols = np.sort(r.zipf(1.4, 5000) % 60)
    values, symbols, counts = np.unique(symbols, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    symbols = r.permutation(number[symbols])
    wavelet = substrings.Wavelet(symbols, counts[order])
    asked = -np.sort(-r.integers(0, len(values), 2000))
    at = r.integers(0, len(symbols) + 1, 2000)
    assert wavelet.rank(asked, at).tolist() == [int((symbols[:i] == c).sum()) for c, i in zip(asked, at, strict=True)]
    # Compressed: about the entropy of the symbols, a bit each more at most.
    p = counts / counts.sum()
    assert sum(len(x.words) * 64 for x in wavelet.levels) <= len(symbols) * (-(p * np.log2(p)).sum() + 1) + 128 * len(wavelet.levels)


def test_anchors_do_not_depend_on_the_neighbours():
    words = np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64)
    whole = substrings.segments_of(words, np.array([0, 500]), 50)
    assert whole[2].sum() == 451 and (np.diff(whole[1]) == whole[2][:-1]).all()
    both = substrings.segments_of(np.concatenate([words[:100], words]), np.array([0, 100, 600]), 50)
    later = both[1] >= 100
    for a, b in zip(whole, (both[0][later], both[1][later] - 100, both[2][later]), strict=True):
        assert a.tolist() == b.tolist()
