"""Memory search over a growing query set, against brute force."""

import random

import numpy as np
import pytest

from babelmill import catalog
from babelmill.functions import similarity
from babelmill.functions.lcs import Texts, lcs_lengths
from babelmill.operators import memory

SF = "/root/testdata/sf0.001"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def brute_search(asked, held, mode, k=5):
    key = (lambda t: " ".join(sorted(t.split()))) if mode == "token" else str
    out = []
    for i, q in asked:
        if not q or not q.strip():
            continue
        found = []
        for position, source, target in held:
            if source is not None:
                a, b = key(q), key(source)
                score = 200.0 * lcs(a, b) / (len(a) + len(b))
                if score >= 60:
                    found.append((-score, position, source, target))
        out += [(i, p, s, t, round(-score, 6), n + 1) for n, (score, p, s, t) in enumerate(sorted(found)[:k])]
    return sorted(out)


def rows(df):
    return sorted((r.query_id, r.position, r.source_text, r.target_text, round(r.score, 6), r["rank"]) for r in df.collect())


@pytest.mark.parametrize("mode", ["char", "token"])
@pytest.mark.parametrize("block", [1024, 7])
def test_part_search_asks_every_hundredth_row(spark, mode, block, monkeypatch):
    monkeypatch.setattr(memory, "BLOCK", block)
    part = spark.read.parquet(f"{SF}/part.parquet").collect()
    asked = [(str(r.p_partkey), r.p_name) for r in part if r.p_partkey % 100 == 0]
    got = rows(catalog.QUERIES[f"tm_search_part_{mode}"](spark, SF))
    assert asked and {r[0] for r in got} == {i for i, _ in asked}
    assert got == brute_search(asked, [(r.p_partkey, r.p_name, r.p_type) for r in part], mode)


@pytest.mark.parametrize("mode", ["char", "token"])
def test_search_in_blocks_with_ties_and_long_texts(spark, mode, monkeypatch):
    for name, value in (("BLOCK", 3), ("GROUP", 2), ("TOGETHER", 2)):
        monkeypatch.setattr(memory, name, value)
    long = " ".join(f"word{i}" for i in range(300))
    held = [(i, f"red widget {'abc'[i % 3]}", f"t{i}") for i in range(30)] + [(40, long, "long"), (41, None, "none"), (42, "", "blank")]
    asked = [(str(i), t) for i, t in enumerate(["red widget a", "widget red b", long + " tail", " ", "unlike anything", "red widget c"])]
    q = spark.createDataFrame(asked, "query_id string, text string")
    m = spark.createDataFrame(held, "position long, source_text string, target_text string").repartition(3)
    assert rows(memory.search_memory(q, m, mode)) == brute_search(asked, held, mode)


def test_hits_of_benchmark_sentences(spark):
    from babelmill.functions import segmentation
    from pyspark.sql import functions as F

    of = lambda name, key: [(r[0], i, s) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(key, segmentation.sentences(F.col("text"))).collect() for i, s in enumerate(r[1])]
    held = [(d * 2**20 + i, s, None) for d, i, s in of("documents", "doc_id")]
    asked = [(f"{d}-{i}", s) for d, i, s in of("benchmark", "item_id")]
    got = {r.query_id: (r.hits, r.best) for r in catalog.QUERIES["tm_sentence_hits"](spark, SF).collect()}
    assert set(got) == {i for i, _ in asked}
    for i, q in asked:
        scores = sorted((similarity.ratio_of(q, s) for _, s, _ in held if 200 * min(len(q), len(s)) >= 60 * (len(q) + len(s))), reverse=True)[:5]
        scores = [x for x in scores if x >= 60]
        assert got[i] == (len(scores), round(scores[0], 6) if scores else None)


def test_few_pairs_are_compared(spark):
    """Bounds leave out most pairs where texts differ, and lose none (the searches above are compared with brute force)."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 9)))
    line = lambda: " ".join(word() for _ in range(r.randrange(3, 20)))
    held = [(i, line(), "t") for i in range(1500)]
    asked = [(str(i), held[i * 7][1] + " x") for i in range(40)]
    q = spark.createDataFrame(asked, "query_id string, text string")
    m = spark.createDataFrame(held, "position long, source_text string, target_text string").repartition(4)
    for least, share in ((60.0, 0.7), (80.0, 0.2)):
        compared = [x.compared for x in memory.comparisons(q, m, "char", min_score=least).collect()]
        assert len(compared) == 40 and 40 <= sum(compared) < share * 40 * 1500
    assert rows(memory.search_memory(q, m, "char")) == brute_search(asked, held, "char")


@pytest.mark.parametrize("sizes", [(0, 1, 5, 63, 64, 65, 128, 200), (3, 9)])
def test_lcs_of_many_pairs(sizes):
    r = random.Random(len(sizes))
    text = lambda: "".join(r.choice("abc dé中𝄞") for _ in range(r.choice(sizes)))
    left, right = [text() for _ in range(9)], [text() for _ in range(11)]
    a, b = np.divmod(np.arange(99), 11)
    got = lcs_lengths(Texts(left), Texts(right), a, b)
    assert got.tolist() == [similarity.lcs_length(left[i], right[j]) for i, j in zip(a, b, strict=True)]


def test_empty_sides(spark):
    none_q, none_m = spark.createDataFrame([], "query_id string, text string"), spark.createDataFrame([], "position long, source_text string, target_text string")
    q, m = spark.createDataFrame([("1", "a b")], none_q.schema), spark.createDataFrame([(1, "b a", "t"), (2, None, "t")], none_m.schema)
    assert memory.search_memory(none_q, m).collect() == [] and memory.search_memory(q, none_m).collect() == []
    assert [(r.hits, r.best) for r in memory.hits(q, m).collect()] == [(1, 100.0)] and [r.hits for r in memory.hits(q, none_m).collect()] == [0]


def test_mode_and_number_are_checked(spark):
    q, m = spark.createDataFrame([("1", "a")], "query_id string, text string"), spark.createDataFrame([(1, "a", "t")], "position long, source_text string, target_text string")
    for mode, k in (("words", 5), ("char", 0), ("token", 21)):
        with pytest.raises(ValueError, match="mode is token or char"):
            memory.search_memory(q, m, mode, k)


def brute_hits(asked, held, mode, k=5, least=60):
    """query_id, hits, best: queries of one id are searched one by one."""
    key = (lambda t: " ".join(sorted(t.split()))) if mode == "token" else str
    out = {i: (0, None) for i, _ in asked}
    for i, q in asked:
        if q and q.strip():
            found = sorted((x for s in held if s is not None for x in [similarity.ratio_of(key(q), key(s))] if x >= least), reverse=True)[:k]
            if found:
                out[i] = min(k, out[i][0] + len(found)), round(max(found[0], out[i][1] or 0), 6)
    return out


@pytest.mark.parametrize("mode", ["char", "token"])
@pytest.mark.parametrize(("k", "least", "chars"), [(5, 60.0, 1 << 20), (2, 45.0, 300), (1, 0.0, 2000)])
def test_hits_against_brute_force(spark, mode, k, least, chars, monkeypatch):
    """Copies, near copies at either end, few and no hits, queries that are repeated, blank ones, texts of several words of bits; without pivots."""
    for name, value in (("BLOCK", 8), ("NEAR", 2), ("TOGETHER", 3), ("BLOCK_CHARS", chars)):
        monkeypatch.setattr(memory, name, value)
    monkeypatch.setattr(memory, "pivots_of", lambda keys: pytest.fail("pivots are of no use to hits"))
    r = random.Random(7)
    word = lambda: "".join(r.choice("etaoinshé中𝄞") for _ in range(r.randrange(1, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    lines = [line(r.randrange(1, 30)) for _ in range(150)]
    held = lines + lines[:10] * 6 + lines[10:20] + [line(4) + " " + x for x in lines[20:40]] + [x + " " + line(9) for x in lines[20:30] * 3] + ["", " ", None, "x" * 3000]
    asked = [(str(i), x) for i, x in enumerate(lines[:40])] + [("a", lines[50]), ("a", lines[3]), ("a", lines[50]), ("b", " "), ("b", None), ("c", "Q" * 70), ("d", line(25)), ("e", "e"), ("f", lines[60] + lines[61])]
    q = spark.createDataFrame(asked, "query_id string, text string")
    m = spark.createDataFrame([(i, x, None) for i, x in enumerate(held)], "position long, source_text string, target_text string").repartition(3)
    got = {x.query_id: (x.hits, x.best) for x in memory.hits(q, m, mode, k, least).collect()}
    assert got == brute_hits(asked, held, mode, k, least)


def test_full_queries_look_only_for_better_ones(monkeypatch):
    import pyarrow as pa

    compared = []
    lcs = memory.Columns.lcs
    monkeypatch.setattr(memory.Columns, "lcs", lambda self, codes, some: compared.append(len(some)) or lcs(self, codes, some))
    queries = pa.StructArray.from_arrays([pa.array([4, 9]), pa.array(["abcdefghij", "klmnopqrst"]), pa.array([0, 5]), pa.array([-1.0, 90.0])], ["asked", "key", "found", "best"])
    tally = memory._Tally(queries, 5, 60.0)
    tally.meet(Texts(["abcdefgh", "abcdefghi", "abcdefghij"]), np.array([3, 1, 1]))
    assert sum(compared) == 3  # the second one wants more than 90
    tally.meet(Texts(["abcdefghi", "abcdefghij", "klmnopqrst"]), np.ones(3, np.int64))
    assert sum(compared) == 4 and tally.rows().to_pydict() == {"asked": [4, 9], "found": [5, 1], "best": [100.0, 100.0]}


@pytest.mark.parametrize("sizes", [(0, 1, 5, 62, 63, 64, 126, 127, 200), (3, 9)])
def test_lcs_of_columns(sizes, monkeypatch):
    from babelmill.functions import lcs as module

    monkeypatch.setattr(module, "ABREAST", 5)
    r = random.Random(len(sizes))
    text = lambda: "".join(r.choice("abc dé中𝄞") for _ in range(r.choice(sizes)))
    texts = sorted((text() for _ in range(17)), key=len)
    columns = module.Columns(Texts(texts))
    for one in [text() for _ in range(9)] + ["zzz" * 50, "a" * 130]:
        some = np.array(sorted(r.sample(range(17), 11)))
        assert columns.lcs(Texts([one]).codes, some).tolist() == [similarity.lcs_length(one, texts[i]) for i in some]
    assert columns.lcs(Texts(["a"]).codes, np.zeros(0, np.int64)).tolist() == []
