"""Proximity matches of benchmark windows against brute force."""

import random
from collections import Counter

import pytest

from babelmill.llm import decontamination


def near(words, terms, span):
    """Places in some stretch of at most span words that holds all terms as often as asked, and is shortest from its first."""
    want, hit = Counter(terms), set()
    tight = []
    for a in range(len(words)):
        left, missing = Counter(want), len(terms)
        for b in range(a, min(len(words), a + span)):
            missing -= left[words[b]] > 0
            left[words[b]] -= 1
            if not missing:
                tight.append((a, b))
                break
    for a, b in tight:
        if not any(a < c and d <= b for c, d in tight):  # ends never come before those of earlier beginnings
            hit |= set(range(a, b + 1))
    return hit


def found(spark, texts, items, span):
    d = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string").coalesce(1)
    b = spark.createDataFrame(items, "item_id long, text string")
    m = decontamination.match(d, b, span=span)
    return {r.row_id: ({i for s in r.spans for i in range(s.a, s.b)}, set(r["items"])) for r in m.collect()}


@pytest.mark.parametrize("span", [4, 90, 300])
def test_proximity_equals_brute_force(spark, span):
    r = random.Random(span)
    texts = [" ".join(r.choice("abcdef") if r.random() < (0.5 if span < 9 else 3 / span) else "x" for _ in range(r.choice([3, 20, 400]))) for _ in range(60)] + [None, ""]
    items = [(1, "a b c"), (2, "b a"), (3, "a a b"), (4, "d e f a b c"), (5, "f"), (6, "zzz a"), (7, "c b a")]
    got = found(spark, texts, items, span)
    for i, text in enumerate(texts):
        w = (text or "").split()
        each = {str(n): near(w, t.split(), span) for n, t in items}
        assert got[i] == (set().union(*each.values()), {n for n, h in each.items() if h}), text


def test_opposite_sides_repeats_far_terms_and_documents(spark):
    texts = ["b x x a x x c", "a " + "x " * 70 + "b", "a", "b", "r x r", "r x x"]
    assert {i for i, x in found(spark, texts, [(1, "a b c")], 4).items() if x[1]} == set()
    assert {i for i, x in found(spark, texts, [(1, "a b")], 100).items() if x[1]} == {0, 1}
    assert {i for i, x in found(spark, texts, [(1, "r r")], 100).items() if x[1]} == {4}


def test_query_has_every_document(spark):
    from babelmill.llm import registry

    sf = "/root/testdata/sf0.001"
    exact = {r.doc_id: r.n_items for r in registry.QUERIES["op1_decontamination"](spark, sf).collect()}
    got = {r.doc_id: r.n_near_items for r in registry.QUERIES["op1_proximity"](spark, sf).collect()}
    assert got.keys() == exact.keys() and all(got[i] >= exact[i] for i in got)
