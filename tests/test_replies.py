from pyspark.sql import functions as F

import random

import numpy as np
import pytest

from babelmill.functions import language, replies, word_diff

SF = "/root/testdata/sf0.001"


def test_objects_arrive_in_parts(spark):
    text = '[{"a": "}"}, {"b": {"c": "\\"{"}}, {"d"'
    assert replies.objects_in(text) == (['{"a": "}"}', '{"b": {"c": "\\"{"}}'], 32)
    more = text + ": 1}]"
    assert replies.objects_in(more, 32)[0] == ['{"d": 1}']
    df = spark.createDataFrame([(text,), (None,)], "t string").select(replies.json_objects("t").alias("j")).select("j.*")
    assert [(len(r.objects), r.resume) for r in df.collect()] == [(2, 32), (0, 0)]


def test_word_diff_rebuilds_both_versions(spark):
    rows = [("a b  c d", "a x c d e"), ("", "new"), (None, None), ("same", "same")]
    df = spark.createDataFrame(rows, "o string, n string").select("o", "n", word_diff.word_diff("o", "n").alias("d"))
    for r in df.collect():
        assert "".join(x.text for x in r.d if x.kind != "added") == (r.o or "")
        assert "".join(x.text for x in r.d if x.kind != "removed") == (r.n or "")


def fewest_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] if x == y else 1 + min(row[j], new[-1]))
        row = new
    return row[-1]


@pytest.mark.parametrize("stride", [1, 3, 128])
def test_edit_scripts_are_shortest(monkeypatch, stride):
    monkeypatch.setattr(word_diff, "STRIDE", stride)
    r = random.Random(stride)
    for _ in range(150):
        size = r.choice([1, 2, 5, 40])
        a, b = ([r.randrange(size) for _ in range(r.choice([0, 1, 4, 30]))] for _ in range(2))
        gone, new = word_diff.edits(np.array(a, np.int64), np.array(b, np.int64))
        assert int(gone.sum() + new.sum()) == fewest_edits(a, b)
        assert [x for x, g in zip(a, gone, strict=True) if not g] == [y for y, n in zip(b, new, strict=True) if not n]


def test_long_versions():
    old = " ".join(f"w{i % 211}" for i in range(4000))
    new = " ".join(f"w{i % 211}" if i % 3 else f"x{i}" for i in range(4000))
    runs = word_diff.differences(old, new)
    assert "".join(x["text"] for x in runs if x["kind"] != "added") == old and "".join(x["text"] for x in runs if x["kind"] != "removed") == new
    assert sum(x["words"] for x in runs if x["kind"] != "same") == 2 * sum(i % 3 == 0 for i in range(4000))


def test_language_detection(spark):
    """Every fifth document is held out: at least 98 of 100 of these, over all languages of the table, are told right."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 100").select("doc_id", "text", "lang")
    model = language.trained(d.where("doc_id % 5 <> 3"))
    rows = language.detected(d.where("doc_id % 5 = 3"), model).collect()
    assert len(rows) > 150 and {r.lang for r in rows} == {r.detected for r in rows}
    assert sum(r.lang == r.detected for r in rows) >= 0.98 * len(rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "ab"), (4, "the and of the")], "doc_id long, text string")
    assert {r.doc_id: r.detected for r in language.detected(odd, model).collect()} == {1: None, 2: None, 3: None, 4: "en"}
    assert {r.detected for r in language.detected(odd, model.where("false")).collect()} == {None}


def test_language_model_is_the_same_however_texts_are_dealt(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang")
    rows = lambda x: sorted(tuple(r) for r in x.collect())
    assert rows(language.trained(d.repartition(7))) == rows(language.trained(d.coalesce(1)))
    twice = spark.createDataFrame([("abc", "a"), ("abd", "b"), ("", "c"), (None, "d"), ("abcd", None)], "text string, lang string")
    assert rows(language.trained(twice)) == [("a", (961 * 97 + 31 * 98 + 99) % 4096, 1), ("b", (961 * 97 + 31 * 98 + 100) % 4096, 1)]


def test_edits_of_long_and_short_versions_are_one_script(monkeypatch):
    """Rows of bits and bands give the same script, also where a place of bits is a large integer; a few thousand different words
    take no band for each edit."""
    r = random.Random(5)
    for n, m, words in [(0, 9, 3), (60, 75, 4), (300, 280, 40), (5000, 4500, 900)]:
        a, b = (np.array([r.randrange(words) for _ in range(k)], np.int64) for k in (n, m))
        rows, bands = word_diff._edits_in_rows(a, b), word_diff._edits_in_bands(a, b, n + m)
        assert all((x == y).all() for x, y in zip(rows, bands, strict=True))
    monkeypatch.setattr(word_diff, "_widened", None)
    gone, new = word_diff.edits(a[:3000], b[:3000])
    assert gone.sum() == new.sum()
    assert word_diff.differences("x " * 4000, "y " * 4000)[0]["words"] == 4000
