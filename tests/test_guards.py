"""Rules that fail a query, rules by hand from the reviewed behaviour, and calls that are bounded."""

import time

import pytest
from pyspark.sql import functions as F

from babelmill.functions import segmentation, text
from babelmill.operators import guards


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_quality_flags_by_hand(spark):
    """Expected by the rules: both texts trimmed; a question needs its mark at the end of a text that is there."""
    cases = {
        ("Why?", ""): ["untranslated"], ("Why?", "really? yes"): ["question_mark"], ("Why?", "لماذا؟ "): [], ("a", "  b "): [], ("a", "b  c"): ["double_space"],
        (" a ", "a"): ["same_as_source"], ("", ""): [], ("a", "b, c"): ["ascii_comma"], (None, None): [], ("Why?", "why "): ["question_mark"], ("", "x?"): [], ("Why？", "x?"): [],
    }
    df = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(cases)], "i int, s string, t string")
    got = {r.i: r.f for r in df.select("i", text.quality_flags(F.col("s"), F.col("t")).alias("f")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_fences_and_edits_by_hand(spark):
    cases = {
        'a ```json {"x": 1} ``` b': "a  b", "a\n```json\n{}\n```\n\n\nb": "a\n\nb", "a ```json {": "a", "a ``": "a", "a ```js": "a", "a ```json\n{} ``` b ```json": "a  b",
        "a ``` code ``` b": "a ``` code ``` b", '```json {"a": "``` x"} ```end': "end", "x ```json {} ``` y `": "x  y", "cut ```json {\"a\" `": "cut", "": "", None: "",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", text.without_fenced_json(F.col("t")).alias("x")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    reply = lambda body: F.lit(f"```json {body} ```")
    assert one(spark, text.focus_edit(reply('{"action": "edit_translation", "new_text": "n"}'))) == "n"
    assert one(spark, text.focus_edit(reply('{"action": "edit_translation", "new_text": ""}'))) is None
    assert one(spark, text.focus_edit(reply('{"action": "other", "new_text": "n"}'))) is None


def test_recoverable_needs_the_type(spark):
    of = lambda kind, message: one(spark, text.recoverable(F.lit(kind), F.lit(message)))
    assert of("TypeError", "Failed to fetch") and not of("Error", "Failed to fetch") and not of("TypeError", "x") and not of(None, "network error")


def test_an_initial_behind_markup_ends_a_sentence(spark):
    assert one(spark, segmentation.sentences(F.lit("by <b>J. Rowling wrote. By J. Rowling too."))) == ["by <b>J.", "Rowling wrote.", "By J. Rowling too."]


def fails(df, message):
    with pytest.raises(Exception, match=message):
        df.collect()


def test_guards_fail_the_query(spark):
    rows = spark.createDataFrame([(1, i) for i in range(201)] + [(2, 0)], "doc int, seg int")
    assert guards.guarded(rows.where("seg < 200"), "doc").where("doc = 1").first().segments == 200
    fails(guards.guarded(rows, "doc"), "max segments exceeded: 201 > 200")
    docs = spark.createDataFrame([("en", "en"), ("fr", "en")], "detected string, asked string")
    assert guards.in_language(docs.where("detected = 'en'"), "asked").count() == 1
    fails(guards.in_language(docs, "asked"), "Detected source language 'fr' does not match")
    items = spark.createDataFrame([(0, '{"id": "a", "translated_text": "t"}'), (1, '{"id": "b"}')], "position int, j string").select("position", F.parse_json("j").alias("item"))
    assert [tuple(r)[2:] for r in guards.checked_translations(items.where("position = 0")).collect()] == [("a", "t")]
    fails(guards.checked_translations(items), "missing required key.* 'translated_text'")
    scores = spark.createDataFrame([(1, [1, 2]), (1, [3, 4]), (2, [5])], "run int, scores array<int>")
    assert sorted(tuple(r) for r in guards.mean_by_iteration(scores, "run", "scores").collect()) == [(1, 0, 2.0), (1, 1, 3.0), (2, 0, 5.0)]
    fails(guards.mean_by_iteration(scores.union(spark.createDataFrame([(2, [1, 1])], scores.schema)), "run", "scores"), "blocks with 1 and 2 scores")


def test_calls_are_bounded_and_made_once(spark, tmp_path):
    folder = str(tmp_path)

    def call(value):
        began = time.time()
        time.sleep(0.05)
        with open(f"{folder}/{began:.6f}-{value}", "w") as f:
            f.write(f"{began} {time.time()}")
        if value == "t3":
            raise ValueError
        return value.upper()

    rows = spark.createDataFrame([(i, f"t{i % 8}") for i in range(24)] + [(99, None)], "i int, text string")
    got = {r.i: r.result for r in guards.called(rows, call, at_once=2).collect()}
    assert got == {i: "" if i % 8 == 3 else f"T{i % 8}" for i in range(24)} | {99: ""}
    spans = sorted(tuple(map(float, f.read_text().split())) for f in tmp_path.iterdir())
    assert max(sum(a <= t < b for a, b in spans) for t, _ in spans) <= 2
    for f in tmp_path.iterdir():
        f.unlink()
    got = {r.i: r.result for r in guards.memoised(rows, call).collect()}
    assert got == {i: "" if i % 8 == 3 else f"T{i % 8}" for i in range(24)} | {99: ""}
    assert len(list(tmp_path.iterdir())) == 9


def test_blank_search_and_missing_headers(spark):
    terms = spark.createDataFrame([("Ring", "x"), (None, "ring"), ("a", "STRING")], "s string, t string")
    assert guards.searched_terms(terms, "  ", "s", "t").count() == 3
    assert sorted(r.t for r in guards.searched_terms(terms, "RING", "s", "t").collect()) == ["STRING", "x"]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    entries = spark.createDataFrame([(1, "a", "old", 1), (1, "a", "new", 2), (3, "z", "z", 1)], "id int, source_term string, target_term string, n int")
    assert {r.id: r.terms for r in guards.terms_of(ids(1, 2, 3), ids(1, 2), entries, "id", "n").collect()} == {1: {"a": "new"}, 2: {}, 3: None}
