from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from babelmill.functions import segmentation, similarity, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_sentences(spark):
    cases = {
        "Hello.World": ["Hello.", "World"],
        "Dr. Smith paid $4.99. He left.": ["Dr. Smith paid $4.99.", "He left."],
        "Wait... ok": ["Wait... ok"],
        "See example.com today. Fine!": ["See example.com today.", "Fine!"],
        "Mail a.b@c.d.org now. Thanks.": ["Mail a.b@c.d.org now.", "Thanks."],
        "He has a Ph.D. in physics.": ["He has a Ph.D. in physics."],
        "The U.S. in 1990. J. K. Rowling wrote.": ["The U.S. in 1990.", "J. K. Rowling wrote."],
        "Items, e.g. pens. ...": ["Items, e.g. pens."],
        "": [],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", segmentation.sentences(F.col("t")).alias("s"))
    assert {r.t: r.s for r in df.collect()} == cases
    assert one(spark, segmentation.sentences(F.lit(None).cast("string"))) == []
    assert one(spark, segmentation.grouped(F.array(*map(F.lit, "abc")), 2)) == ["a b", "c"]


def test_text_functions(spark):
    assert one(spark, text.language_matches(F.lit("en_US"), F.lit("en"))) and not one(spark, text.language_matches(F.lit("en"), F.lit("en-US")))
    assert one(spark, text.normalised_term(F.lit("U.S.-Mexico (Treaty)"))) == "usmexicotreaty"
    assert one(spark, text.score_of(F.lit('ok {"score": "90"} end'))) == 90 and one(spark, text.score_of(F.lit("no json"))) == 0
    assert one(spark, text.quality_flags(F.lit("Why?"), F.lit("لماذا"))) == ["question_mark"]
    assert one(spark, text.percent(F.lit(1), F.lit(8))) == 13
    assert one(spark, text.split_offset(F.lit("0123456789"), F.lit(5), F.lit("aaaaaaaaaaaa bbbbbbb"))) == 13
    assert [one(spark, text.similarity_band(F.lit(x))) for x in (95.0, 94.9, 75.0, 74.9)] == ["high", "mid", "mid", "low"]
    assert one(spark, text.output_name(F.lit("a.b.PDF"))) == "a.b_translated.xliff"
    assert one(spark, text.without_fenced_json(F.lit("a\n```json\n{}\n```\nb ```json {"))) == "a\n\nb"
    assert one(spark, text.bullets(F.lit("- a\n\n* b"))) == ["a", "b"]


def test_ratio():
    assert round(similarity.ratio_of("kitten", "sitting"), 6) == 61.538462
    assert similarity.ratio_of("", "") == 100.0


@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_lcs_is_the_table_method(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
        row = new
    assert similarity.lcs_length(a, b) == row[-1]


def test_similarity_columns(spark):
    assert round(one(spark, similarity.edit_similarity(F.lit("photosynthesis"), F.lit("photosyntesis"))), 6) == 0.928571
    assert one(spark, similarity.sorted_tokens(F.lit(" b  a "))) == "a b"
    df = spark.createDataFrame([("b a", "a b"), (None, "x")], "a string, b string")
    assert [r.s for r in df.select(similarity.ratio(similarity.sorted_tokens(F.col("a")), similarity.sorted_tokens(F.col("b"))).alias("s")).collect()] == [100.0, None]
