from pyspark.sql import functions as F

from babelmill.operators import blocks


def test_reviewer_input_and_translated_text_with_nulls(spark):
    rows = spark.createDataFrame([(1, 2, "b", None), (1, 1, None, 'say "x"'), (2, 1, None, None)], "p int, b int, source string, translation string")
    made = {r.p: r.input for r in blocks.reviewer_input(rows, "p", "b").collect()}
    assert made[1] == '[{"id":"1-1","source":"","translation":"say \\"x\\""},{"id":"1-2","source":"b","translation":""}]'
    assert {r.p: r.text for r in blocks.translated_text(rows, "p", "b").collect()} == {1: 'say "x"b', 2: ""}


def test_shapes_and_fallbacks(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "Title", {"a": "b"})], "i int, type string, info map<string,string>")
    made = {r.i: (r.type, r.info) for r in blocks.output_blocks(rows).collect()}
    assert made == {1: ("Text", {}), 2: ("Title", {"a": "b"})}
    models = spark.createDataFrame([(1, {"b": "y", "a": None}), (2, None)], "i int, m map<string,string>")
    out = {r.i: [tuple(x) for x in r.x] for r in models.select("i", blocks.model_texts(F.col("m")).alias("x")).collect()}
    assert out == {1: [(None, "a"), ("y", "b")], 2: []}
    failed = spark.createDataFrame([("x", None), ("x", "late"), (None, None)], "t string, e string")
    assert [r[0] for r in failed.select(blocks.or_empty(F.col("t"), F.col("e"))).collect()] == ["x", "", ""]


def test_messages_and_counts(spark):
    m = spark.createDataFrame([("a", None), ("a", True), ("b", False), (None, False)], "agent string, system boolean")
    assert blocks.messages_of(m, "a").count() == 1
    t = spark.createDataFrame([(None, "x"), ("x", None), ("x", "x"), ("x", "y")], "x string, y string")
    assert t.agg(blocks.changed_count(F.col("x"), F.col("y"))).first()[0] == 2
    assert t.limit(0).agg(blocks.changed_count(F.col("x"), F.col("y"))).first()[0] == 0
    s = spark.createDataFrame([(2, 5), (1, 7), (2, 5)], "o int, s int")
    assert s.agg(blocks.score_list(F.col("s"), "o").alias("s")).first().s == [7, 5, 5]


def test_insert_appends(spark, tmp_path):
    head, lines = spark.createDataFrame([(1,)], "h int"), spark.createDataFrame([(1,), (1,)], "h int")
    for _ in range(2):
        blocks.insert_with_children(head, lines, f"file://{tmp_path}")
    assert spark.read.parquet(f"file://{tmp_path}/children").count() == 4
    assert spark.read.parquet(f"file://{tmp_path}/header").count() == 2
