from pyspark.sql import functions as F

from babelmill.functions import text as tx
from babelmill.operators import dialogue, styles
from babelmill.sources import exchange


def test_styles_that_name_each_other_end(spark):
    rows = [(1, 2, None), (2, 1, None), (3, 1, None), (4, 5, None), (5, 6, None), (6, None, "right"), (7, 7, None), (8, 99, None)]
    rows += [(100 + i, 99 + i if i else 4, None) for i in range(40)]
    got = {r.id: r.alignment for r in styles.inherited(spark.createDataFrame(rows, "id long, parent long, alignment string")).collect()}
    assert got == {1: None, 2: None, 3: None, 4: "right", 5: "right", 6: "right", 7: None, 8: None, **{100 + i: "right" for i in range(40)}}


def test_a_start_is_answered_once(spark):
    rows = [(1, 1, "tool_start", "a", "q1"), (1, 2, "token", None, None), (1, 3, "tool_call", None, "own"), (1, 4, "tool_call", None, "own2"), (1, 5, "tool_start", "b", None), (1, 6, "tool_call", "c", "own3")]
    e = spark.createDataFrame(rows, "key long, at long, type string, id string, args string")
    got = [(r.at, r.tool_call_id, r.args) for r in dialogue.tool_calls(e, "key", ["at"]).orderBy("at").collect()]
    assert got == [(3, "a", "q1"), (4, None, "own2"), (6, "c", None)]


def test_first_success(spark):
    rows = [(1, 0, i, None, f"e{i}") for i in range(4)] + [(1, 1, 9, "yes", None), (2, 0, 1, None, "no"), (3, 0, 3, None, "x"), (3, 0, 4, "late", None)]
    rows += [(4, 0, i, "ok" if i == 3 else None, None if i == 3 else "e") for i in range(4)]
    a = spark.createDataFrame(rows, "key long, provider int, at int, answer string, error string")
    got = {r.key: (r.provider, r.attempt, r.answer, r.error) for r in dialogue.first_success(a, "key", ["at"]).collect()}
    assert got[1] == (1, 1, "yes", None) and got[3] == (0, 2, "late", None)
    assert got[2][3] == "All 1 providers failed after 3 attempts each. Last error: no" and got[4][2] is None


def test_error_info(spark):
    cases = {"null": "Unknown error", '""': "Unknown error", '"x"': "x", "0": "Unknown error", "false": "Unknown error", "7": "7", "true": "true", "{}": "[object Object]", '{"message": "m", "code": "c"}': "m"}
    d = spark.createDataFrame([(k,) for k in cases], "k string").select("k", tx.error_info(F.parse_json("k")).alias("e"))
    assert {r.k: r.e.message for r in d.collect()} == cases


def test_error_info_works_its_error_out_once(spark):
    """However many of its fields are asked for; fields of any kind, missing and null ones, and errors that are null."""
    none = (None, None, None)
    cases = {
        '{"message": "m", "name": "n", "code": 7, "stack": "s"}': ("m", "n", "7", "s"), '{"message": "m", "name": "", "code": null}': ("m", *none), '{"message": "m", "stack": "%s"}' % ("é" * 4000): ("m", None, None, "é" * 4000),
        '{"message": "m", "stack": "%s"}' % ("é" * 4001): ("m", None, None, "é" * 4000 + "..."), '{"message": "m", "name": {"a": [1, null]}, "code": [true]}': ("m", '{"a":[1,null]}', "[true]", None),
        '{"message": 0, "code": 1.50}': ("0", None, "1.5", None), '{"message": {}, "name": "n"}': ("{}", "n", None, None), '{"message": null, "name": "n"}': ("[object Object]", *none), '{"Message": "m", "name": "n"}': ("[object Object]", *none),
        '{"message": false}': ("false", *none), "[]": ("[]", *none), '["message", {"message": "m"}]': ('["message",{"message":"m"}]', *none), '"0"': ("0", *none), '"false"': ("false", *none), "0.0": ("Unknown error", *none), "-1e3": ("-1000.0", *none), None: ("Unknown error", *none),
    }
    d = spark.createDataFrame([(k,) for k in cases], "k string").select("k", tx.error_info(F.parse_json("k")).alias("e")).select("k", "e.*")
    assert {r.k: tuple(r)[1:] for r in d.collect()} == cases
    assert d._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_profiles(spark):
    cases = {'{"role": null, "preferences": ["a"]}': ("", ["a"], True), '{"role": "r"}': ("r", [], True), '{"preferences": []}': ("", [], False), "[1]": ("", [], False), "": ("", [], False), "{x": ("", [], False)}
    d = spark.createDataFrame([(k,) for k in cases], "k string").select("k", tx.profile_of(F.col("k")).alias("p"))
    assert {r.k: (r.p.role, list(r.p.preferences), r.p.usable) for r in d.collect()} == cases


def test_folding(spark):
    d = spark.createDataFrame([("Straße-ΟΔΟΣ ſ",)], "x string").select(tx.normalised_term(F.col("x")).alias("y"))
    assert d.first().y == "Straße-ΟΔΟΣ ſ".casefold().replace("-", "").replace(" ", "")


def test_two_languages_need_both(spark):
    terms = [("f", 0, 0, 0, "en", "a"), ("f", 0, 1, 0, "fr", "b"), ("f", 0, 2, 0, "en", "c"), ("f", 1, 0, 0, "en", "a"), ("f", 1, 1, 0, "fr", "z"), ("f", 2, 0, 0, "en", "only"), ("f", 3, 0, 0, None, "n"), ("f", 3, 1, 0, "de", "d"), ("f", 3, 2, 0, "it", "i")]
    d = spark.createDataFrame([(*t, None) for t in terms], "path string, concept_pos int, section_pos int, term_pos int, lang string, term string, error string")
    assert {(r.source_term, r.target_term) for r in exchange.two_languages(d).collect()} == {("a", "b"), ("d", "i")}
