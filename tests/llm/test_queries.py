import pytest

from babelmill.llm import registry
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    oracle.assert_same(registry.QUERIES[name](spark, SF), oracle.connection(SF), registry.ORACLES[name])


def test_pipeline(spark):
    import corpus_pipeline
    from babelmill.llm.common import stored, table

    docs = table(spark, SF, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF), "stage")
        if name != "sharding":
            assert out.columns == table(spark, SF, "documents").columns
        before = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
        if name in ("quality_rules", "near_dedup", "decontamination"):
            assert {(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()} <= before
        seen[name], docs = out, out
    assert seen["quality_rules"].count() < table(spark, SF, "documents").count()
    assert seen["sharding"].count() == seen["mixing"].count()
    left = registry.decontamination.judge(seen["decontamination"].select("doc_id", "text").withColumnRenamed("doc_id", "row_id"), table(spark, SF, "benchmark"))
    assert left.where("contaminated").count() == 0
