import pytest

from babelmill import catalog
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, con, name):
    oracle.assert_same(catalog.QUERIES[name](spark, SF), con, catalog.ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_suppression_equals_brute_force(spark):
    from babelmill.plans import queries

    boxes = [r.asDict() for r in queries._boxes(spark, SF).collect()]
    kept = []
    for page in {b["page"] for b in boxes}:
        chosen = []
        for b in sorted((b for b in boxes if b["page"] == page), key=lambda b: (-b["score"], b["pos"])):
            def clash(k, b=b):
                w, h = min(b["x2"], k["x2"]) - max(b["x1"], k["x1"]), min(b["y2"], k["y2"]) - max(b["y1"], k["y1"])
                inter = max(w, 0) * max(h, 0)
                size = lambda x: (x["x2"] - x["x1"]) * (x["y2"] - x["y1"])
                return inter / (size(b) + size(k) - inter) > 0.5 or inter / min(size(b), size(k)) > 0.7
            if not any(clash(k) for k in chosen):
                chosen.append(b)
        kept += [b["pos"] for b in chosen]
    assert sorted(kept) == sorted(r.pos for r in catalog.QUERIES["suppressed_boxes"](spark, SF).collect())
