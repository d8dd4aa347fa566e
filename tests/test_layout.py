"""Grid joins and suppression in rounds against all pairs of a page."""

import random

import pytest

from babelmill.operators import layout

BOX = "page long, pos long, x1 double, y1 double, x2 double, y2 double, score double"


def made(seed, n, pages):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y, w, h = r.uniform(-50, 50), r.uniform(-50, 50), r.choice([0.01, 1, 8, 40, 300]) * r.random(), r.choice([0.5, 3, 30]) * r.random()
        out.append((i % pages, i, round(x, 3), round(y, 3), round(x + w, 3), round(y + h, 3), r.choice([0.1, 0.5, 0.5, 0.9, r.random()])))
    return out + [(0, n, 1.0, 1.0, 1.0, 5.0, 0.9), (0, n + 1, 3.0, 3.0, 2.0, 2.0, 0.9), (1, n + 2, -64.0, -64.0, 64.0, 64.0, 0.2), (1, n + 3, 0.0, 0.0, 2.0, 2.0, 0.2), (1, n + 4, 0.0, 0.0, 2.0, 2.0, 0.2)]


def shared(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    return max(w, 0.0) * max(h, 0.0)


def area(a):
    return (a[4] - a[2]) * (a[5] - a[3])


def clash(a, b):
    both = shared(a, b)
    return both > 0 and (both / (area(a) + area(b) - both) > 0.5 or both / min(area(a), area(b)) > 0.7)


@pytest.mark.parametrize("seed,pages", [(1, 1), (2, 7), (3, 2)])
def test_overlapping_pairs_are_met_once(spark, seed, pages):
    rows = made(seed, 150, pages)
    left, right = rows[::2], rows[1::2]
    df = lambda x: spark.createDataFrame(x, BOX).repartition(3)
    got = sorted((r.l.pos, r.b.pos) for r in layout.overlapping(df(left), df(right)).collect())
    assert got == sorted((a[1], b[1]) for a in left for b in right if a[0] == b[0] and area(a) > 0 and area(b) > 0 and a[4] > a[2] and b[4] > b[2] and shared(a, b) > 0)
    inside = sorted((r.l.pos, r.b.pos) for r in layout.lines_in_boxes(df(left), df(right)).collect())
    assert set(inside) <= set(got) and inside


@pytest.mark.parametrize("seed,pages", [(4, 1), (5, 5)])
def test_suppression_is_greedy(spark, seed, pages):
    rows = made(seed, 120, pages)
    kept = []
    for b in sorted(rows, key=lambda b: (-b[6], b[1])):
        if not any(k[0] == b[0] and clash(k, b) for k in kept):
            kept.append(b)
    got = layout.suppress(spark.createDataFrame(rows, BOX).repartition(3))
    assert got.columns == [x.split()[0] for x in BOX.split(", ")]
    assert sorted(r.pos for r in got.collect()) == sorted(b[1] for b in kept) and len(kept) < len(rows)


def test_a_chain_of_falling_scores(spark):
    """Each box overlaps the next one only: every other one stays."""
    rows = [(0, i, i * 1.0, 0.0, i * 1.0 + 4.0, 1.0, 1 - i / 100) for i in range(9)]
    got = sorted(r.pos for r in layout.suppress(spark.createDataFrame(rows, BOX), iou_most=0.55, ioa_most=0.7).collect())
    assert got == [0, 2, 4, 6, 8]


def test_empty_sides(spark):
    none, some = spark.createDataFrame([], BOX), spark.createDataFrame(made(1, 5, 1), BOX)
    assert layout.overlapping(none, some).collect() == [] and layout.suppress(none).collect() == []
    assert layout.outside_tables(some, none).count() == some.count()


def test_spatial_lines_meet_on_pages_that_grow(spark):
    """Fifty pages at every size, so lines meet boxes of the whole page before, not of forty rows."""
    from babelmill import catalog

    pages = {s: {r.page for r in catalog.QUERIES["spatial_lines"](spark, f"/root/testdata/sf{s}").select("page").distinct().collect()} for s in ("0.01", "0.1")}
    assert pages["0.1"] == set(range(2, 50, 2)) and pages["0.01"] <= pages["0.1"]  # rows of even keys
    assert catalog.QUERIES["spatial_lines"](spark, "/root/testdata/sf0.1").count() == 6120  # by DuckDB, all pairs of a page


def test_boxes_outside_tables_meet_on_pages_that_grow(spark):
    """A page's boxes are tried against all tables of a fiftieth of the rows."""
    from babelmill import catalog

    got = catalog.QUERIES["boxes_outside_tables"](spark, "/root/testdata/sf0.1")
    assert {r.page for r in got.select("page").distinct().collect()} <= set(range(50))
    assert got.count() == 1369  # by DuckDB, all pairs of a page
