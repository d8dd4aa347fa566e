"""Layout boxes: overlap measures, assignment of lines, suppression of overlapping boxes, reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from babelmill.functions.segmentation import grouped, sentences, strip
from babelmill.operators.lineage import stored


def intersection(a: str, b: str) -> Column:
    x = F.least(F.col(f"{a}.x2"), F.col(f"{b}.x2")) - F.greatest(F.col(f"{a}.x1"), F.col(f"{b}.x1"))
    y = F.least(F.col(f"{a}.y2"), F.col(f"{b}.y2")) - F.greatest(F.col(f"{a}.y1"), F.col(f"{b}.y1"))
    return F.greatest(x, F.lit(0.0)) * F.greatest(y, F.lit(0.0))


def area(a: str) -> Column:
    return (F.col(f"{a}.x2") - F.col(f"{a}.x1")) * (F.col(f"{a}.y2") - F.col(f"{a}.y1"))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def iou(a: str, b: str) -> Column:
    return share(intersection(a, b), area(a) + area(b) - intersection(a, b))


def ioa(a: str, b: str) -> Column:
    """Intersection over the smaller area."""
    return share(intersection(a, b), F.least(area(a), area(b)))


def celled(boxes: DataFrame, top: int) -> DataFrame:
    """boxes as structs `box` under the grid cells they touch: page, level, cx, cy.

    Cells of level n are 2**n wide. A box begins at the level whose cells are at least as large as it is, so it touches four
    at most there, and stands in all levels above up to `top`. Boxes without an area touch nothing.
    """
    extent = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    level = F.ceil(F.log2(extent)).cast("int")
    held = boxes.where("x2 > x1 and y2 > y1").select(F.struct(*boxes.columns).alias("box"), level.alias("own"))
    held = held.select("box", "own", F.explode(F.sequence(F.least("own", F.lit(top)), F.lit(top))).alias("level"))
    cell = lambda c: F.floor(F.col(f"box.{c}") / F.pow(F.lit(2.0), "level")).cast("long")
    held = held.select("*", F.explode(F.sequence(cell("x1"), cell("x2"))).alias("cx"))
    return held.select("box", "own", "level", "cx", F.explode(F.sequence(cell("y1"), cell("y2"))).alias("cy"))


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of structs l and b of one page whose boxes share an area, each once: an equi-join on the page and a grid cell.

    A pair meets at the level of its larger box, and there in the cell of the lower corner of what they share; so no key
    has more rows than boxes that touch one cell, however many a page has.
    """
    extent = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    largest = [x.where("x2 > x1 and y2 > y1").agg(F.max(F.ceil(F.log2(extent)))).first()[0] for x in (left, right)]
    top = int(max((x for x in largest if x is not None), default=0))
    l, r = celled(left, top).withColumnRenamed("box", "l"), celled(right, top).withColumnRenamed("box", "b").withColumnRenamed("own", "own_b")
    l, r = l.withColumn("page", F.col("l.page")), r.withColumn("page", F.col("b.page"))
    both = l.join(r, ["page", "level", "cx", "cy"]).where(F.col("level") == F.greatest("own", "own_b"))
    owner = lambda c: F.floor(F.greatest(F.col(f"l.{c}"), F.col(f"b.{c}")) / F.pow(F.lit(2.0), "level")).cast("long")
    return both.where((F.col("cx") == owner("x1")) & (F.col("cy") == owner("y1"))).where(intersection("l", "b") > 0).select("l", "b")


def lines_in_boxes(lines: DataFrame, boxes: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs (structs l and b) of a page's lines and boxes that overlap enough; `least` is above 0."""
    return overlapping(lines, boxes).where(ioa("l", "b") >= least)


def outside_tables(boxes: DataFrame, tables: DataFrame, most: float = 0.7) -> DataFrame:
    """Boxes (page, pos, ...) that no table covers."""
    covered = overlapping(tables, boxes).where(ioa("l", "b") >= most).select("b.page", "b.pos").distinct()
    return boxes.join(covered, ["page", "pos"], "left_anti")


def suppress(boxes: DataFrame, iou_most: float = 0.5, ioa_most: float = 0.7) -> DataFrame:
    """Greedy suppression by score within each page, ties by pos, in rounds over the pairs that overlap too much.

    A box that no undecided box of a higher score overlaps stays, and those that it overlaps go; the rest is decided in the
    next round. That gives the greedy result whatever the order of work, in few rounds unless boxes form long chains of
    falling scores; no page is ever gathered in one task.
    """
    clash = (iou("l", "b") > iou_most) | (ioa("l", "b") > ioa_most)
    first = (F.col("l.score") > F.col("b.score")) | ((F.col("l.score") == F.col("b.score")) & (F.col("l.pos") < F.col("b.pos")))
    name = lambda x: F.struct(F.col(f"{x}.page").alias("page"), F.col(f"{x}.pos").alias("pos"))
    pairs = stored(overlapping(boxes, boxes).where(first & clash).select(name("l").alias("high"), name("b").alias("low")), "layout-pairs")
    gone = pairs.select("low").limit(0)
    while pairs.head(1):
        lows = pairs.select("low").distinct()
        stays = pairs.select("high").distinct().join(lows.withColumnRenamed("low", "high"), "high", "left_anti")
        now = stored(pairs.join(stays, "high").select("low").distinct(), "layout-gone")
        gone = gone.union(now)
        # Pairs of what stays are settled; so are those of what goes.
        pairs = pairs.join(stays, "high", "left_anti").join(now, "low", "left_anti").join(now.withColumnRenamed("low", "high"), "high", "left_anti")
        pairs = stored(pairs.select("high", "low"), "layout-pairs")
    return boxes.join(gone.select("low.page", "low.pos"), ["page", "pos"], "left_anti").select(*boxes.columns)


# The classes of regions whose text is taken; a table without cells of its own counts as text.
TEXT_CLASSES = ("Caption", "Footnote", "Formula", "List-item", "Page-footer", "Section-header", "Text", "Title", "Table")


def page_text(regions: DataFrame, tables: DataFrame, lines: DataFrame, together: int = 1) -> DataFrame:
    """page, place, type, text: the segments of pages in reading order.

    regions(page, pos, x1, y1, x2, y2, score, cls) are suppressed, then kept if their class has text and no table(page, pos, x1,
    y1, x2, y2) covers them; the lines(page, pos, x1, y1, x2, y2, text) inside a region, in their order, are its text, which is cut into
    sentences, `together` in a segment. A region without text has no segment.
    """
    held = suppress(regions).where(F.col("cls").isin(*TEXT_CLASSES))
    held = outside_tables(held, tables)
    found = lines_in_boxes(lines, held).select("b", F.struct("l.pos", "l.text").alias("line"))
    text = found.groupBy("b").agg(F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: F.concat(x["text"], F.lit("\n"))), "").alias("text"))
    pieces = text.select("b.*", F.posexplode(grouped(sentences(F.col("text")), together)).alias("nth", "segment"))
    kind = F.when(F.col("cls") == "Table", "Text").otherwise(F.col("cls"))
    place = F.row_number().over(W.partitionBy("page").orderBy(*reading_order(), "nth"))
    return pieces.select("page", place.alias("place"), kind.alias("type"), F.col("segment").alias("text"))


def table_cells(tables: DataFrame) -> DataFrame:
    """page, num, row, col, rows, cols, text of the cells with text of tables(page, num, data array<array<string>>): a table has as many
    columns as its longest row, and blank or missing cells are left out but count."""
    sizes = F.transform("data", lambda r: F.coalesce(F.size(r), F.lit(0)))
    rows = tables.select("page", "num", F.size("data").alias("rows"), F.array_max(sizes).alias("cols"), F.posexplode("data").alias("row", "_row"))
    cells = rows.select("page", "num", "row", F.posexplode("_row").alias("col", "text"), "rows", "cols")
    return cells.where(F.coalesce(strip(F.col("text")), F.lit("")) != "").select("page", "num", "row", "col", "rows", "cols", "text")


def reading_order() -> list[Column]:
    return [F.bround("y1"), F.col("x1"), F.col("pos")]
