"""Large exchange files read by many tasks: one row a unit, whatever the size of the file.

Spark's text reader cuts a file at the closing tag of its units (`lineSep`), so its own byte ranges, from any file system,
become partitions that begin and end between two units. A piece is parsed by itself, prefixes that it uses being declared
for it; what stands before the first unit and behind the last one is parsed together. Pieces know their range and their number in
it, and running sums over the few ranges of a file give positions.

A file in which any piece can't be parsed by itself (closing tags in comments, entities of its own, other encodings, or damage)
is read again as a whole, by the same parser: its rows, or its one error row, are then those of `exchange.parsed`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from babelmill.operators.lineage import stored
from babelmill.sources import exchange

PREFIX = re.compile(r"[<\s/]([A-Za-z_][\w.-]*):[A-Za-z_]")
#: Encodings whose bytes are those of UTF-8, or a part of it.
PLAIN = re.compile(r"""<\?xml[^>]*encoding\s*=\s*["'](?!(?i:utf-8|us-ascii|ascii)["'])""")


class Kind:
    """Units of a format: their tag, the parser of a whole file, its schema, and which column numbers units or rows."""

    def __init__(self, tag: str, parser: Callable[[bytes], list[tuple]], schema: str, position: str, by_row: bool) -> None:
        self.tag, self.parser, self.schema, self.position, self.by_row = tag, parser, schema, position, by_row
        self.names = [c.split()[0] for c in schema.split(", ")]
        self.opening = re.compile(rf"<{re.escape(tag)}(?=[\s>/])")

    def piece(self, text: str) -> tuple[int, list[tuple]]:
        """Number of units and rows, with positions from 0, of text that holds whole units."""
        spaces = "".join(f' xmlns:{p}="u:{p}"' for p in sorted(set(PREFIX.findall(text)) - {"xml", "xmlns"}) if f"xmlns:{p}" not in text)
        whole = f"<units{spaces}>{text}</units>".encode()
        units = sum(exchange.name_of(e) == self.tag for e in ET.fromstring(whole).iter())
        return units, self.parser(whole)


TMX = Kind("tu", exchange.tmx_variants, exchange.TMX, "unit_pos", False)
TBX = Kind("termEntry", exchange.tbx_terms, exchange.TBX, "concept_pos", False)
TBX_CONCEPTS = Kind("conceptEntry", exchange.tbx_terms, exchange.TBX, "concept_pos", False)
XLIFF = Kind("trans-unit", exchange.xliff_segments, exchange.XLIFF, "pos", True)


def _pieces(kind: Kind):
    """Rows of each piece with its range and number: units, rows, head and tail of files, and errors."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number, units, rows = (None, None), 0, 0, 0
        for batch in batches:
            out: list[tuple] = []
            for path, block, text in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "value")), strict=True):
                try:
                    text = text.decode()
                except UnicodeDecodeError as e:
                    out.append((path, block, number, "error", None, None, str(e), *[None] * len(kind.names)))
                    continue
                if at != (path, block):  # ranges come one after the other, each in order
                    at, number, units, rows = (path, block), 0, 0, 0
                start = kind.opening.search(text)
                nothing = [None] * len(kind.names)
                if number == 0 and block == 0:
                    head = text[: start.start()] if start else text
                    out.append((path, block, number, "head" if start else "only", None, None, head, *nothing))
                if start is None:
                    out.append((path, block, number, "tail", None, None, text, *nothing))
                else:
                    begin = start.start() if number == 0 and block == 0 else 0
                    try:
                        n, found = kind.piece(f"{text[begin:]}</{kind.tag}>")
                    except ET.ParseError as e:
                        n, found = 0, []
                        out.append((path, block, number, "error", None, None, str(e), *nothing))
                    p = kind.names.index(kind.position)
                    for r in found:
                        shift = rows if kind.by_row else units
                        out.append((path, block, number, "row", None, None, None, *r[:p], r[p] + shift, *r[p + 1 :]))
                    units, rows = units + n, rows + len(found)
                    out.append((path, block, number, "count", n, len(found), None, *nothing))
                number += 1
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)

    types = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [("path", pa.string()), ("block", pa.int64()), ("number", pa.int64()), ("what", pa.string()), ("units", pa.int64()), ("rows", pa.int64()), ("held", pa.string())]
    schema = pa.schema([*fields, *[(c.split()[0], types[c.split()[1]]) for c in kind.schema.split(", ")]])
    return pieces


def read_units(spark: SparkSession, path: str, glob: str, kind: Kind) -> DataFrame:
    """The rows of exchange.parsed() for the files below a folder whose names match, read in byte ranges."""
    text = spark.read.option("lineSep", f"</{kind.tag}>").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
    text = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    schema = f"path string, block long, number long, what string, units long, rows long, held string, {kind.schema}"
    found = stored(text.mapInArrow(_pieces(kind), schema), "unit-pieces")
    sizes = found.where("what = 'count'").groupBy("path", "block").agg(F.sum("rows" if kind.by_row else "units").alias("n"))
    before = F.sum("n").over(W.partitionBy("path").orderBy("block")) - F.col("n")
    sizes = sizes.select("path", "block", before.alias("before"))
    whole = _unsound(found)
    rows = found.where("what = 'row'").join(F.broadcast(whole), "path", "left_anti").join(sizes, ["path", "block"])
    shifted = (F.col(kind.position) + F.col("before")).cast("int").alias(kind.position)
    rows = rows.select("path", *[shifted if c == kind.position else F.col(c) for c in kind.names], F.lit(None).cast("string").alias("error"))
    # The paths of the files that are read as a whole; a list that only damaged or unusual files are in.
    again = [r["path"] for r in whole.collect()]
    if not again:
        return rows
    files = spark.read.format("binaryFile").load([p.replace("%20", " ") for p in again]).select("path", "content")
    return rows.unionByName(exchange.parsed(files, kind.parser, kind.schema))


def _unsound(found: DataFrame) -> DataFrame:
    """path of the files that are not read in pieces: a piece is wrong, or head and tail are not one document around it."""
    end = F.max(F.struct("block", "number"))
    ends = found.where("what <> 'row'").groupBy("path").agg(
        F.max(F.when(F.col("what") == "head", F.col("held"))).alias("head"), F.max(F.when(F.col("what") == "tail", F.col("held"))).alias("tail"),
        F.count(F.when(F.col("what") == "tail", 1)).alias("tails"), F.max(F.col("what") == "error").alias("wrong"), end.alias("end"),
        F.max(F.when(F.col("what") == "tail", F.struct("block", "number"))).alias("at"),
    )

    @F.pandas_udf(T.BooleanType())
    def sound(head, tail):
        import pandas as pd

        return pd.Series([is_sound(h, t) for h, t in zip(head, tail, strict=True)], dtype=bool)

    good = (F.col("tails") == 1) & ~F.col("wrong") & (F.col("at") == F.col("end")) & F.col("head").isNotNull() & sound("head", "tail")
    return stored(ends.where(~F.coalesce(good, F.lit(False))).select("path"), "unit-whole")


def is_sound(head: str | None, tail: str | None) -> bool:
    if head is None or tail is None or PLAIN.search(head) or "<!DOCTYPE" in head and "[" in head:
        return False
    try:
        ET.fromstring((head.lstrip("﻿") + tail).encode())
    except ET.ParseError:
        return False
    return True
