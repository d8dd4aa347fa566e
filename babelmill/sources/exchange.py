"""Exchange files as DataFrames: TMX, TBX, XLIFF and DOCX, one task a file, from spark.read.format("binaryFile").

Each parser is a small per-file function inside mapInArrow; files that can't be parsed give one row with `error`.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from xml.etree import ElementTree as ET

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from babelmill.functions.segmentation import sentences
from babelmill.functions.text import block_type, language_matches

XML_LANG = "{http://www.w3.org/XML/1998/namespace}lang"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """path, content of the files below a folder whose names match."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")


#: Rows, files and bytes that a task gathers at most before it hands them on.
ROWS, FILES, BYTES = 4096, 256, 1 << 24
TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}


def parsed(source: DataFrame, parser: Callable[[bytes], Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that parser finds in each file, with its path and an error column. A parser that gives rows one by one must
    raise its errors before the first."""
    names = [c.split()[0] for c in schema.split(", ")]
    made = pa.schema([("path", pa.string()), *[(c.split()[0], TYPES[c.split()[1]]) for c in schema.split(", ")], ("error", pa.string())])

    def rows_of(path: str, content: bytes) -> Iterator[tuple]:
        try:
            for row in parser(content):
                yield (path, *row, None)
        except (ET.ParseError, zipfile.BadZipFile, KeyError) as e:
            yield (path, *[None] * len(names), f"{type(e).__name__}: {e}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One file at a time as Python's bytes, and rows handed on by number, not by file.
            every = (row for path, content in zip(batch.column("path"), batch.column("content"), strict=True) for row in rows_of(path.as_py(), content.as_py()))
            while held := list(islice(every, ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), made, strict=True)], schema=made)

    return source.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(run, f"path string, {schema}, error string")


def name_of(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def text_of(element: ET.Element) -> str:
    return "".join(element.itertext()).strip()


def tmx_variants(content: bytes) -> list[tuple]:
    """unit_pos, variant_pos, lang, text of every variant with text; the schema is TMX."""
    out = []
    for unit_pos, unit in enumerate(ET.fromstring(content).iter("tu")):
        for variant_pos, variant in enumerate(unit.findall("tuv")):
            held = variant.find("seg")
            text = text_of(held) if held is not None else ""
            if text:
                out.append((unit_pos, variant_pos, variant.get(XML_LANG) or variant.get("lang"), text))
    return out


TMX = "unit_pos int, variant_pos int, lang string, text string"


def pair_variants(variants: DataFrame, source: str, target: str) -> DataFrame:
    """Source and target of each unit: the first variant of the source language, the first other one of the target's."""
    lang = lambda wanted: F.coalesce(language_matches(F.col("lang"), F.lit(wanted)), F.lit(False))
    v = variants.where("error is null").withColumns({"_s": lang(source), "_t": lang(target)})
    unit = v.groupBy("path", "unit_pos").agg(F.array_sort(F.collect_list(F.struct("variant_pos", "text", "_s", "_t"))).alias("v"))
    first = F.get(F.filter("v", lambda x: x["_s"]), F.lit(0))
    unit = unit.withColumn("s", first)
    other = F.get(F.filter("v", lambda x: x["_t"] & (x["variant_pos"] != F.col("s.variant_pos"))), F.lit(0))
    pairs = unit.withColumn("t", other).where("s is not null and t is not null")
    return pairs.select("path", F.col("unit_pos").alias("position"), F.col("s.text").alias("source_text"), F.col("t.text").alias("target_text"))


class _Unheld:
    """What a parser makes of a file that is only checked: nothing."""

    def close(self) -> None:
        pass


def tbx_rows(content: bytes) -> Iterator[tuple]:
    """The rows of tbx_terms one by one; of a term base, however large, only one concept is held as elements."""
    check = ET.XMLParser(target=_Unheld())
    for i in range(0, len(content), 1 << 16):
        check.feed(content[i : i + (1 << 16)])
    check.close()
    concept_pos, above, outer = 0, [], None
    for event, e in ET.iterparse(io.BytesIO(content), events=("start", "end")):
        if event == "start":
            if outer is None and name_of(e) in ("termEntry", "conceptEntry"):
                outer = e
            above.append(e)
            continue
        above.pop()
        if e is not outer:
            continue
        for concept in (c for c in e.iter() if name_of(c) in ("termEntry", "conceptEntry")):
            yield from _terms_of(concept, concept_pos)
            concept_pos += 1
        outer = None
        if above:
            above[-1].remove(e)


def _terms_of(concept: ET.Element, concept_pos: int) -> Iterator[tuple]:
    sections = [e for e in concept if name_of(e) in ("langSet", "langSec")]
    for section_pos, section in enumerate(sections):
        lang = section.get(XML_LANG) or section.get("lang")
        groups = [g for g in section if name_of(g) in ("tig", "termSec", "ntig")]
        for term_pos, group in enumerate(groups):
            inner = next((e for e in group if name_of(e) == "termGrp"), None) if name_of(group) == "ntig" else group
            term = next((e for e in inner if name_of(e) == "term"), None) if inner is not None else None
            if term is not None and text_of(term):
                yield concept_pos, section_pos, term_pos, lang, text_of(term)


def tbx_terms(content: bytes) -> list[tuple]:
    """concept_pos, section_pos, term_pos, lang, term: the first term of each group; the schema is TBX."""
    return list(tbx_rows(content))


TBX = "concept_pos int, section_pos int, term_pos int, lang string, term string"


def glossary_of(terms: DataFrame, source: str, target: str) -> DataFrame:
    """source_term, target_term of each concept with both languages: of a language's sections the last, its first term;
    of concepts with one source term the first."""
    lang = lambda wanted: F.coalesce(language_matches(F.col("lang"), F.lit(wanted)), F.lit(False))
    at = F.struct(-F.col("section_pos"), F.col("term_pos"))
    pick = lambda flag: F.min_by("term", F.when(lang(flag), at))
    c = terms.where("error is null").groupBy("path", "concept_pos").agg(pick(source).alias("source_term"), pick(target).alias("target_term"))
    c = c.where("source_term is not null and target_term is not null")
    return c.groupBy("path", "source_term").agg(F.min_by("target_term", "concept_pos").alias("target_term"), F.min("concept_pos").alias("position"))


def two_languages(terms: DataFrame) -> DataFrame:
    """As glossary_of, without asking for languages: concepts in exactly two, the first that appears being the source."""
    held = terms.where("error is null and lang <> ''")
    first = held.groupBy("path", "concept_pos", "lang").agg(F.min(F.struct("section_pos", "term_pos", "term")).alias("t"))
    c = first.groupBy("path", "concept_pos").agg(F.count("*").alias("n"), F.min("t").alias("s"), F.max("t").alias("e")).where("n = 2")
    c = c.select("path", "concept_pos", F.col("s.term").alias("source_term"), F.col("e.term").alias("target_term"))
    return c.groupBy("path", "source_term").agg(F.min_by("target_term", "concept_pos").alias("target_term"), F.min("concept_pos").alias("position"))


def xliff_segments(content: bytes) -> list[tuple]:
    """pos, unit_id, id, text, locked: a row a segment (mrk), or a unit without such; the schema is XLIFF."""
    out: list[tuple] = []
    for unit in (e for e in ET.fromstring(content).iter() if name_of(e) == "trans-unit"):
        unit_id = unit.get("id", "")
        confirmed = {e.get("conf") for e in unit.iter() if name_of(e) == "seg"}
        locked = unit.get("translate") == "no" or any(e.get("locked") == "true" for e in unit.iter()) or bool(confirmed & {"ApprovedTranslation", "ApprovedSignOff"})
        divided = next((e for e in unit if name_of(e) == "seg-source"), None)
        marks = [m for m in divided.iter() if name_of(m) == "mrk" and m.get("mtype") == "seg"] if divided is not None else []
        held = next((e for e in unit if name_of(e) == "source"), None)
        found = [(m.get("mid", unit_id), text_of(m)) for m in marks] if marks else [(unit_id, text_of(held))] if held is not None else []
        out += [(len(out) + i, unit_id, mid, text, locked) for i, (mid, text) in enumerate(x for x in found if x[1])]
    return out


XLIFF = "pos int, unit_id string, id string, text string, locked boolean"


def docx_parts(names: list[str]) -> list[tuple[str, str]]:
    """part, file of the parts of a DOCX that hold text: the first header, the body, the first footer."""
    first = lambda kind: next(((kind, n) for n in sorted(names) if re.fullmatch(rf"word/{kind}\d*\.xml", n)), None)
    return [p for p in (first("header"), ("body", "word/document.xml"), first("footer")) if p]


def docx_paragraphs(content: bytes) -> list[tuple]:
    """part, element, row, col, text, style of the paragraphs and cells of header, body and footer, whether they are numbered, and the
    format of their first run with text; the schema is DOCX."""
    out: list[tuple] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for part, name in docx_parts(z.namelist()):
            for element, node in docx_elements(ET.fromstring(z.read(name)), part):
                if node.tag == f"{WORD}p":
                    style = node.find(f"{WORD}pPr/{WORD}pStyle")
                    numbered = node.find(f"{WORD}pPr/{WORD}numPr") is not None
                    out.append((part, element, None, None, paragraph_text(node), style.get(f"{WORD}val") if style is not None else None, numbered, *run_format(node)))
                else:
                    for r, c, cell in owned_cells(node):
                        first = cell.find(f"{WORD}p")
                        held = run_format(first) if first is not None else (None,) * 6
                        out.append((part, element, r, c, "\n".join(map(paragraph_text, cell.findall(f"{WORD}p"))).strip(), "Table", False, *held))
    return out


def run_format(paragraph: ET.Element) -> tuple:
    """font, size in points, bold, italic, underline, color of the first run that holds text; null where it says nothing."""
    for run in paragraph.iter(f"{WORD}r"):
        if not "".join(t.text or "" for t in run.iter(f"{WORD}t")).strip():
            continue
        held = {name_of(e): e for e in run.find(f"{WORD}rPr") or ()}
        of = lambda name, attribute="val": held[name].get(f"{WORD}{attribute}") if name in held else None  # noqa: B023, E731
        switch = lambda name: (of(name) or "1").lower() not in ("0", "false", "off", "none") if name in held else None  # noqa: B023, E731
        size, color = of("sz"), of("color")
        return of("rFonts", "ascii"), float(size) / 2 if size else None, switch("b"), switch("i"), switch("u"), color if color != "auto" else None
    return (None,) * 6


def docx_elements(root: ET.Element, part: str) -> list[tuple[int, ET.Element]]:
    """Place among all elements of a part, and element, of its paragraphs and tables."""
    top = root.find(f"{WORD}body") if part == "body" else root
    return [(i, e) for i, e in enumerate(top) if e.tag in (f"{WORD}p", f"{WORD}tbl")]


def owned_cells(table: ET.Element) -> list[tuple[int, int, ET.Element]]:
    """Row, column and cell of each cell of a table once, where it begins: a cell owns the places of the grid that its column
    span and the continuations below it take."""
    owner: dict[tuple[int, int], ET.Element] = {}
    out = []
    for r, row in enumerate(table.findall(f"{WORD}tr")):
        skipped = row.find(f"{WORD}trPr/{WORD}gridBefore")
        c = int(skipped.get(f"{WORD}val", "0")) if skipped is not None else 0
        for cell in row.findall(f"{WORD}tc"):
            span, merge = cell.find(f"{WORD}tcPr/{WORD}gridSpan"), cell.find(f"{WORD}tcPr/{WORD}vMerge")
            width = max(int(span.get(f"{WORD}val", "1")), 1) if span is not None else 1
            goes_on = merge is not None and merge.get(f"{WORD}val", "continue") != "restart" and (r - 1, c) in owner
            held = owner[r - 1, c] if goes_on else cell
            if not goes_on:
                out.append((r, c, cell))
            owner |= {(r, c + i): held for i in range(width)}
            c += width
    return out


def paragraph_text(node: ET.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{WORD}t")).strip()


FORMAT = "font string, size double, bold boolean, italic boolean, underline boolean, color string"
DOCX = f"part string, element int, row int, col int, text string, style string, numbered boolean, {FORMAT}"


def docx_blocks(paragraphs: DataFrame) -> DataFrame:
    """Sentence blocks of paragraphs (id element_i) and whole cells (id element_row_col); in other parts than the body ids
    begin with the part (`header/0_0`). key is the id of the whole paragraph or cell, type its kind of block."""
    p = paragraphs.where("error is null and text <> ''")
    cell = F.col("row").isNotNull()
    pieces = F.when(cell, F.array("text")).otherwise(sentences(F.col("text")))
    kind = F.when(cell, "Table").otherwise(block_type(F.col("style"), F.col("numbered")))
    held = [c.split()[0] for c in FORMAT.split(", ")]
    b = p.select("path", "part", "element", "row", "col", "style", kind.alias("type"), *held, F.posexplode(pieces).alias("i", "text"))
    at = F.when(F.col("part") == "body", "").otherwise(F.concat("part", F.lit("/")))
    whole = F.concat(at, F.when(cell, F.concat_ws("_", "element", "row", "col")).otherwise(F.col("element").cast("string")))
    return b.withColumn("key", whole).withColumn("id", F.when(cell, whole).otherwise(F.concat_ws("_", whole, "i")))


# Encodings in the order in which they are tried.
ENCODINGS = ("utf-8-sig", "utf-16", "cp1256", "windows-1252")


def decoded(source: DataFrame) -> DataFrame:
    """path, text: the first encoding that fits, else null."""

    def one(content: bytes) -> str | None:
        for name in ENCODINGS:
            try:
                return content.decode(name)
            except (UnicodeDecodeError, UnicodeError):
                continue
        return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame.path, "text": [one(bytes(c)) for c in frame.content]})

    return source.mapInPandas(run, "path string, text string")


def sse_events(lines: DataFrame) -> DataFrame:
    """VARIANT payloads of `data: ` lines; malformed ones are left out. Works on batch and streaming text sources."""
    held = lines.where(F.startswith(F.col("value"), F.lit("data: ")))
    return held.select(F.try_parse_json(F.substring(F.col("value"), F.lit(7), F.length("value"))).alias("payload")).where("payload is not null")
