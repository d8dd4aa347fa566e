"""Writing back: translations into XLIFF and DOCX files by segment id, XLIFF from rows, workbooks as CSV."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from babelmill.functions.text import ARABIC, escape_xml, is_arabic, strip
from babelmill.operators.keyed import concatenated, last_wins
from babelmill.operators.styles import mirrored
from babelmill.sources.exchange import BYTES, DOCX, FILES, WORD, docx_blocks, docx_elements, docx_paragraphs, docx_parts, name_of, owned_cells, paragraph_text, parsed


START_TAG = re.compile(rb"<[^?!][^>]*>", re.DOTALL)


def with_preamble(original: bytes, made: bytes) -> bytes:
    """made with the bytes of the original up to the end of its root tag, unless that lacks a namespace that made needs."""
    old, new = START_TAG.search(original), START_TAG.search(made)
    spaces = lambda tag: {(n, u.strip(b"\"'")) for n, u in re.findall(rb"(xmlns[^=\s]*)\s*=\s*(\"[^\"]*\"|'[^']*')", tag)}
    if old is None or new is None or spaces(new[0]) - spaces(old[0]):
        return made
    out = original[: old.end()] + made[new.end() :]
    return out + b"\n" if original.endswith(b"\n") and not out.endswith(b"\n") else out


def filled_xliff(content: bytes, translations: dict[str, str]) -> tuple[bytes, list[str]]:
    """The file with targets set by segment id, and the ids that it does not have, in order."""
    for _, (prefix, uri) in ET.iterparse(io.BytesIO(content), events=["start-ns"]):
        ET.register_namespace(prefix, uri)
    root = ET.fromstring(content)
    space = root.tag[: root.tag.index("}") + 1] if root.tag.startswith("{") else ""
    used: set[str] = set()
    for unit in (e for e in root.iter() if name_of(e) == "trans-unit"):
        parts = list(unit)
        source = next((e for e in parts if name_of(e) == "source"), None)
        if source is None:
            continue
        target = next((e for e in parts if name_of(e) == "target"), None)
        marks = [m for e in parts if name_of(e) == "seg-source" for m in e.iter() if name_of(m) == "mrk" and m.get("mtype") == "seg"]
        ids = [m.get("mid", unit.get("id", "")) for m in marks] or [unit.get("id", "")]
        if not any(i in translations for i in ids):
            continue
        if target is None:
            target = ET.Element(f"{space}target")
            unit.insert(parts.index(source) + 1, target)
        for i in ids:
            if i not in translations:
                continue
            used.add(i)
            if not marks:
                target[:], target.text = [], translations[i]
                continue
            held = [m for m in target.iter() if name_of(m) == "mrk" and m.get("mid") == i]
            for m in held or [ET.SubElement(target, f"{space}mrk", {"mtype": "seg", "mid": i})]:
                m[:], m.text = [], translations[i]
            for e in unit.iter():
                if name_of(e) == "seg" and e.get("id") == i:
                    e.set("conf", "Translated")
    made = ET.tostring(root, encoding="utf-8", xml_declaration=True)
    return with_preamble(content, made), sorted(set(translations) - used)


def docx_alignments(z: zipfile.ZipFile) -> tuple[dict[str, tuple[str | None, str | None]], str | None]:
    """Alignment and parent of each paragraph style, and the default style."""
    if "word/styles.xml" not in z.namelist():
        return {}, None
    styles = [e for e in ET.fromstring(z.read("word/styles.xml")).iter(f"{WORD}style") if e.get(f"{WORD}type", "paragraph") == "paragraph"]
    value = lambda e, path: next((x.get(f"{WORD}val") for x in e.findall(path)), None)
    held = {e.get(f"{WORD}styleId", ""): (value(e, f"{WORD}pPr/{WORD}jc"), value(e, f"{WORD}basedOn")) for e in styles}
    return held, next((e.get(f"{WORD}styleId") for e in styles if e.get(f"{WORD}default") in ("1", "true")), None)


def effective_alignment(paragraph: ET.Element, styles: dict[str, tuple[str | None, str | None]], default: str | None) -> str | None:
    """The paragraph's own alignment, else the nearest one of its style and the styles that this is based on."""
    own = paragraph.find(f"{WORD}pPr/{WORD}jc")
    if own is not None:
        return own.get(f"{WORD}val")
    named = paragraph.find(f"{WORD}pPr/{WORD}pStyle")
    at, seen = named.get(f"{WORD}val") if named is not None else default, set()
    while at in styles and at not in seen:
        seen.add(at)
        alignment, parent = styles[at]
        if alignment is not None:
            return alignment
        at = parent
    return None


#: Children of paragraph properties that stand before bidi and jc, in the order of the format.
BEFORE_BIDI = "pStyle keepNext keepLines pageBreakBefore framePr widowControl numPr suppressLineNumbers pBdr shd tabs suppressAutoHyphens kinsoku wordWrap overflowPunct topLinePunct autoSpaceDE autoSpaceDN".split()
BEFORE_JC = [*BEFORE_BIDI, *"bidi adjustRightInd snapToGrid spacing ind contextualSpacing mirrorIndents suppressOverlap".split()]


def property_of(parent: ET.Element, name: str, before: list[str]) -> ET.Element:
    """The child of a properties element, made behind those that stand before it if there is none."""
    found = parent.find(f"{WORD}{name}")
    if found is None:
        found = ET.Element(f"{WORD}{name}")
        parent.insert(sum(name_of(e) in before for e in parent), found)
    return found


def run_right_to_left(paragraph: ET.Element, alignment: str | None, font: str) -> None:
    """Set a paragraph and its first run to run from right to left, left and right alignment changing places."""
    properties = paragraph.find(f"{WORD}pPr")
    if properties is None:
        properties = ET.Element(f"{WORD}pPr")
        paragraph.insert(0, properties)
    property_of(properties, "bidi", BEFORE_BIDI).set(f"{WORD}val", "1")
    other = {None: "right", "left": "right", "start": "right", "right": "left", "end": "left"}.get(alignment)
    if other is not None:
        property_of(properties, "jc", BEFORE_JC).set(f"{WORD}val", other)
    run = next(paragraph.iter(f"{WORD}r"))
    held = run.find(f"{WORD}rPr")
    if held is None:
        held = ET.Element(f"{WORD}rPr")
        run.insert(0, held)
    fonts = property_of(held, "rFonts", ["rStyle"])
    fonts.set(f"{WORD}cs", font), fonts.set(f"{WORD}hint", "cs")
    if held.find(f"{WORD}rtl") is None:
        ET.SubElement(held, f"{WORD}rtl").set(f"{WORD}val", "1")


def filled_docx(content: bytes, translations: dict[str, str], font: str = "Arial") -> tuple[bytes, list[str]]:
    """The file with the text of paragraphs and cells replaced by their keys (`3`, `5_0_1`; in other parts than the body
    `header/3`), and the keys that it does not have. The first run keeps its format; a text in Arabic script runs from right to left."""
    used: set[str] = set()
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        parts = {name: part for part, name in docx_parts(z.namelist())}
        styles, default = docx_alignments(z)
        for info in z.infolist():
            data = z.read(info.filename)
            if info.filename in parts:
                part = parts[info.filename]
                at = "" if part == "body" else f"{part}/"
                for _, (prefix, uri) in ET.iterparse(io.BytesIO(data), events=["start-ns"]):
                    ET.register_namespace(prefix, uri)
                root = ET.fromstring(data)
                for element, node in docx_elements(root, part):
                    if node.tag == f"{WORD}p":
                        places = [(f"{at}{element}", [node])]
                    else:
                        places = [(f"{at}{element}_{r}_{c}", cell.findall(f"{WORD}p")) for r, c, cell in owned_cells(node)]
                    for key, paragraphs in places:
                        if key not in translations or not any(map(paragraph_text, paragraphs)):
                            continue
                        used.add(key)
                        text = translations[key]
                        first = next(p for p in paragraphs if paragraph_text(p))
                        runs = [t for p in paragraphs for t in p.iter(f"{WORD}t")]
                        for t in runs:
                            t.text = ""
                        head = next(first.iter(f"{WORD}t"))
                        head.text = text
                        head.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
                        if re.search(ARABIC, text):
                            run_right_to_left(first, effective_alignment(first, styles, default), font)
                data = ET.tostring(root, encoding="utf-8", xml_declaration=True)
            w.writestr(info, data)
    return out.getvalue(), sorted(set(translations) - used)


FILLED = "path string, content binary, unmatched array<string>"


def handed_on(rows: Iterable[tuple], schema: pa.Schema, content: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most FILES rows, and of about BYTES bytes in the column numbered `content`."""
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        size += len(row[content])
        if len(held) == FILES or size >= BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _filled(files: DataFrame, updates: DataFrame, fill) -> DataFrame:
    held = updates.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("id", "text"))).alias("held"))
    made = pa.schema([("path", pa.string()), ("content", pa.binary()), ("unmatched", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = zip(*(batch.column(c) for c in ("path", "content", "held")), strict=True)
            yield from handed_on(((p.as_py(), *fill(c.as_py(), dict(h.as_py() or []))) for p, c, h in columns), made, 1)

    return files.join(held, "path", "left").select("path", "content", "held").mapInArrow(run, FILLED)


def fill_xliff(files: DataFrame, translations: DataFrame) -> DataFrame:
    """files(path, content) with translations(path, id, pos, text); of equal ids the last wins."""
    t = translations.where("id is not null").withColumn("_k", F.struct("path", "id"))
    return _filled(files, last_wins(t, "_k", "pos", "text").select("_k.*", "text"), filled_xliff)


def fill_docx(files: DataFrame, translations: DataFrame) -> DataFrame:
    """files(path, content) with translations(path, id, pos, text) by the ids of docx_blocks: path, content, unmatched.

    Texts of one id are joined by a space in order. A paragraph whose sentences are translated in part keeps the others;
    an id of a whole paragraph (docx_blocks' key) replaces all of it; paragraphs without any keep their text. unmatched are the
    ids that no block has, ascending.
    """
    # Rows without a path meet nothing.
    t = concatenated(translations.where("id is not null and path is not null"), ["path", "id"], "pos", "text")
    t = t.select("path", "id", F.col("text").alias("_new"))
    blocks = docx_blocks(parsed(files, docx_paragraphs, DOCX).where("path is not null")).select("path", "key", "id", "i", "text")
    # Dealt by file once, then translations and blocks meet in a window over ids: joins would deal them again by all of their keys.
    of_id = W.partitionBy("path", "id")
    met = t.unionByName(blocks, allowMissingColumns=True).repartition("path")
    met = met.withColumns({"_new": F.max("_new").over(of_id), "_known": F.max("key").over(of_id)})
    # An id that no block has may be that of a whole paragraph.
    met = met.where("key is not null or _known is null").withColumn("_key", F.coalesce("key", "id"))
    by_key = met.groupBy("path", "_key").agg(
        F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("i", F.coalesce("_new", "text").alias("text"))))).alias("pieces"),
        F.max(F.when(F.col("id") == F.col("_key"), F.col("_new"))).alias("whole"), F.max(F.col("_new").isNotNull()).alias("some"),
    )
    text = F.coalesce("whole", F.array_join(F.transform("pieces", lambda x: x["text"]), " "))
    new = by_key.where("some and size(pieces) > 0").select("path", F.col("_key").alias("id"), text.alias("text"))
    missing = by_key.where("size(pieces) = 0").groupBy("path").agg(F.array_sort(F.collect_list("_key")).alias("missing"))
    filled = _filled(files, new, filled_docx).drop("unmatched").join(missing, "path", "left")
    return filled.select("path", "content", F.coalesce("missing", F.array().cast("array<string>")).alias("unmatched"))


def new_xliff(rows: DataFrame, source: str, target: str) -> DataFrame:
    """document_id, xml: XLIFF 1.2 of rows(document_id, pos, source_text, target_text), unit ids seg_1 and so on."""
    unit = F.struct("pos", escape_xml(F.coalesce("source_text", F.lit(""))).alias("s"), escape_xml(F.coalesce("target_text", F.lit(""))).alias("t"))
    docs = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(unit)).alias("units"))
    one = lambda u, i: F.concat(F.lit('<trans-unit id="seg_'), (i + 1).cast("string"), F.lit('"><source>'), u["s"], F.lit("</source><target>"), u["t"], F.lit("</target></trans-unit>"))
    head = f'<?xml version="1.0" encoding="UTF-8"?><xliff xmlns="urn:oasis:names:tc:xliff:document:1.2" version="1.2"><file source-language="{source}" target-language="{target}" datatype="plaintext" original="document"><body>'
    return docs.select("document_id", F.concat(F.lit(head), F.array_join(F.transform("units", one), ""), F.lit("</body></file></xliff>")).alias("xml"))


_PACKAGE = "application/vnd.openxmlformats-"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def zipped(document: str, footer: str | None = None) -> bytes:
    """A word-processing package of a document part and perhaps a footer; the same bytes each time."""
    named = [("document", document), ("footer1", footer)] if footer is not None else [("document", document)]
    kinds = "".join(f'<Override PartName="/word/{n}.xml" ContentType="{_PACKAGE}officedocument.wordprocessingml.{"document.main" if n == "document" else "footer"}+xml"/>' for n, _ in named)
    links = lambda held: f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{held}</Relationships>'
    parts = [
        ("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="{_PACKAGE}package.relationships+xml"/>{kinds}</Types>'),
        ("_rels/.rels", links(f'<Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="word/document.xml"/>')),
        *[(f"word/{n}.xml", x) for n, x in named],
    ]
    if footer is not None:
        parts.append(("word/_rels/document.xml.rels", links(f'<Relationship Id="f1" Type="{_OFFICE}/footer" Target="footer1.xml"/>')))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        for name, part in parts:
            w.writestr(zipfile.ZipInfo(name), part)
    return out.getvalue()


def paragraph_xml(text: Column, style: Column, alignment: Column) -> Column:
    """A paragraph; text in Arabic script runs from right to left, with left (also unsaid) and right alignment mirrored."""
    arabic = is_arabic(text)
    side = F.when(arabic, mirrored(alignment)).otherwise(alignment)
    tag = lambda name, value: F.coalesce(F.concat(F.lit(f'<w:{name} w:val="'), escape_xml(value), F.lit('"/>')), F.lit(""))
    if_arabic = lambda x: F.when(arabic, x).otherwise("")
    return F.concat(
        F.lit("<w:p><w:pPr>"), tag("pStyle", style), if_arabic("<w:bidi/>"), tag("jc", side), F.lit("</w:pPr><w:r>"),
        if_arabic("<w:rPr><w:rtl/></w:rPr>"), F.lit('<w:t xml:space="preserve">'), escape_xml(text), F.lit("</w:t></w:r></w:p>"),
    )


def packed(docs: DataFrame) -> DataFrame:
    """path, content of docs(document_id, body, footer): whole files, footer null where there is none."""
    linked = F.when(F.col("footer").isNotNull(), f'<w:sectPr><w:footerReference xmlns:r="{_OFFICE}" w:type="default" r:id="f1"/></w:sectPr>').otherwise("")
    body = F.concat(F.lit(f'<w:document xmlns:w="{WORD[1:-1]}"><w:body>'), F.col("body"), linked, F.lit("</w:body></w:document>"))
    foot = F.concat(F.lit(f'<w:ftr xmlns:w="{WORD[1:-1]}">'), F.col("footer"), F.lit("</w:ftr>"))

    made = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = zip(*(batch.column(c) for c in ("path", "document", "foot")), strict=True)
            yield from handed_on(((p.as_py(), zipped(d.as_py(), f.as_py())) for p, d, f in columns), made, 1)

    return docs.select(F.col("document_id").cast("string").alias("path"), body.alias("document"), foot.alias("foot")).mapInArrow(pack, "path string, content binary")


def new_docx(rows: DataFrame) -> DataFrame:
    """path, content: a DOCX of each document of rows(document_id, pos, text, style, alignment), paragraphs in order; null
    text is an empty paragraph."""
    paragraph = paragraph_xml(F.coalesce(F.col("text"), F.lit("")), F.col("style"), F.col("alignment"))
    docs = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("pos", paragraph.alias("p")))).alias("p"))
    return packed(docs.select("document_id", F.array_join(F.transform("p", lambda x: x["p"]), "").alias("body"), F.lit(None).cast("string").alias("footer")))


# Styles and alignments of block types, where a block names no style of its own.
STYLES = {"Title": "Title", "Section-header": "Heading1", "List-item": "ListBullet", "Caption": "Caption", "Formula": "Formula", "Footnote": "Footnote"}
CENTRED = ("Caption", "Formula")


def assembled_docx(blocks: DataFrame) -> DataFrame:
    """path, content: a DOCX of the pages of each document, built from blocks(document_id, page, pos, type, text, style, num, row,
    col, rows, cols).

    In a page, blocks stand in order; Table blocks that follow each other with one num are a table of rows x cols cells, in
    which a repeated place holds its last text; footnotes come behind everything else, after an empty paragraph. Pages are parted by page
    breaks; the last Page-footer is the footer. Line breaks in a text are spaces; blank texts are left out, but end a table
    run like any other block.
    """
    text = strip(F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " "))
    in_page = W.partitionBy("document_id", "page").orderBy("pos")
    table = F.col("type") == "Table"
    same = F.coalesce((F.lag("type").over(in_page) == "Table") & (F.lag("num").over(in_page) == F.col("num")), F.lit(False))
    b = blocks.withColumn("text", text).withColumn("_new", F.when(table & same, 0).otherwise(1)).withColumn("run", F.sum("_new").over(in_page)).where("text <> ''")
    style = F.coalesce("style", *[F.when(F.col("type") == k, v) for k, v in STYLES.items()])
    side = F.when(F.col("type").isin(*CENTRED), "center")
    single = b.where(~table & (F.col("type") != "Page-footer")).select(
        "document_id", "page", F.when(F.col("type") == "Footnote", 1).otherwise(0).alias("last"), "run", paragraph_xml(F.col("text"), style, side).alias("xml")
    )
    cell = paragraph_xml(F.col("text"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    cells = b.where(table).groupBy("document_id", "page", "run", "row", "col").agg(F.max_by(cell, "pos").alias("xml"), F.min(F.struct("pos", "rows", "cols")).alias("size"))
    grid = cells.groupBy("document_id", "page", "run").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("row", "col"), "xml"))).alias("cells"), F.min("size").alias("size"))
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    size = lambda c: F.col(f"size.{c}").cast("int")
    held = lambda r, c: F.coalesce(F.col("cells")[F.struct(r.alias("row"), c.alias("col"))], F.lit("<w:p/>"))
    row = lambda r: F.concat(F.lit("<w:tr>"), F.array_join(F.transform(numbers(size("cols")), lambda c: F.concat(F.lit("<w:tc>"), held(r, c), F.lit("</w:tc>"))), ""), F.lit("</w:tr>"))
    drawn = F.concat(F.lit('<w:tbl><w:tblPr><w:tblStyle w:val="TableGrid"/></w:tblPr>'), F.array_join(F.transform(numbers(size("rows")), row), ""), F.lit("</w:tbl>"))
    tables = grid.select("document_id", "page", F.lit(0).alias("last"), "run", drawn.alias("xml"))
    # The space before a page's footnotes, and the break behind every page but the last.
    notes = b.where("type = 'Footnote'").groupBy("document_id", "page").agg(F.lit("<w:p/>").alias("xml")).select("document_id", "page", F.lit(1).alias("last"), F.lit(-1).cast("long").alias("run"), "xml")
    pages = blocks.select("document_id", "page").distinct().withColumn("_next", F.lead("page").over(W.partitionBy("document_id").orderBy("page"))).where("_next is not null")
    breaks = pages.select("document_id", "page", F.lit(2).alias("last"), F.lit(0).cast("long").alias("run"), F.lit('<w:p><w:r><w:br w:type="page"/></w:r></w:p>').alias("xml"))
    pieces = single.unionByName(tables).unionByName(notes).unionByName(breaks)
    whole = pieces.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page", "last", "run", "xml"))).alias("p"))
    foot = b.where("type = 'Page-footer'").groupBy("document_id").agg(F.max_by(paragraph_xml(F.col("text"), F.lit("Footer"), F.lit(None).cast("string")), F.struct("page", "pos")).alias("footer"))
    docs = blocks.select("document_id").distinct().join(whole, "document_id", "left").join(foot, "document_id", "left")
    return packed(docs.select("document_id", F.coalesce(F.array_join(F.transform("p", lambda x: x["xml"]), ""), F.lit("")).alias("body"), "footer"))


def write_terms(terms: DataFrame, path: str) -> None:
    """A two-column terminology table, with a header, as CSV."""
    terms.select("term", "translation").write.mode("overwrite").option("header", "true").csv(path)
