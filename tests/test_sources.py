import io
import zipfile

import pytest
from pyspark.sql import functions as F

from babelmill.sources import exchange, writers

TMX = b"""<?xml version="1.0"?><tmx><body><tu><tuv xml:lang="en-US"><seg>Hello <b>you</b></seg></tuv><tuv xml:lang="fr"><seg>Bonjour</seg></tuv></tu>
<tu><tuv xml:lang="en"><seg> </seg></tuv><tuv xml:lang="fr"><seg>x</seg></tuv></tu></body></tmx>"""
TBX = b"""<martif><termEntry><langSet xml:lang="en"><tig><term>one</term></tig></langSet><langSet xml:lang="fr"><ntig><termGrp><term>un</term></termGrp></ntig></langSet></termEntry>
<termEntry><langSet xml:lang="en"><tig><term>one</term></tig></langSet><langSet xml:lang="fr"><tig><term>autre</term></tig></langSet></termEntry></martif>"""
XLIFF = b"""<xliff xmlns="urn:oasis:names:tc:xliff:document:1.2"><file><body><trans-unit id="a"><source>A b</source><seg-source><mrk mtype="seg" mid="1">A</mrk> <mrk mtype="seg" mid="2">b</mrk></seg-source></trans-unit>
<trans-unit id="c" translate="no"><source>C</source></trans-unit></body></file></xliff>"""


def docx():
    w = exchange.WORD[1:-1]
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>One. Two.</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
    return out.getvalue()


def held(spark, *contents):
    return spark.createDataFrame([(f"f{i}", bytearray(c)) for i, c in enumerate(contents)], "path string, content binary")


def test_tmx_and_tbx(spark):
    v = exchange.parsed(held(spark, TMX, b"<broken"), exchange.tmx_variants, exchange.TMX)
    assert v.where("error is not null").count() == 1
    assert [tuple(r)[1:] for r in exchange.pair_variants(v, "en", "fr").collect()] == [(0, "Hello you", "Bonjour")]
    t = exchange.parsed(held(spark, TBX), exchange.tbx_terms, exchange.TBX)
    assert [(r.source_term, r.target_term) for r in exchange.glossary_of(t, "en", "fr").collect()] == [("one", "un")]


def test_xliff_round_trip(spark):
    files = held(spark, XLIFF)
    s = exchange.parsed(files, exchange.xliff_segments, exchange.XLIFF)
    assert [(r.id, r.text, r.locked) for r in s.orderBy("pos").collect()] == [("1", "A", False), ("2", "b", False), ("c", "C", True)]
    t = spark.createDataFrame([("f0", "1", 0, "x"), ("f0", "1", 1, "y"), ("f0", "zz", 2, "z")], "path string, id string, pos int, text string")
    r = writers.fill_xliff(files, t).first()
    assert r.unmatched == ["zz"] and b'mid="1">y</' in bytes(r.content)
    assert bytes(r.content).startswith(XLIFF[: XLIFF.index(b">") + 1])
    named = b"<?xml version='1.0'?>\r\n<xliff xmlns='u:x'  version=\"1.2\"><file/></xliff>\n"
    assert writers.filled_xliff(named, {}) == (named.replace(b"<file/>", b"<file />"), [])


def test_docx(spark):
    files = held(spark, docx())
    b = exchange.docx_blocks(exchange.parsed(files, exchange.docx_paragraphs, exchange.DOCX))
    assert sorted((r.id, r.text) for r in b.collect()) == [("0_0", "One."), ("0_1", "Two."), ("1_0_0", "cell")]
    t = spark.createDataFrame([("f0", "0", 0, "Un."), ("f0", "0", 1, "Deux.")], "path string, id string, pos int, text string")
    filled = writers.fill_docx(files, t).select("path", "content")
    p = exchange.parsed(filled, exchange.docx_paragraphs, exchange.DOCX)
    assert [r.text for r in p.orderBy("element").collect()] == ["Un. Deux.", "cell"]


def test_text_and_events(spark):
    d = exchange.decoded(held(spark, "é".encode(), "é".encode("cp1256")))
    assert [r.text for r in d.collect()] == ["é", "é"]
    lines = spark.createDataFrame([('data: {"a": 1}',), ("data: {broken",), (": ping",)], "value string")
    assert exchange.sse_events(lines).select(F.to_json("payload").alias("j")).first().j == '{"a":1}'
    x = writers.new_xliff(spark.createDataFrame([("d", 1, "a<b", "c")], "document_id string, pos int, source_text string, target_text string"), "en", "fr").first().xml
    assert '<trans-unit id="seg_1"><source>a&lt;b</source>' in x
    assert exchange.parsed(held(spark, x.encode()), exchange.xliff_segments, exchange.XLIFF).first().text == "a<b"


def test_new_docx(spark):
    rows = [("d", 2, "نص", "Quote", "left"), ("d", 1, "a < b", None, None), ("d", 3, None, "Normal", "right")]
    made = writers.new_docx(spark.createDataFrame(rows, "document_id string, pos int, text string, style string, alignment string"))
    p = exchange.parsed(made, exchange.docx_paragraphs, exchange.DOCX)
    assert [(r.text, r.style) for r in p.orderBy("element").collect()] == [("a < b", None), ("نص", "Quote"), ("", "Normal")]
    with zipfile.ZipFile(io.BytesIO(bytes(made.first().content))) as z:
        xml = z.read("word/document.xml").decode()
    assert '<w:pStyle w:val="Quote"/><w:bidi/><w:jc w:val="right"/>' in xml and xml.count("<w:rtl/>") == 1


def test_docx_header_and_footer(spark):
    w = exchange.WORD[1:-1]
    said = lambda tag, text: f'<w:{tag} xmlns:w="{w}"><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:{tag}>'
    out = io.BytesIO(docx())
    with zipfile.ZipFile(out, "a") as z:
        z.writestr("word/header2.xml", said("hdr", "second")), z.writestr("word/header1.xml", said("hdr", "top")), z.writestr("word/footer1.xml", said("ftr", "end"))
    t = spark.createDataFrame([("f0", "header/0", 0, "oben"), ("f0", "0", 1, "Un."), ("f0", "footer/9", 2, "x")], "path string, id string, pos int, text string")
    filled = writers.fill_docx(held(spark, out.getvalue()), t)
    assert filled.first().unmatched == ["footer/9"]
    p = exchange.parsed(filled.select("path", "content"), exchange.docx_paragraphs, exchange.DOCX)
    assert sorted((r.part, r.text) for r in p.collect()) == [("body", "Un."), ("body", "cell"), ("footer", "end"), ("header", "oben")]


MERGED = """<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>wide</w:t></w:r></w:p></w:tc>
<w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>tall</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:tc></w:tr>
<w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc></w:tr>
<w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>both</w:t></w:r></w:p></w:tc><w:tc><w:tcPr><w:vMerge w:val="continue"/></w:tcPr><w:p/></w:tc></w:tr>
<w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/><w:vMerge/></w:tcPr><w:p><w:r><w:t>hidden</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>end</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"""
STYLES = """<w:styles xmlns:w="{w}"><w:style w:type="paragraph" w:styleId="Base"><w:pPr><w:jc w:val="right"/></w:pPr></w:style>
<w:style w:type="paragraph" w:styleId="Child"><w:basedOn w:val="Base"/></w:style><w:style w:type="paragraph" w:styleId="Loop"><w:basedOn w:val="Loop"/></w:style></w:styles>"""


def package(body, header="", styles=""):
    w = exchange.WORD[1:-1]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:bookmarkStart w:id="0"/>{body}<w:sectPr/></w:body></w:document>')
        if header:
            z.writestr("word/header1.xml", f'<w:hdr xmlns:w="{w}">{header}</w:hdr>')
        if styles:
            z.writestr("word/styles.xml", styles.replace("{w}", w))
    return out.getvalue()


def said(text, properties=""):
    return f"<w:p><w:pPr>{properties}</w:pPr><w:r><w:t>{text}</w:t></w:r><w:r><w:t/></w:r></w:p>"


def scanned(files):
    return exchange.docx_blocks(exchange.parsed(files, exchange.docx_paragraphs, exchange.DOCX))


def test_merged_cells_are_read_once(spark):
    b = scanned(held(spark, package(said("First.") + MERGED)))
    # The bookmark is element 0.
    assert sorted((r.id, r.text) for r in b.collect()) == [("1_0", "First."), ("2_0_0", "wide"), ("2_0_2", "tall\ntwo"), ("2_1_0", "a"), ("2_1_1", "b"), ("2_2_0", "both"), ("2_3_2", "end")]


def test_scan_translate_write_scan(spark):
    files = held(spark, package(said("One. Two. Three.") + MERGED + said("Kept."), said("Head one. Head two.")))
    ids = {r.id: r.text for r in scanned(files).collect()}
    assert {"1_0", "1_1", "1_2", "header/0_0", "header/0_1"} <= set(ids)
    new = {"1_1": "Deux.", "header/0_0": "Tete.", "2_0_2": "haut", "2_3_2": "fin", "9_9": "nowhere", "0_0": "no"}
    t = spark.createDataFrame([("f0", i, 0, x) for i, x in new.items()] + [("f0", "1_1", 1, "Encore.")], "path string, id string, pos int, text string")
    r = writers.fill_docx(files, t).first()
    assert r.unmatched == ["0_0", "9_9"]
    again = {r.id: r.text for r in scanned(held(spark, bytes(r.content))).collect()}
    assert [again[f"1_{i}"] for i in range(4)] == ["One.", "Deux.", "Encore.", "Three."]
    assert (again["header/0_0"], again["header/0_1"], again["2_0_2"], again["2_3_2"], again["3_0"]) == ("Tete.", "Head two.", "haut", "fin", "Kept.")


def test_arabic_runs_from_right_to_left(spark):
    sides = ["", '<w:jc w:val="left"/>', '<w:jc w:val="right"/>', '<w:jc w:val="center"/>', '<w:pStyle w:val="Child"/>', '<w:pStyle w:val="Loop"/>']
    files = held(spark, package("".join(said(f"Text {i}.", x) for i, x in enumerate(sides)) + said("Left alone."), styles=STYLES))
    t = spark.createDataFrame([("f0", f"{i + 1}_0", 0, "نص") for i in range(len(sides))] + [("f0", "7_0", 0, "Latin")], "path string, id string, pos int, text string")
    w = exchange.WORD
    root = exchange.ET.fromstring(zipfile.ZipFile(io.BytesIO(bytes(writers.fill_docx(files, t).first().content))).read("word/document.xml"))
    found = [(p.find(f"{w}pPr/{w}bidi") is not None, next((e.get(f"{w}val") for e in p.iter(f"{w}jc")), None), p.find(f"{w}r/{w}rPr/{w}rtl") is not None) for p in root.iter(f"{w}p")]
    assert found == [(True, x, True) for x in ("right", "right", "left", "center", "left", "right")] + [(False, None, False)]
    styled = root.findall(f".//{w}p")[4].find(f"{w}pPr")
    assert [exchange.name_of(e) for e in styled] == ["pStyle", "bidi", "jc"]


def test_assembled_docx(spark):
    rows = [
        ("d", 0, 0, "Title", "T & t", None, None, None, None, None, None), ("d", 0, 1, "Footnote", "note", None, None, None, None, None, None),
        ("d", 0, 2, "Text", "line\nbreak", None, None, None, None, None, None), ("d", 0, 3, "Table", "c00", None, 0, 0, 0, 2, 2), ("d", 0, 4, "Table", "c11", None, 0, 1, 1, 2, 2),
        ("d", 0, 5, "Table", "x", None, 1, 0, 0, 1, 1), ("d", 0, 6, "Table", "y", None, 1, 0, 0, 1, 1), ("d", 0, 7, "Text", " ", None, None, None, None, None, None),
        ("d", 1, 0, "Page-footer", "old foot", None, None, None, None, None, None), ("d", 1, 1, "Section-header", "نص", None, None, None, None, None, None),
        ("d", 2, 0, "List-item", "item", "Own", None, None, None, None, None), ("d", 2, 1, "Page-footer", "foot", None, None, None, None, None, None), ("e", 0, 0, "Text", "", None, None, None, None, None, None),
    ]
    blocks = spark.createDataFrame(rows, "document_id string, page int, pos int, type string, text string, style string, num int, row int, col int, rows int, cols int").repartition(3)
    made = {r.path: bytes(r.content) for r in writers.assembled_docx(blocks).collect()}
    found = {r.id: (r.text, r.style) for r in scanned(held(spark, made["d"])).collect()}
    assert found == {
        "0_0": ("T & t", "Title"), "1_0": ("line break", None), "2_0_0": ("c00", "Table"), "2_1_1": ("c11", "Table"), "3_0_0": ("y", "Table"), "5_0": ("note", "Footnote"),
        "7_0": ("نص", "Heading1"), "9_0": ("item", "Own"), "footer/0_0": ("foot", "Footer"),
    }
    xml = zipfile.ZipFile(io.BytesIO(made["d"])).read("word/document.xml").decode()
    assert xml.count('w:type="page"') == 2 and '<w:bidi/><w:jc w:val="right"/>' in xml
    assert scanned(held(spark, made["e"])).collect() == []


def test_terms_as_a_workbook(spark, tmp_path):
    terms = spark.createDataFrame([("a, b", 'say "x"'), ("é", "نص")], "term string, translation string")
    writers.write_terms(terms, str(tmp_path / "terms"))
    assert sorted(tuple(r) for r in spark.read.option("header", "true").option("escape", "\\").csv(str(tmp_path / "terms")).collect()) == [("a, b", 'say "x"'), ("é", "نص")]


def test_a_large_term_base_is_read_concept_by_concept():
    """Elements of concepts that are done are let go: the memory doesn't grow with the file. Errors come before any row."""
    import tracemalloc

    entry = '<termEntry><langSet xml:lang="en"><tig><term>t</term></tig></langSet><langSet xml:lang="fr"><tig><term>u</term></tig></langSet></termEntry>'
    made = lambda n: f"<martif><text><body>{entry * n}</body></text></martif>".encode()
    peaks = []
    for n in (1000, 20000):
        content = made(n)
        tracemalloc.start()
        last = [r for i, r in enumerate(exchange.tbx_rows(content)) if i == 2 * n - 1]
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert last == [(n - 1, 1, 0, "fr", "u")]
    assert peaks[1] < 3 * peaks[0] + (1 << 20)
    nested = b"<a><termEntry><termEntry><langSet lang='x'><tig><term>i</term></tig></langSet></termEntry><langSet lang='y'><tig><term>o</term></tig></langSet></termEntry></a>"
    assert exchange.tbx_terms(nested) == [(0, 0, 0, "y", "o"), (1, 0, 0, "x", "i")]
    for broken in (made(10)[:-9], made(2).replace(b">u<", b">&none;<", 1), b""):
        with pytest.raises(exchange.ET.ParseError):
            next(exchange.tbx_rows(broken))


def test_files_are_handed_on_in_small_batches():
    """A task gathers neither many files nor many bytes before it hands them on."""
    schema = writers.pa.schema([("path", writers.pa.string()), ("content", writers.pa.binary())])
    sizes = [b.num_rows for b in writers.handed_on(((str(i), b"x") for i in range(1000)), schema, 1)]
    assert sum(sizes) == 1000 and max(sizes) == exchange.FILES
    assert [b.num_rows for b in writers.handed_on(((str(i), bytes(exchange.BYTES)) for i in range(3)), schema, 1)] == [1, 1, 1]


def test_fill_docx_deals_rows_by_file_only(spark):
    """Sentences and translations meet within a file: they are dealt by path once, not again by every key. Rows without path, id or text, files without translations and files that come twice count as ever."""
    docs = {f"f{i}": [[f"S{i} {p} {k}." for k in range(1 + (i + p) % 4)] for p in range(1 + i % 7 * 3)] for i in range(40)}
    files = [(path, bytearray(package("".join(said(" ".join(s)) for s in paragraphs)))) for path, paragraphs in docs.items()]
    files += [("twice", bytearray(docx())), ("twice", bytearray(docx())), (None, bytearray(docx()))]
    new = [(f"f{i}", f"{p + 1}_{k}", at, f"T{i} {p} {k} {at}") for i in range(0, 40, 3) for p in range(1 + i % 7 * 3) for k in range(0, 1 + (i + p) % 4, 2) for at in (1, 0)]
    new += [("f3", "2", 0, "All of it."), ("f3", "99", 0, "x"), ("f4", "1_9", 0, "x"), ("f5", None, 0, "x"), (None, "1_0", 0, "x"), ("f1", "1_0", 0, None), ("twice", "1_0_0", 0, "new"), ("nowhere", "1", 0, "x")]
    f = spark.createDataFrame(files, "path string, content binary").repartition(3)
    t = spark.createDataFrame(new, "path string, id string, pos int, text string").repartition(5)
    wanted = {}
    for path, paragraphs in docs.items():
        of = lambda i: [x for _, x in sorted((at, x) for p, k, at, x in new if (p, k) == (path, i))]  # noqa: B023, E731
        wanted[path] = {str(p + 1): " ".join(of(str(p + 1)) or [" ".join(filter(None, of(f"{p + 1}_{k}"))) if of(f"{p + 1}_{k}") else x for k, x in enumerate(s)]) for p, s in enumerate(paragraphs)}
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        filled = writers.fill_docx(f, t)
        rows = filled.collect()
        plan = filled._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = {r.path: r for r in rows if r.path in docs}
    # Without sentences left as they were, a paragraph's text is not cut in the file.
    assert {k: {str(e): x for _, e, _, _, x, *_ in exchange.docx_paragraphs(bytes(r.content))} for k, r in got.items()} == {k: {p: " ".join(x.split()) for p, x in v.items()} for k, v in wanted.items()}
    assert {k: r.unmatched for k, r in got.items() if r.unmatched} == {"f3": ["99"], "f4": ["1_9"]} and len(rows) == len(files)
    others = [(r.path, [x[4] for x in exchange.docx_paragraphs(bytes(r.content))]) for r in rows if r.path not in docs]
    assert sorted(others, key=str) == [("twice", ["One. Two.", "new"])] * 2 + [(None, ["One. Two.", "cell"])]
    assert set(exchange.re.findall(r"hashpartitioning\((.*?), \d+\)", exchange.re.sub(r"#\d+L?", "", plan))) == {"path", "path, id"}
