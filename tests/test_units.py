"""Files read in byte ranges give the rows of files read whole, whatever the ranges."""

import pytest

from babelmill.sources import exchange, units

UNIT = '<tu tuid="{i}"><tuv xml:lang="en-US"><seg>Hello <b>{i}</b> &amp; é{i}</seg></tuv><tuv xml:lang="fr"><seg>Bonjour {i}</seg></tuv><note>{pad}</note></tu>\n'
HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<tmx version="1.4" xmlns:x="u:x"><header note="a &lt;tu&gt; b"/><body>'


def tmx(n, change=lambda i, s: s):
    return HEAD + "".join(change(i, UNIT.format(i=i, pad="p" * (i * 7 % 50))) for i in range(n)) + "</body></tmx>\n"


FILES = {
    "plain.tmx": tmx(60).encode(),
    "one.tmx": tmx(1).encode(),
    "none.tmx": tmx(0).encode(),
    "prefix.tmx": tmx(20, lambda i, s: s.replace("<note>", f'<x:y x:z="1">{i}</x:y><note>')).encode(),
    "blank units.tmx": tmx(30, lambda i, s: s if i % 3 else "<tu/>\n<tu></tu >").encode(),
    "comment.tmx": tmx(12, lambda i, s: s + ("<!-- </tu> -->" if i == 5 else "")).encode(),
    "cdata.tmx": tmx(12, lambda i, s: s.replace("Bonjour", "<![CDATA[a </tu> b]]>") if i == 3 else s).encode(),
    "entity.tmx": tmx(9, lambda i, s: s.replace("Bonjour", "&own;") if i == 4 else s).replace("<tmx", '<!DOCTYPE tmx [<!ENTITY own "mine">]><tmx').encode(),
    "latin.tmx": tmx(9).replace("UTF-8", "iso-8859-1").encode("iso-8859-1"),
    "wide.tmx": tmx(5).replace("UTF-8", "UTF-16").encode("utf-16"),
    "broken.tmx": tmx(40)[:-30].encode(),
    "damaged.tmx": tmx(40, lambda i, s: s.replace("</seg>", "", 1) if i == 20 else s).encode(),
    "unclosed.tmx": tmx(10).replace("</body>", "").encode(),
    "empty.tmx": b"",
    "mark.tmx": b"\xef\xbb\xbf" + tmx(8).encode(),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("files")
    for name, content in FILES.items():
        (path / name).write_bytes(content)
    return path


def rows(df):
    key = lambda x: tuple(str(v) for v in x)
    return sorted(((r.path.rpartition("/")[2].replace("%20", " "), *[r[c] for c in df.columns if c not in ("path", "error")], (r.error or "").partition(":")[0]) for r in df.collect()), key=key)


@pytest.mark.parametrize("size", [150, 1 << 20])
def test_tmx_in_ranges(spark, folder, size):
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size)), spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = rows(units.read_units(spark, str(folder), "*.tmx", units.TMX))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept[0]), spark.conf.set("spark.sql.files.openCostInBytes", kept[1])
    want = rows(exchange.parsed(exchange.files(spark, str(folder), "*.tmx"), exchange.tmx_variants, exchange.TMX))
    # An empty file has no range, so nothing tells of it.
    assert got == [r for r in want if r[0] != "empty.tmx"]
    assert sum(r[0] == "plain.tmx" for r in got) == 120 and sum(r[0] == "damaged.tmx" for r in got) == 1


def test_many_tasks_read_one_file(spark, tmp_path):
    (tmp_path / "large.tmx").write_bytes(tmx(4000).encode())
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        text = spark.read.option("lineSep", "</tu>").text(str(tmp_path))
        assert text.rdd.getNumPartitions() >= 8
        got = units.read_units(spark, str(tmp_path), "*.tmx", units.TMX)
        pairs = exchange.pair_variants(got, "en", "fr").orderBy("position").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert [(p.position, p.source_text, p.target_text) for p in pairs] == [(i, f"Hello {i} & é{i}", f"Bonjour {i}") for i in range(4000)]


def test_tbx_and_xliff_in_ranges(spark, tmp_path):
    term = '<{t}><langSet xml:lang="en"><tig><term>one {i}</term></tig></langSet><langSet xml:lang="fr"><tig><term>un {i}</term></tig></langSet></{t}>'
    for t in ("termEntry", "conceptEntry"):
        (tmp_path / f"{t}.tbx").write_text("<martif><text><body>" + "".join(term.format(t=t, i=i) for i in range(40)) + "</body></text></martif>")
    unit = '<trans-unit id="u{i}"{no}><source>A{i} b</source><seg-source><mrk mtype="seg" mid="{i}.1">A{i}</mrk> <mrk mtype="seg" mid="{i}.2">b</mrk></seg-source></trans-unit><trans-unit id="v{i}"><source> </source></trans-unit>'
    (tmp_path / "a.xliff").write_text('<xliff xmlns="urn:oasis:names:tc:xliff:document:1.2" xmlns:m="u:m"><file><body>' + "".join(unit.format(i=i, no=' translate="no" m:conf="1"' if i % 4 == 0 else "") for i in range(40)) + "</body></file></xliff>")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300"), spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for glob, kind in (("termEntry.tbx", units.TBX), ("conceptEntry.tbx", units.TBX_CONCEPTS), ("*.tbx", units.TBX), ("*.xliff", units.XLIFF)):
            want = rows(exchange.parsed(exchange.files(spark, str(tmp_path), glob), kind.parser, kind.schema))
            assert rows(units.read_units(spark, str(tmp_path), glob, kind)) == want and len(want) >= 80
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept[0]), spark.conf.set("spark.sql.files.openCostInBytes", kept[1])
