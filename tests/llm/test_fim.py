"""Fill-in-middle against a plain version, on texts with the awkward cases."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from babelmill.llm import fim

TEXTS = [
    None, "", "one line", "a\nb\nc", "a\nb\nc\n", "\n\n\n", "é中\r\n  x\x85y\n\x00z", "has <P> inside\nand more", "ends with <\nS>\n<", "<", "<P\n>\n<S\n",
    "\n".join(f"line {i} of many" for i in range(3000)), "word " * 5000, "x\n" * 40 + "tail",
]


def plain(doc_id, text, seed=7, rate=100, spm_share=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm_share:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("block", "rate"), [(1 << 18, 100), (7, 100), (64, 50)])
def test_transform_and_restore(spark, monkeypatch, block, rate):
    monkeypatch.setattr(fim, "BLOCK", block)
    rows = [(i, t, "kept") for i in range(0, 60 * len(TEXTS), len(TEXTS)) for i, t in enumerate(TEXTS, i)] if block > 7 else [(i, t, "kept") for i, t in enumerate(TEXTS)]
    rows += [rows[3], rows[3], (None, "no id\nat all\n", "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fim string").repartition(3)
    out = fim.transform(docs, rate=rate).withColumn("back", fim.restore(F.col("fim_.output"), F.col("fim_.form")))
    got = out.collect()
    assert len(got) == len(rows) and {r.fim for r in got} == {"kept"}
    for r in got:
        assert tuple(r.fim_) == plain(r.doc_id, r.text, rate=rate), r.doc_id
        assert r.back == (r.text or "")
    forms = {r.fim_.form for r in got}
    assert forms == {"plain", "psm", "spm"}


def test_blocks_add_no_boundary(monkeypatch):
    split = Split(Regex(fim.UNITS), behavior="isolated")
    whole = [fim.boundaries(t or "", split).tolist() for t in TEXTS]
    for size in (1, 2, 3, 50):
        monkeypatch.setattr(fim, "BLOCK", size)
        assert [fim.boundaries(t or "", split).tolist() for t in TEXTS if len(t or "") < 1000] == [w for w, t in zip(whole, TEXTS, strict=True) if len(t or "") < 1000]


def test_empty_table(spark):
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).collect() == []
