"""Language of a text: naive Bayes over character trigrams, trained by Spark on a table of texts with their language.

A model is one row a language and class of trigrams, so its size is bounded by LANGUAGES * CLASSES whatever the corpus; counts are
added up in each task before they are shuffled. All of a text counts. A class is (961 a + 31 b + c) modulo CLASSES for the
code points a, b, c, with A-Z in lower case, so SQL can name it too.

Defined cases: a text of fewer than three characters, or none, has no language; texts without a language are not learned
from; equal scores go to the first code; of more than LANGUAGES languages the ones with most trigrams are kept (then by code).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSES, LANGUAGES = 4096, 256
#: Characters that are classed at once.
PIECE = 1 << 20


def trigram_classes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Text and class of every trigram of some texts."""
    lengths = np.array([len(t or "") for t in texts], np.int64)
    codes = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = codes + 32 * ((codes >= 65) & (codes <= 90))
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(texts)), lengths)
    inside = text[:-2] == text[2:]
    classes = (961 * codes[:-2] + 31 * codes[1:-1] + codes[2:]) % CLASSES
    return text[:-2][inside], classes[inside]


def pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str | None]]]:
    """First row and texts of runs of about PIECE characters; a longer text is a run of its own."""
    texts, first = batch.column("text").to_pylist(), 0
    while first < len(texts):
        stop, size = first, 0
        while stop < len(texts) and (stop == first or size + len(texts[stop] or "") <= PIECE):
            size += len(texts[stop] or "")
            stop += 1
        yield first, texts[first:stop]
        first = stop


def trained(texts: DataFrame) -> DataFrame:
    """lang, class, n: the model of texts(text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, held in pieces(batch):
                text, classes = trigram_classes(held)
                for lang in set(langs[first : first + len(held)]):
                    mine = np.array([x == lang for x in langs[first : first + len(held)]])[text]
                    total[lang] = total.get(lang, 0) + np.bincount(classes[mine], minlength=CLASSES)
        for lang, counts in total.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(counts[some])], ["lang", "class", "n"])

    known = texts.where("lang is not null and text is not null").select("lang", "text")
    counts = known.mapInArrow(count, "lang string, class long, n long").groupBy("lang", "class").agg(F.sum("n").alias("n"))
    most = counts.groupBy("lang").agg(F.sum("n").alias("_all")).orderBy(F.desc("_all"), "lang").limit(LANGUAGES)
    return counts.join(F.broadcast(most.select("lang")), "lang")


def detected(texts: DataFrame, model: DataFrame) -> DataFrame:
    """texts with a column `detected`: the language under which all of a text's trigrams are most likely."""
    rows = model.collect()  # bounded: LANGUAGES * CLASSES
    codes = sorted({r["lang"] for r in rows})
    counts = np.zeros((CLASSES, len(codes)))
    for r in rows:
        counts[r["class"], codes.index(r["lang"])] = r["n"]
    weights = np.log((counts + 1) / (counts.sum(axis=0) + CLASSES))

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str | None] = []
            for _, held in pieces(batch):
                text, classes = trigram_classes(held)
                bags, n = np.unique(text * CLASSES + classes, return_counts=True)
                score = np.zeros((len(held), len(codes)))
                np.add.at(score, bags // CLASSES, n[:, None] * weights[bags % CLASSES])
                some = np.bincount(text, minlength=len(held)) > 0
                out += [codes[i] if has and codes else None for i, has in zip(score.argmax(axis=1).tolist() if codes else [0] * len(held), some.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "detected"])

    schema = texts.withColumn("detected", F.lit(None).cast("string")).schema
    return texts.mapInArrow(detect, schema)
