"""The secret scan on the tables: planted values are found, ordinary words are not, also in documents it never learned from."""

import re

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from babelmill.llm import secrets

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scanned(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    return texts, secrets.op10_secret_scan(spark, SF).collect()


def test_planted_values_and_nothing_else(scanned):
    texts, rows = scanned
    planted = {(i, m.start(1)) for i, t in texts.items() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t or "")}
    found = {(r.doc_id, r.start) for r in rows if r.is_secret and r.length == 40}
    others = {r.doc_id for r in rows if r.is_secret} - {i for i, _ in planted}
    assert len(planted) >= 10 and planted <= found
    assert len(others) <= len(texts) // 100


def test_held_out_findings(spark, scanned):
    """Labelled findings of documents that the sample leaves out: precision and recall."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.col("source").alias("path"))
    steps, words = secrets.transitions(docs), secrets.lexicon(docs)
    told = secrets.labelled(secrets.candidates(docs, steps, words)).where(secrets.is_held_out(F.col("doc_id")))
    label = {(r.doc_id, r.digest): r.label for r in told.collect()}
    got = {(r.doc_id, r.digest): r.is_secret for r in scanned[1]}
    secret, called = {k for k, v in label.items() if v}, {k for k in label if got[k]}
    assert secret and len(label) > 200
    assert len(secret & called) >= 0.95 * len(secret) and len(secret & called) >= 0.95 * len(called)


def test_sample_is_bounded_and_distinct(spark):
    held = [0.0] * len(secrets.FEATURES)
    told = spark.createDataFrame([(i, f"d{i % 50}", float(i % 2), held) for i in range(600)], "doc_id long, digest string, label double, features array<double>")
    rows = secrets.sampled(told, 10).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in rows} == {0.0: 10, 1.0: 10}
    assert secrets.sampled(told).count() == 50
    assert secrets.sampled(told.where("false")).count() == 0


def test_sample_does_not_depend_on_copies_or_partitions(spark):
    """The first findings by hash, also where one finding is repeated very often, so that the bound has to be raised."""
    row = lambda i, digest: (i, digest, 1.0, [float(len(digest) + i % 1)] * len(secrets.FEATURES))
    rows = [row(i, f"d{i}") for i in range(40)] + [row(i, "again") for i in range(4000)]
    made = lambda held, n: spark.createDataFrame(held, "doc_id long, digest string, label double, features array<double>").repartition(n)
    taken = lambda df: sorted(map(str, secrets.sampled(df, 12).collect()))
    assert taken(made(rows, 5)) == taken(made(rows[::-1], 2)) and len(taken(made(rows, 3))) == 12


def test_dictionary_is_counted_from_all_texts(spark):
    d = spark.createDataFrame([("Alpha beta gamma x1alpha alpha",), ("beta BETA delta",), (None,), ("",)], "text string").repartition(3)
    words = secrets.lexicon(d, 2)
    assert {"alpha", "beta"} <= words and not words & {"gamma", "delta", "x1alpha"}
    assert secrets.covered("xalphabetax", words) == 9 and secrets.covered("", words) == 0
    assert secrets.lexicon(d.where("false")) == frozenset(secrets.DICTIONARY)


def test_forest_is_the_mean_of_its_trees(spark):
    """The vote, walked tree by tree over the rules that Spark prints."""
    steps = np.zeros((256, 256), np.float32)
    model = secrets.train(secrets.findings(spark, steps, 300))
    held = [secrets.features(e[1], e[0], e[2], e[3], steps) for e in map(secrets.example, range(9000, 9020))]

    def walk(lines, at, depth, x):
        while True:
            line = lines[at].strip()
            if line.startswith("Predict"):
                return float(line.split()[1])
            m = re.match(r"If \(feature (\d+) <= (.*)\)", line)
            if x[int(m[1])] <= float(m[2]):
                at, depth = at + 1, depth + 1
                continue
            indent = len(lines[at]) - len(lines[at].lstrip())
            at += 1
            while not (lines[at].strip().startswith("Else") and len(lines[at]) - len(lines[at].lstrip()) == indent):
                at += 1
            at += 1

    df = spark.createDataFrame([(i, x) for i, x in enumerate(held)], "i long, features array<double>").withColumn("v", array_to_vector("features"))
    got = {r.i: r.prediction for r in model.transform(df).collect()}
    for i, x in enumerate(held):
        votes = [walk(t.toDebugString.splitlines()[1:], 0, 0, x) for t in model.trees]
        means = np.mean([t.predictProbability(Vectors.dense(x)).toArray()[1] for t in model.trees])
        assert got[i] == float(means > 0.5) and (np.mean(votes) > 0.5) == (got[i] == 1.0) or abs(means - 0.5) < 0.1
