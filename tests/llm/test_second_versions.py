"""Learned lists and computed places against second, plain computations; the pipeline's stages on awkward tables."""

import math
import random
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from babelmill.llm import quality, sharding
from babelmill.llm.common import domain_bits, feistel

SF = "/root/testdata/sf0.001"


def spark_hash(*values):
    """Spark's xxhash64 of a long and then ints: each value's hash is the seed of the next one."""
    out = 42
    for i, v in enumerate(values):
        out = xxhash.xxh64(struct.pack("<q" if i == 0 else "<i", v), seed=out).intdigest()
    return out


def plain_feistel(value, n, bits, seed, rounds=6):
    right = bits // 2
    left = bits - right

    def permuted(v):
        for r in range(rounds):
            high, low = v >> right, v & ((1 << right) - 1)
            if r % 2:
                low ^= spark_hash(high, seed, r) & ((1 << right) - 1)
            else:
                high ^= spark_hash(low, seed, r) & ((1 << left) - 1)
            v = high << right | low
        return v

    v = permuted(value)
    while v >= n:
        v = permuted(v)
    return v


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000])
def test_places_are_the_plain_network(spark, n):
    got = spark.range(n).select("id", feistel(F.col("id"), n, domain_bits(n), 20).alias("p")).collect()
    assert {r.id: r.p for r in got} == {i: plain_feistel(i, n, domain_bits(n), 20) for i in range(n)}


def test_shards_and_slots_are_computable(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    runs, total = sharding.numbered(docs.select(sharding.row_key(docs).alias("key"), "doc_id"), ["key", "doc_id"])
    want = {}
    for r in runs.collect():
        for i in range(r.n_rows):
            p = plain_feistel(r.first_row + i, total, domain_bits(total), 20)
            want.setdefault(r.doc_id, []).append((p % 24, p // 24))
    got = {}
    for r in sharding.places(docs, 24).collect():
        got.setdefault(r.doc_id, []).append((r.shard, r.slot))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def plain_list(rows, cuts):
    """Sequential covering over rows {feature: value, bad, grow}: (feature, above, cut) by rule, cuts as they are."""
    holds = lambda c, r: r[c[0]] > c[2] if c[1] else r[c[0]] <= c[2]
    left, rules = rows, []
    while len(rules) < quality.RULES:
        rule, reach = [], [r for r in left if r["grow"]]
        while len(rule) < quality.CONDITIONS:
            p, n = sum(r["bad"] for r in reach), sum(not r["bad"] for r in reach)
            best, chosen = 1e-9, None
            if p and n:
                for f in quality.FEATURES:
                    for cut in cuts[f]:
                        for above in (True, False):
                            held = [r["bad"] for r in reach if holds((f, above, cut), r)]
                            pp = sum(held)
                            if pp and (gain := pp * (math.log2(pp / len(held)) - math.log2(p / (p + n)))) > best:
                                best, chosen = gain, (f, above, cut)
            if chosen is None:
                break
            rule.append(chosen)
            reach = [r for r in reach if holds(chosen, r)]
            if all(r["bad"] for r in reach):
                break
        if not rule:
            break
        scores = []
        for k in range(len(rule)):
            held = [r["bad"] for r in left if not r["grow"] and all(holds(c, r) for c in rule[: k + 1])]
            p = sum(held)
            scores.append(((2 * p - len(held)) / max(1, len(held)), -k, p, len(held)))
        _, k, p, n = max(scores)
        if p < quality.LEAST_FOUND or p < quality.PRECISION * n:
            break
        rules.append(rule[: 1 - k])
        left = [r for r in left if not all(holds(c, r) for c in rules[-1])]
    return rules


@pytest.mark.parametrize("seed", [1, 2])
def test_lists_of_several_rules_and_conditions(spark, seed):
    r = random.Random(seed)
    a, b, c, d = quality.FEATURES[:4]
    rows = []
    for i in range(1500):
        x = {f: r.randrange(20) / 20 for f in quality.FEATURES}  # few levels, so that cuts hit them all
        bad = (x[a] > 0.7 and x[b] > 0.6) or (x[c] <= 0.25 and x[d] > 0.5)
        rows.append((i, bad, *[float(x[f]) for f in quality.FEATURES]))
    schema = "doc_id long, bad boolean, " + ", ".join(f"{f} double" for f in quality.FEATURES)
    labelled = spark.createDataFrame(rows, schema).repartition(3)
    made = quality.learn(labelled)
    cut_rows = labelled.select(*[F.percentile_approx(f, [i / quality.CUTS for i in range(1, quality.CUTS)], 1000).alias(f) for f in quality.FEATURES]).first()
    cuts = {f: sorted(set(cut_rows[f])) for f in quality.FEATURES}
    grown = {x.doc_id: x.g for x in labelled.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(3)) < 2).alias("g")).collect()}
    plain = plain_list([dict(zip(quality.FEATURES, x[2:], strict=True)) | {"bad": x[1], "grow": grown[x[0]]} for x in rows], cuts)
    assert len(plain) >= 2 and sum(len(x) >= 2 for x in plain) >= 2
    # Cuts are then moved to the middle of the gap above them.
    values = {f: sorted({x[2 + i] for x in rows}) for i, f in enumerate(quality.FEATURES)}
    middle = lambda f, cut: next(((cut + v) / 2 for v in values[f] if v > cut), cut)
    assert [[(y.feature, y.above, y.cut) for y in rule] for rule in made] == [[(f, up, middle(f, cut)) for f, up, cut in rule] for rule in plain]
    # The ordered conditional: the number of the first rule that holds.
    holds = lambda rule, x: all((x[y.feature] > y.cut) == y.above for y in rule)
    for x in labelled.withColumn("_rule", quality.decision_list(made)).collect():
        assert x["_rule"] == next((k for k, rule in enumerate(made, 1) if holds(rule, x)), None)


def test_equal_gains_keep_the_first_condition(spark):
    """Two features with the same values: the first one is chosen, at every run."""
    f, g = quality.FEATURES[:2]
    rows = [(i, i % 4 == 0, *[1.0 if (i % 4 == 0 and x in (f, g)) else 0.0 for x in quality.FEATURES]) for i in range(400)]
    schema = "doc_id long, bad boolean, " + ", ".join(f"{x} double" for x in quality.FEATURES)
    made = [quality.learn(spark.createDataFrame(rows, schema).repartition(n)) for n in (1, 5)]
    assert made[0] == made[1] and [c.feature for rule in made[0] for c in rule] == [f]


DOCS = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_awkward_tables(spark, name, stage):
    """Empty tables, tables of null and blank texts and ids, ties and rows repeated as they are."""
    long = " ".join(f"word{i}" for i in range(5000))
    good = [f"this is the text number {i} of a few ordinary words that say {i * 7} things about it and no more" for i in range(6)]
    clean = [(i, t, "en", "a", len(t)) for i, t in enumerate(good)]
    odd = [(None, None, None, None, None), (7, None, "en", None, 0), (8, "", "en", "b", 0), (9, " \n\t", None, "b", 3)]
    rows = clean + [clean[0]] * 3 + [(0, good[1], "en", "b", 1), (None, good[2], "en", "a", 2), (11, long, "en", "b", 9)] + odd + [odd[0]] * 2
    for held in ([], [odd[0]] * 2, odd, rows):
        docs = spark.createDataFrame(held, DOCS).repartition(3)
        out = stage(spark, docs, SF)
        got = out.collect()
        if name != "sharding":
            assert out.columns == docs.columns
        before = [tuple(r) for r in docs.collect()]
        if name == "sharding":
            assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, before))
        elif name == "quality_rules":
            assert {r.text for r in got} <= {*good, long} and all(before.count(tuple(r)) for r in got)
            assert len(got) == sum(t in (*good, long) for _, t, *_ in held)
        elif name == "near_dedup":
            texts = [r.text for r in got if r.text and r.text.strip()]
            assert len(texts) == len(set(texts)) and set(texts) == {t for _, t, *_ in held if t and t.strip()}
        elif name == "decontamination":
            assert sorted(map(str, map(tuple, got))) == sorted(map(str, before))
        else:
            assert {r.doc_id for r in got} <= {r[0] for r in before}
