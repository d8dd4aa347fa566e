"""Operator 6, quality rules [native]: learned decision lists.

Text statistics are SQL expressions over each whole text. Rules are learned from labelled statistics by sequential
covering: a rule is grown on two thirds of the labelled rows, one threshold condition at a time by FOIL gain, and
pruned on the other third to the prefix with the best (p - n) / (p + n); rows it covers are left out, and the next
rule is grown, until a rule is not precise enough. Counting is done by Spark, in one aggregation a step over bucketed
statistics; only counts by (feature, bucket, label) come to the driver. The list is emitted as one ordered conditional
expression: the first rule that holds rejects a document, no rule keeps it.

Defined cases: null text has no words and fails the base rule, as do texts of fewer than 10 words; labels without a
quality, or for documents that are not there, are left out; a document labelled twice counts twice; without labels, or
if no rule is precise, only the base rule rejects; an empty table gives an empty result; repeated rows are judged one
by one; a very long text is measured whole; of conditions with equal gain the first in the order of FEATURES and cuts
is taken; other columns are ignored, and kept by `accepted`.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from babelmill.llm.common import SPACE_WORD, stored, table, whole_row

WINDOW = 5
#: Characters counted in words, by the name of their count.
KINDS = {"n_symbols": "#*$%&|<>", "_upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "_digit": "0123456789", "_mark": "!?.,;:"}
#: Cut points a feature, conditions a rule, rules, and what a rule must reach on the pruning rows.
CUTS, CONDITIONS, RULES, PRECISION, LEAST_FOUND = 24, 4, 16, 0.95, 3
#: Labelled rows, about, that `learned` fits rules on: a sample by a hash of doc_id where there are more.
LABELLED = 1 << 15
FEATURES = ("n_words", "word_length", "symbol_share", "line_share", "repeat_share", "distinct_share", "upper_share", "digit_share", "mark_share")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more in `words`."""
    none = F.lit(0).cast("long")
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def covered(at: Column) -> Column:
        start = F.struct(none.alias("n"), F.lit(0).alias("end"))
        step = lambda s, i: F.struct(
            (s["n"] + WINDOW - F.greatest(F.lit(0), s["end"] - i)).cast("long").alias("n"), (i + WINDOW).alias("end")
        )
        return F.aggregate(at, start, step, lambda s: s["n"])

    def again(s: Column) -> Column:
        same = lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])
        return covered(F.array_sort(F.transform(F.filter(s, lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x["i"])))

    def count(g: Column) -> Column:
        ordered = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), none).otherwise(let(ordered, again))

    return F.when(F.size(words) <= WINDOW, none).otherwise(let(windows, count))


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def text_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the features need."""
    t = F.col("_t")
    d = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    from_words = let(
        F.regexp_extract_all(t, F.lit(SPACE_WORD), F.lit(0)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), repeated_words(w).alias("n_repeat_words"),
            F.array_join(w, "").alias("chars"),
        ),
    )
    from_lines = let(
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(SPACE_WORD)),
        lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.size(x).cast("long").alias("n_lines")),
    )
    # Counted characters are no small letters: these go first, so that the passes for each kind read little.
    counted = let(
        without(F.col("_w.chars"), "abcdefghijklmnopqrstuvwxyz"),
        lambda x: F.struct(*[(F.length(x) - F.length(without(x, kind))).alias(name) for name, kind in KINDS.items()]),
    )
    d = d.select(*keep, from_words.alias("_w"), from_lines.alias("_l"))
    d = d.select(*keep, "_w", "_l", counted.alias("_c"))
    return d.select(
        *keep, "_w.n_words", F.length("_w.chars").cast("long").alias("word_chars"), F.col("_c.n_symbols").cast("long").alias("n_symbols"),
        "_l.n_dup_lines", "_w.n_repeat_words", "_w.n_distinct", "_l.n_lines", "_c._upper", "_c._digit", "_c._mark",
    )


def with_features(stats: DataFrame) -> DataFrame:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    made = {
        "word_length": F.col("word_chars") / words, "symbol_share": F.col("n_symbols") / chars,
        "line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "repeat_share": F.col("n_repeat_words") / words,
        "distinct_share": F.col("n_distinct") / words, "upper_share": F.col("_upper") / chars, "digit_share": F.col("_digit") / chars,
        "mark_share": F.col("_mark") / chars,
    }
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return stats.withColumns(made).withColumn("base_failed", failed)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float
    bucket: int

    def column(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut

    def bucketed(self) -> Column:
        b = F.col(f"_b_{self.feature}")
        return b > self.bucket if self.above else b <= self.bucket

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = list[Condition]


def every(columns: list[Column]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out


def learn(labelled: DataFrame, seed: int = 6) -> list[Rule]:
    """Rules from rows of FEATURES with `bad` (boolean) and `doc_id`."""
    cut_rows = labelled.select(*[F.percentile_approx(f, [i / CUTS for i in range(1, CUTS)], 1000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted({float(x) for x in cut_rows[f] or []}) for f in FEATURES}
    bucket = lambda f: sum((F.when(F.col(f) > c, 1).otherwise(0) for c in cuts[f]), F.lit(0))
    grown = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(3)) < 2
    rows = stored(labelled.select("bad", grown.alias("_grow"), *FEATURES, *[bucket(f).cast("int").alias(f"_b_{f}") for f in FEATURES]), "quality-labelled")
    rules: list[Rule] = []
    covered = F.lit(False)
    for _ in range(RULES):
        left = rows.where(~covered)
        rule: Rule = []
        while len(rule) < CONDITIONS:
            at = every([c.bucketed() for c in rule])
            cells = left.where(F.col("_grow") & at).select(
                "bad", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"_b_{f}").alias("b")) for f in FEATURES])).alias("x")
            )
            counts = cells.groupBy("x.f", "x.b", "bad").count().collect()  # features * (cuts + 1) * 2 rows at most
            best = best_condition(counts, cuts)
            if best is None:
                break
            rule.append(best)
            if not best_leaves_bad(counts, best):
                break
        if not rule:
            break
        prefixes = [every([c.bucketed() for c in rule[: k + 1]]) for k in range(len(rule))]
        sums = left.where(~F.col("_grow")).agg(
            *[F.coalesce(F.sum((p & F.col("bad")).cast("long")), F.lit(0)).alias(f"p{k}") for k, p in enumerate(prefixes)],
            *[F.coalesce(F.sum((p & ~F.col("bad")).cast("long")), F.lit(0)).alias(f"n{k}") for k, p in enumerate(prefixes)],
        ).first()
        worth = [(sums[f"p{k}"] - sums[f"n{k}"]) / max(1, sums[f"p{k}"] + sums[f"n{k}"]) for k in range(len(rule))]
        k = max(range(len(rule)), key=lambda i: (worth[i], -i))
        p, n = sums[f"p{k}"], sums[f"n{k}"]
        if p < LEAST_FOUND or p < PRECISION * (p + n):
            break
        rules.append(rule[: k + 1])
        covered = covered | prefixes[k]
    return centred(rows, rules)


def centred(rows: DataFrame, rules: list[Rule]) -> list[Rule]:
    """Each cut moved to the middle of the gap above it in which no labelled row lies."""
    if not rules:
        return rules
    flat = [c for rule in rules for c in rule]
    above = rows.agg(*[F.min(F.when(F.col(c.feature) > c.cut, F.col(c.feature))).cast("double").alias(f"m{i}") for i, c in enumerate(flat)]).first()
    moved = iter([replace(c, cut=(c.cut + above[i]) / 2 if above[i] is not None else c.cut) for i, c in enumerate(flat)])
    return [[next(moved) for _ in rule] for rule in rules]


def best_condition(counts: list, cuts: dict[str, list[float]]) -> Condition | None:
    """The condition of the highest FOIL gain, from counts by (feature, bucket, bad)."""
    best, chosen = 1e-9, None
    for f in FEATURES:
        of = [r for r in counts if r["f"] == f]
        p_all, n_all = sum(r["count"] for r in of if r["bad"]), sum(r["count"] for r in of if not r["bad"])
        if not p_all or not n_all:
            continue
        before = math.log2(p_all / (p_all + n_all))
        for b, cut in enumerate(cuts[f]):
            p, n = (sum(r["count"] for r in of if r["b"] > b and bool(r["bad"]) == bad) for bad in (True, False))
            for above, pp, nn in ((True, p, n), (False, p_all - p, n_all - n)):
                if pp and (gain := pp * (math.log2(pp / (pp + nn)) - before)) > best:
                    best, chosen = gain, Condition(f, above, cut, b)
    return chosen


def best_leaves_bad(counts: list, c: Condition) -> bool:
    """Whether good rows still meet the condition, so that the rule can grow."""
    return any(r["count"] for r in counts if r["f"] == c.feature and not r["bad"] and (r["b"] > c.bucket) == c.above)


def decision_list(rules: list[Rule]) -> Column:
    """The number (from 1) of the first rule that holds, or null: one ordered conditional expression."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(every([c.column() for c in rule]), F.lit(k)).otherwise(out)
    return out


def as_sql(rules: list[Rule]) -> str:
    """The rules as readable SQL."""
    whens = [f"WHEN {' AND '.join(map(str, r))} THEN {k}" for k, r in enumerate(rules, 1)]
    return f"CASE {' '.join(whens)} END" if whens else "NULL"


def judged(docs: DataFrame, labels: DataFrame, keep: list[str], seed: int = 6) -> tuple[DataFrame, list[Rule]]:
    """docs[keep] (doc_id among them) with statistics, base_failed, rule and kept; and the rules."""
    stats = stored(with_features(text_statistics(docs, keep)), "quality-statistics")
    bad = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").alias("_id"), (F.col("quality") == 0).alias("bad"))
    labelled = stats.where(~F.col("base_failed")).join(bad, F.col("doc_id") == F.col("_id")).drop("_id")
    rules = learn(labelled, seed)
    out = stats.withColumn("rule", decision_list(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), rules


def learned(docs: DataFrame, labels: DataFrame, seed: int = 6) -> list[Rule]:
    """Rules from the labelled documents alone, from about LABELLED of them."""
    bad = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").alias("_id"), (F.col("quality") == 0).alias("bad"))
    n = bad.count()
    if n > LABELLED:
        bad = bad.where(F.pmod(F.xxhash64("_id", F.lit(seed + 1)), F.lit(n)) < LABELLED)
    bad = stored(bad, "quality-labels")
    side = F.broadcast(bad) if bad.count() <= 4 * LABELLED else bad  # more only if one document has very many labels
    some = docs.select("doc_id", "text").join(side, F.col("doc_id") == F.col("_id"))
    return learn(stored(with_features(text_statistics(some, ["doc_id", "bad"])).where(~F.col("base_failed")), "quality-statistics"), seed)


def accepted(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of docs, columns as they are, that no rule rejects: statistics and rules in one pass, without a shuffle.

    The statistics come out of a generator, below which the filter is not moved: moved into the projections, it would
    measure a text once for each condition.
    """
    row = docs.select(whole_row(docs).alias("_row"), "text")
    measured = text_statistics(row, ["_row"])
    stats = with_features(measured.select(F.inline(F.array(F.struct(*measured.columns)))))
    return stats.where(~F.col("base_failed") & decision_list(rules).isNull()).select("_row.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")
