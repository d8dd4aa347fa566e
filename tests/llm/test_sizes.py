"""What a task or the driver holds at once: row groups of large rows, tables that are broadcast."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from babelmill.llm import decontamination, near_dedup
from babelmill.operators import lineage


def test_row_groups_of_the_index_are_bounded_in_bytes(spark):
    words = F.transform(F.sequence(F.lit(1), F.lit(1 << 14)), lambda i: F.hex(F.pmod(F.xxhash64("row_id", i), F.lit(1 << 16))))
    docs = spark.range(0, 700, 1, 1).select(F.col("id").alias("row_id"), F.array_join(words, " ").alias("text"))
    index = decontamination.build_index(docs)
    found = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    groups = [m.row_group(i) for m in found for i in range(m.num_row_groups)]
    assert index.count() > 20
    assert sum(g.total_byte_size for g in groups) > 2 * lineage.LARGE_ROWS["parquet.block.size"]
    assert max(g.total_byte_size for g in groups) < 2 * lineage.LARGE_ROWS["parquet.block.size"]


def test_near_dedup_broadcasts_only_what_is_counted(spark, monkeypatch):
    stored, joined = near_dedup.stored, {}

    def watched(df, name):
        joined.setdefault(name, []).append(df._jdf.queryExecution().sparkPlan().toString())
        return stored(df, name)

    monkeypatch.setattr(near_dedup, "stored", watched)
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{text} {'x' * (i % 3)}") for i in range(30)] + [(99, "quite another text of some words")], "doc_id long, text string")
    out = near_dedup.near_duplicates(docs)
    joined["out"] = [out._jdf.queryExecution().sparkPlan().toString()]
    assert {name for name, plans in joined.items() if any("BroadcastHashJoin" in p for p in plans)} <= {"near-texts"}
    assert all("SortMergeJoin" in p for name in ("near-members", "near-pairs", "near-links", "out") for p in joined[name])
    assert {(r.doc_id, r.component_id) for r in out.collect()} == {(i, 0) for i in range(30)} | {(99, 99)}
