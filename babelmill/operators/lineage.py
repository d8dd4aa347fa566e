"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a folder of our own only where it is unset and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='babelmill-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: For tables with rows of megabytes: bytes of a row group, which writers and readers hold whole. Sizes are looked at after
#: every row; as it is, Parquet first looks after a hundred.
LARGE_ROWS = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}


def stored(df: DataFrame, name: str, compression: str = "zstd", large_rows: bool = False) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).options(**(LARGE_ROWS if large_rows else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
