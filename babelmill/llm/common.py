"""Shared pieces: the shared folder, stored tables, the seeded Feistel permutation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from babelmill.operators.lineage import shared_dir, stored

__all__ = ["SPACE_WORD", "column", "domain_bits", "feistel", "fresh", "row_key", "shared_dir", "stored", "table", "whole_row"]

#: Words for the size and quality contracts: runs of anything but ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct: no name an operator uses beside it can clash with one of them."""
    return F.struct(*[column(c) for c in df.columns])


def row_key(df: DataFrame) -> Column:
    """A 128-bit key of the whole row, maps and arrays included; repeated rows share it."""
    plain, nested = [], []
    for field in df.schema.fields:
        simple = not isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))
        (plain if simple else nested).append(column(field.name))
    held = [*plain, *[F.to_json(F.struct(c), {"ignoreNullFields": "false"}) for c in nested]]
    # Hashes pass over nulls, so it is said which columns are null.
    held.append(F.concat(*[F.when(column(c).isNull(), "0").otherwise("1") for c in df.columns]))
    half = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), *held)), 16, "0")
    return F.unhex(F.concat(half(1), half(2)))


def feistel(value: Column, n: Column | int, bits: int, seed: int, rounds: int = 6, walks: int = 100) -> Column:
    """Seeded permutation of 0..n-1: an alternating Feistel network on `bits` bits, cycle walking back into range.

    2**bits must be at least n and less than 2n, so that each walk ends with probability of at least one half. A
    domain of up to `walks` values is always walked to its end; for larger ones, a row is left outside with
    probability below n * 2**-walks, and the query then fails with an error instead of giving a wrong place.
    """
    right = bits // 2
    left = bits - right
    rmask, lmask = (1 << right) - 1, (1 << left) - 1

    # Each round names its input twice, so the rounds are a fold: Spark binds the running value once a round.
    def permuted(v: Column) -> Column:
        def fold(s: Column, r: Column) -> Column:
            odd = r.bitwiseAND(F.lit(1)) == 1
            key = F.when(odd, F.shiftrightunsigned(s, right)).otherwise(s.bitwiseAND(F.lit(rmask)))
            h = F.xxhash64(key, F.lit(seed), r)
            return s.bitwiseXOR(
                F.when(odd, h.bitwiseAND(F.lit(rmask))).otherwise(F.shiftleft(h.bitwiseAND(F.lit(lmask)), right))
            )

        return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), v, fold)

    limit = F.lit(n).cast("long") if not isinstance(n, Column) else n
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(walks)), permuted(value), lambda v, _: F.when(v < limit, v).otherwise(permuted(v))
    )
    return F.transform(
        F.array(walked),
        lambda v: F.when(v < limit, v).otherwise(F.raise_error(F.lit("cycle walk did not end; choose another seed")).cast("long")),
    )[0]


def domain_bits(n: int) -> int:
    """Bits of the smallest power of two that is at least n (at least 2 bits, for two halves)."""
    return max(2, (max(n, 1) - 1).bit_length())
