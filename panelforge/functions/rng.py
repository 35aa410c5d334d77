"""Counter-based 32-bit random numbers as column expressions.

The k-th number of a seed depends on ``seed + (k + 1) * STEP`` alone, so any partitioning gives the same
draws. Products wrap at 2**32; under ANSI arithmetic a bigint product could overflow, so the high
half of one factor is multiplied apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP, GOLDEN, MASK = 0x6D2B79F5, 0x9E3779B1, 0xFFFFFFFF


def _lit(x: int | Column) -> Column:
    return F.lit(x).cast("long") if isinstance(x, int) else x.cast("long")


def wrap(x: Column) -> Column:
    return x.bitwiseAND(F.lit(MASK))


def imul(a: int | Column, b: int | Column) -> Column:
    """Low 32 bits of the product of two unsigned 32-bit numbers."""
    a, b = _lit(a), _lit(b)
    low, high = a.bitwiseAND(F.lit(0xFFFF)), F.shiftright(a, 16).bitwiseAND(F.lit(0xFFFF))
    return wrap(low * b + (high * b.bitwiseAND(F.lit(0xFFFF))).bitwiseAND(F.lit(0xFFFF)) * F.lit(65536))


def draw_seed(seed: int | Column, b: Column) -> Column:
    """Seed of draw b."""
    return wrap(_lit(seed)).bitwiseXOR(imul(b.cast("long") + 1, GOLDEN))


def with_uniform(df: DataFrame, name: str, seed: Column, k: Column) -> DataFrame:
    """Adds the k-th (from 0) number in [0, 1) of a seed.

    Every step is a column of its own that the next one uses more than once: the optimiser keeps such columns apart, so the code of a
    step is generated once and not copied into each of its uses.
    """
    df = df.withColumn("__a", F.coalesce(wrap(seed + imul(k.cast("long") + 1, STEP)), F.lit(0).cast("long")))
    df = df.withColumn("__x", F.col("__a").bitwiseXOR(F.shiftright("__a", 15))).withColumn("__y", F.col("__a").bitwiseOR(F.lit(1)))
    df = df.withColumn("__t", imul(F.col("__x"), F.col("__y")))
    df = df.withColumn("__x", F.col("__t").bitwiseXOR(F.shiftright("__t", 7))).withColumn("__y", F.col("__t").bitwiseOR(F.lit(61)))
    df = df.withColumn("__t", wrap(F.col("__t") + imul(F.col("__x"), F.col("__y"))).bitwiseXOR(F.col("__t")))
    return df.withColumn(name, F.col("__t").bitwiseXOR(F.shiftright("__t", 14)) / F.lit(4294967296.0)).drop("__a", "__x", "__y", "__t")
