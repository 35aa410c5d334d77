"""Labelled documents for the trained operators: all of them, or bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; remainder 0 is held out. A null id is in no fold of its own and counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5, F.lit(0))


def training_labels(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """(``__id``, ``__label`` 0/1) of every labelled id outside the held-out fold, once. An id that is labelled both 0 and 1 trains nothing."""
    own = labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__label"))
    own = own.filter(F.col("__label").isin(0, 1) & (fold("__id") != 0))
    return own.groupBy("__id").agg(F.min("__label").alias("__label"), F.max("__label").alias("__other")).filter("__label = __other").drop("__other")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """(id, ``__label`` 0/1, text) of at most ``most`` of the ``training_labels`` of each class, the first by a hash of the id.

    The bound is a parameter of the operator that trains on a sample (toxicity); everything else it does covers all rows.
    """
    own = training_labels(labels, label, id_col)
    parts = [own.filter(F.col("__label") == k).orderBy(F.xxhash64("__id"), "__id").limit(most) for k in (0, 1)]
    picked = parts[0].unionByName(parts[1])  # 2 x most short rows at most
    return docs.join(F.broadcast(picked), F.col(id_col) == F.col("__id")).select("__id", "__label", F.coalesce("text", F.lit("")).alias("text"))


def class_counts(labels: DataFrame, label: str, id_col: str = "doc_id") -> tuple[int, int]:
    """How many labelled rows outside the held-out fold are 0 and 1."""
    own = labels.filter(fold(id_col) != 0)
    n = own.agg(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).first()
    return int(n[0]), int(n[1])
