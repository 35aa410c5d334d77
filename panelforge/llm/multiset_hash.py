"""Homomorphic multiset fingerprints of documents.

Every paragraph (line with anything in it) is hashed to a wide vector; a document's fingerprint is the
sum of its paragraphs' vectors, each lane modulo a power of two. Sums don't depend on order, so texts with the
same paragraphs in any order are equal; a paragraph is inserted or deleted by adding or subtracting its
vector, without the rest of the text. Lanes are of two kinds: ``UNIFORM`` lanes of 32 random bits make
unequal multisets differ, and ``SIGNS`` lanes of plus or minus one (summed whole, written modulo 2**32) make the
fingerprint a sketch: the squared length of a difference estimates by how many paragraphs two documents differ.

Defined results: null and empty texts have the zero fingerprint, which is equal to itself (likeness 1)
and unlike any other (0); repeated rows follow one another; null ids come last in descending order; one
row alone is its own next document.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, with_key

UNIFORM, SIGNS = 14, 64  # blake2b's 64 bytes: 14 x 32 bits and 64 signs


class Fingerprint:
    """A sum of paragraph vectors."""

    __slots__ = ("signs", "uniform")

    def __init__(self, uniform: np.ndarray | None = None, signs: np.ndarray | None = None):
        self.uniform = np.zeros(UNIFORM, np.uint32) if uniform is None else uniform
        self.signs = np.zeros(SIGNS, np.int64) if signs is None else signs

    @classmethod
    def of(cls, text: bytes) -> Fingerprint:
        digests = [hashlib.blake2b(p).digest() for p in text.split(b"\n") if p]
        if not digests:
            return cls()
        raw = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 64)
        uniform = np.ascontiguousarray(raw[:, : 4 * UNIFORM]).view(np.uint32).sum(axis=0, dtype=np.uint32)
        ones = np.unpackbits(np.ascontiguousarray(raw[:, 4 * UNIFORM :]), axis=1).sum(axis=0, dtype=np.int64)
        return cls(uniform, 2 * ones - len(raw))

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.uniform + other.uniform, self.signs + other.signs)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.uniform - other.uniform, self.signs - other.signs)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and self.hex() == other.hex()

    __hash__ = None

    def hex(self) -> str:
        """Both parts modulo 2**32; a text of less than 2 GB has fewer paragraphs than would wrap the sign sums."""
        return self.uniform.astype(">u4").tobytes().hex() + self.signs.astype(">i4").tobytes().hex()

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal multisets, else 1 - |a - b|^2 / (|a|^2 + |b|^2) over the sign lanes, not below 0: about the share of paragraphs in common."""
        if self == other:
            return 1.0
        a, b = self.signs.astype(float), other.signs.astype(float)
        d = a - b
        whole = a @ a + b @ b
        return max(0.0, 1 - d @ d / whole) if whole else 0.0


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the next document's first, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _groups(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Rows (``__id``, ``__hash``, ``__text``) with ``__g``, a number whose order is that of descending ids (none last), then ascending hashes; and how many partitions they need.

    Groups are ranges of (id, hash) of at most about a fourth of ``size`` bytes of text: a range sort of ids and hashes alone gives their bounds, one
    row a group, whatever the type of the ids. Rows of one id are dealt on by their texts' hashes.
    """
    told = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("__text") + 32), F.lit(0))).first()
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-told[1] // size))
    placed = rows.select("__id", "__hash").repartitionByRange(4 * n, F.col("__id").desc_nulls_last(), F.col("__hash"))
    lowest = F.max(F.struct("__id", F.bitwise_not("__hash").alias("h")))  # first in order: the largest id, of it the smallest hash; null is least
    firsts = placed.groupBy(F.spark_partition_id()).agg(lowest.alias("f")).select("f.__id", F.bitwise_not("f.h").alias("h")).collect()
    order = lambda i, h: (i is not None, 0 if i is None else i, -h)  # noqa: E731  ascending where the rows descend
    edges = sorted(order(r[0], r[1]) for r in firsts)

    @F.arrow_udf(T.LongType())
    def number(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        return pa.array([len(edges) - bisect_left(edges, order(i, h)) for i, h in zip(ids.to_pylist(), hashes.to_pylist(), strict=True)], pa.int64())

    return rows.withColumn("__g", number("__id", "__hash")), n


def consecutive(docs: DataFrame, id_col: str = "doc_id", size: int = 48 << 20) -> DataFrame:
    """Rows (``__id``, ``__text``, ``__g``, ``__head``) partitioned and sorted so that each row's next document follows it.

    Every group ends with a copy of the first row of the group after it (the last one's with that of
    the first), marked ``__head``: texts are shuffled once, and no task sees more than a few groups of ``size`` bytes.
    """
    rows = with_key(docs.select(F.col(id_col).alias("__id"), F.coalesce("text", F.lit("")).alias("__text")), "__id", "__text")
    rows, n = _groups(rows.select("__id", "__hash", "__text"), size)
    first = rows.groupBy("__g").agg(F.max(F.struct("__id", F.bitwise_not("__hash").alias("h"))).alias("f"))
    order = W.orderBy("__g")  # a row a group
    last = F.max("__g").over(W.partitionBy())
    heads = first.select(F.col("f.__id").alias("__i"), F.bitwise_not("f.h").alias("__h"), F.coalesce(F.lag("__g").over(order), last).alias("__to"))
    heads = materialise(heads)
    joined = rows.join(F.broadcast(heads), F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__hash") == F.col("__h")), "left")  # a row for every ``size`` bytes of text
    own = F.struct(F.col("__g").alias("g"), F.lit(False).alias("head"))
    copy = F.struct(F.col("__to").alias("g"), F.lit(True).alias("head"))
    both = joined.withColumn("__at", F.explode(F.when(F.col("__to").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    both = both.select("__id", "__hash", "__text", F.col("__at.g").alias("__g"), F.col("__at.head").alias("__head"))
    sorted_rows = both.repartition(n, "__g").sortWithinPartitions("__g", "__head", F.col("__id").desc_nulls_last(), "__hash")
    return sorted_rows.select("__id", "__text", "__g", "__head")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``."""
    rows = consecutive(docs, id_col)
    fields = [("n_chars", T.LongType(), pa.int64()), ("edited_sha256", T.StringType(), pa.string()), ("fingerprint", T.StringType(), pa.string()), ("edited_fingerprint", T.StringType(), pa.string()), ("near_edited", T.DoubleType(), pa.float64()), ("near_next", T.DoubleType(), pa.float64())]
    id_type = rows.schema.fields[0]

    def run(batches):
        held = None  # the row that waits for its next document: group, id, text, fingerprint
        for b in batches:
            out = []
            for i, t, g, head in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if head and (held is None or held[0] != g):
                    continue  # a copy of a row that is there more than once
                text = t.as_py()
                print_ = Fingerprint.of(text.encode())
                if held is not None and held[0] == g:
                    new = edited(held[2], text).encode()
                    changed = Fingerprint.of(new)
                    out.append((held[1], len(held[2]), hashlib.sha256(new).hexdigest(), held[3].hex(), changed.hex(), held[3].likeness(changed), held[3].likeness(print_)))
                held = None if head else (g, i, text, print_)
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], b.column(0).type), *(pa.array(c, f[2]) for c, f in zip(columns[1:], fields, strict=True))], ["__id", *(f[0] for f in fields)])

    return rows.mapInArrow(run, T.StructType([id_type, *(T.StructField(a, b) for a, b, _ in fields)])).withColumnRenamed("__id", id_col)
