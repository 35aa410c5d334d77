"""Sharding by Hilbert-curve order over several metadata dimensions.

Each dimension is quantised into 2**bits cells of about equal counts (boundaries of numbers from a mergeable
quantile sketch over all rows, those of texts from a range sort of their distinct whole values), the cells become a Hilbert index, and the rows in curve order are cut
into runs. Neighbours on the curve are close in every dimension, so each shard covers a small box and
readers skip shards by their ranges. Many rows may share a cell; a hash of the document breaks ties,
so a hot cell is dealt over range partitions like any other rows.

Laws: ``rows`` cuts runs whose counts differ by one at most; ``bytes`` cuts at equal shares of the bytes.

Defined results: null metadata lies in the first cell; a null text has no bytes and a null crc32; an
empty table gives no rows; repeated rows get places of their own.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, materialise, ordered_positions, with_key


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points (rows of ``cells``, each coordinate under 2**bits), for any number of dimensions."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    level = 1 << (bits - 1)
    while level > 1:  # undo the rotations and reflections of each level
        low = level - 1
        for i in range(n):
            flip = (x[i] & level) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    fix = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        fix = np.where((x[n - 1] & level) != 0, fix ^ (level - 1), fix)
        level >>= 1
    x ^= fix
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):  # interleave, highest bits first
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _bounds(rows: DataFrame, number: int, cells: int) -> tuple[list[str], list[int], list[int]]:
    """What places the texts of a dimension (``__t<number>``) in cells of about equal counts, over whole values: values, the cell of each and the cell after it.

    The distinct values are range-sorted with their counts. A value counts as a bound where the rows before it and those up
    to its end fall into different cells; it lies in the cell of its middle row, and the values up to the next bound lie in the cell
    where its rows end. ``cells`` bounds at most reach the driver.
    """
    name = f"__t{number}"
    values = rows.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("__n"))
    placed = ordered_positions(values, [name], ["__n"])
    total = max(placed.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0], 1)
    before, middle, after = (F.expr(f"({x} * {cells}) div {d * total}") for x, d in (("before___n", 1), ("(2 * before___n + __n)", 2), ("(before___n + __n)", 1)))
    found = placed.filter(before != after).select(name, middle, F.least(after, F.lit(cells - 1))).collect()
    found.sort(key=lambda r: r[0].encode())
    return [r[0] for r in found], [int(r[1]) for r in found], [int(r[2]) for r in found]


def assign(docs: DataFrame, shards: int = 24, dimensions: tuple[str, ...] = ("lang", "source", "doc_id", "size"), bits: int = 6, law: str = "rows", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, ``size`` (UTF-8 bytes + 8), ``text_crc32``, ``curve``, ``shard``, ``slot``. ``size`` may be named as a dimension."""
    if law not in ("rows", "bytes"):
        raise ValueError(f"law: {law}")
    if bits * len(dimensions) > 62:
        raise ValueError("bits times dimensions is over 62")
    rows = with_key(docs, id_col).withColumn("__size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8)
    own = [F.col("__size") if d == "size" else F.col(d) for d in dimensions]
    texts = [d != "size" and isinstance(docs.schema[d].dataType, T.StringType) for d in dimensions]
    told = [(c if t else c.cast("double")).alias(f"__t{i}") for i, (c, t) in enumerate(zip(own, texts, strict=True))]
    rows = materialise(rows.select(F.col(id_col).alias("__id"), "__key", "__hash", "__size", F.crc32(F.col("text").cast("binary")).alias("__crc"), *told))
    cuts = [k / (1 << bits) for k in range(1, 1 << bits)]
    plain = [i for i, t in enumerate(texts) if not t]
    found = rows.agg(F.lit(0), *(F.percentile_approx(f"__t{i}", cuts, 4096) for i in plain)).first()
    edges: list = [_bounds(rows, i, 1 << bits) if t else None for i, t in enumerate(texts)]
    for i, b in zip(plain, found[1:], strict=True):
        edges[i] = np.array(b if b else [], float)

    def cell(i: int, column: pa.Array) -> np.ndarray:
        if texts[i]:
            distinct = column.dictionary_encode()
            bounds, own, later = edges[i]
            cells = []
            for v in distinct.dictionary.to_pylist():
                at = bisect_right(bounds, v) - 1
                cells.append(0 if at < 0 else own[at] if bounds[at] == v else later[at])
            cells = np.array([*cells, 0], np.int64)
            return cells[distinct.indices.fill_null(len(cells) - 1).to_numpy(zero_copy_only=False)]
        at = column.to_numpy(zero_copy_only=False).astype(float)
        return np.where(np.isnan(at), 0, np.searchsorted(edges[i], at, side="right"))

    def curve(batches):
        for b in batches:
            cells = np.stack([cell(i, b.column(5 + i)) for i in range(len(edges))], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(hilbert_index(cells, bits))], ["__id", "__key", "__hash", "__size", "__crc", "curve"])

    kept = rows.schema.fields[:5]
    placed = rows.mapInArrow(curve, T.StructType([*kept, T.StructField("curve", T.LongType())]))
    placed = placed.withColumn("__tie", F.xxhash64("__key", "__hash"))
    placed = materialise(ordered_positions(placed, ["curve", "__tie", "__key", "__hash"], ["__size"]))
    n, total = placed.agg(F.count("*"), F.coalesce(F.sum("__size"), F.lit(0))).first()
    if law == "rows":
        shard = F.expr(f"(position * {shards}) div {max(n, 1)}").cast("int")
        slot = F.col("position") - F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")
        done = placed.withColumn("shard", shard).withColumn("slot", slot)
    else:
        middle = F.col("before___size").cast("double") + F.col("__size") / 2
        done = placed.withColumn("shard", F.least(F.floor(middle * shards / max(total, 1)), F.lit(shards - 1)).cast("int"))
        first = done.groupBy("shard").agg(F.min("position").alias("__first"))  # one row a shard
        done = done.join(F.broadcast(first), "shard").withColumn("slot", F.col("position") - F.col("__first"))
    return done.select(F.col("__id").alias(id_col), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), "curve", "shard", F.col("slot").cast("long"), "__key", "__hash")


def sharded(docs: DataFrame, shards: int = 24, dimensions: tuple[str, ...] = ("lang", "source", "doc_id", "size"), bits: int = 6, law: str = "rows", id_col: str = "doc_id") -> DataFrame:
    """Whole rows with ``shard`` and ``slot`` (replacing columns of these names)."""
    places = assign(docs, shards, dimensions, bits, law, id_col)
    found = places.groupBy("__key", "__hash").agg(F.collect_list(F.struct("shard", "slot")).alias("__places"))
    rows = attach(docs, materialise(found), id_col).withColumn("__place", F.explode("__places"))
    return rows.select(*(c for c in docs.columns if c.lower() not in ("shard", "slot")), F.col("__place.shard").alias("shard"), F.col("__place.slot").alias("slot"))


def write_sharded(rows: DataFrame, path: str) -> None:
    """Writes rows that have ``shard`` and ``slot`` as Parquet under ``shard=<k>/``, in slot order; files of a shard are split by ranges of slots."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def write_shards(docs: DataFrame, path: str, shards: int = 24, dimensions: tuple[str, ...] = ("lang", "source", "doc_id", "size"), id_col: str = "doc_id") -> None:
    """``sharded`` rows, written."""
    write_sharded(sharded(docs, shards, dimensions, id_col=id_col), path)


def shard_ranges(placed: DataFrame, columns: list[str]) -> DataFrame:
    """What readers prune by: each shard's least and largest value of the columns."""
    return placed.groupBy("shard").agg(F.count("*").alias("n_rows"), *(f(c).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max))))
