"""What the corpus operators share: the shared folder, byte-level word rules, Arrow helpers.

Conventions of every operator here
----------------------------------
* A document is a row; rows equal in id and text are one document written twice and get the same result.
* A null text counts as an empty one unless the operator's docstring says otherwise.
* Columns made on the way start with ``__``; an input column of any other name is never touched.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed: A-Z to a-z, other ASCII that is neither letter nor digit to a space; bytes over 0x7F stay.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local master, whose executors see the driver's disk, gets one of our own where that is unset."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    sc = spark.sparkContext
    if not (made := sc._jsc.sc().getCheckpointDir()).isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="panelforge-"))
        made = sc._jsc.sc().getCheckpointDir()
    return made.get().rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Runs ``df`` once and cuts its lineage with a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    where = shared_dir(df.sparkSession)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str = "text"):
    """UTF-8 bytes of a text column; null becomes empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def space_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased: exactly what bytes.split() and bytes.lower() do."""
    return text.lower().split()


def alnum_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.translate(ALNUM).split()


def key_of(id_col: str) -> Column:
    """The id as text, null told apart."""
    return F.when(F.col(id_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(id_col).cast("string")))


def with_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds ``__key`` (the id as text, null told apart) and ``__hash`` (of the text): together they name a document."""
    return docs.withColumn("__key", key_of(id_col)).withColumn("__hash", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))


def attach(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Joins whole rows to ``found`` (``__key``, ``__hash``, columns; one row a document) and leaves one row of each document.

    Only keys and results were shuffled to make ``found``; the texts move once, here. Where documents
    are written more than once, their rows are adjacent after the join, and all but one go.
    """
    rows = with_key(docs, id_col, text_col).join(found, ["__key", "__hash"])
    first = W.partitionBy("__key", "__hash").orderBy(F.lit(0))
    return rows.withColumn("__nth", F.row_number().over(first)).filter("__nth = 1").drop("__key", "__hash", "__nth")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this package wrote, through whatever file system holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ordered_positions(rows: DataFrame, order: list[str | Column], sums: list[str] = ()) -> DataFrame:
    """Adds ``position`` (0-based in the total order of ``order``) and, for each column of ``sums`` (long or double), ``before_<column>``: its sum over earlier rows.

    Rows are range-partitioned and sorted, each partition counts its own rows, and the partitions'
    totals (one row each) are cumulated: no task sees more than its range. Rows that tie in every
    column of ``order`` must be alike.
    """
    from pyspark import TaskContext

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = rows.columns
    extra = ["__part", "position", *(f"before_{c}" for c in sums)]
    schema = T.StructType([*rows.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("position", T.LongType()), *(T.StructField(f"before_{c}", rows.schema[c].dataType) for c in sums)])
    kinds = {c: np.float64 if isinstance(rows.schema[c].dataType, T.DoubleType) else np.int64 for c in sums}

    def count(batches):
        part, at, told = TaskContext.get().partitionId(), 0, dict.fromkeys(sums, 0)
        for b in batches:
            new = [pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(at, at + b.num_rows, dtype=np.int64))]
            for c in sums:
                values = b.column(names.index(c)).fill_null(0).to_numpy(zero_copy_only=False).astype(kinds[c])
                upto = np.cumsum(values)
                new.append(pa.array(told[c] + upto - values))
                told[c] += upto[-1].item() if len(upto) else 0
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*names, *extra])

    local = materialise(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(count, schema))
    totals = local.groupBy("__part").agg(F.count("*").alias("__rows"), *(F.sum(c).alias(f"__sum_{c}") for c in sums))
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # one row for each partition
    offsets = totals.select("__part", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__o"), *(F.coalesce(F.sum(f"__sum_{c}").over(earlier), F.lit(0)).alias(f"__o_{c}") for c in sums))
    found = local.join(F.broadcast(offsets), "__part")  # at most as many rows as shuffle partitions
    found = found.withColumn("position", F.col("position") + F.col("__o"))
    for c in sums:
        found = found.withColumn(f"before_{c}", F.col(f"before_{c}") + F.col(f"__o_{c}"))
    return found.drop("__part", "__o", *(f"__o_{c}" for c in sums))
