"""Files in and out: CSV and JSON documents, manifests, idempotent appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PanelError
from ..functions.numbers import parse_value


def read_csv(spark: SparkSession, path: str, key: str = "month", numbers: tuple[str, ...] = ()) -> DataFrame:
    """A CSV with a header, keyed by a column; of repeated keys the row that comes last in the file wins."""
    text = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    placed = text.withColumn("__file", F.col("_metadata.file_path")).withColumn("__at", F.monotonically_increasing_id())
    last = W.partitionBy(key).orderBy(F.desc("__file"), F.desc("__at"))
    out = placed.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n", "__at", "__file")
    return out.withColumns({c: parse_value(F.col(c)) for c in numbers})


def read_closes(spark: SparkSession, path: str) -> DataFrame:
    """A two-column file of dates and closes; rows without a close are out."""
    schema = T.StructType([T.StructField("date", T.StringType()), T.StructField("close", T.DoubleType())])
    return spark.read.schema(schema).option("header", True).csv(path).filter("close is not null")


def read_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One nested JSON document in a file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def members(document: DataFrame, array: str) -> DataFrame:
    """The elements of an array member as rows."""
    return document.select(F.explode(array).alias("__m")).select("__m.*")


def no_nan(df: DataFrame) -> DataFrame:
    """NaN and infinities become null: JSON and comparisons know neither."""
    bad = lambda c: F.isnan(c) | F.abs(c).eqNullSafe(F.lit(float("inf")))
    return df.withColumns({f.name: F.when(~bad(F.col(f.name)), F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def write_json(df: DataFrame, path: str) -> None:
    no_nan(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, crlf: bool = False) -> None:
    """RFC 4180 quoting; numbers that aren't finite are empty."""
    out = no_nan(df).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "")
    (out.option("lineSep", "\n") if not crlf else out).csv(path)


def csv_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """RFC 4180 lines of a few columns, header first: for downloads."""
    quoted = [F.coalesce(F.when(F.col(c).cast("string").rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c).cast("string")), F.lit("")) for c in columns]
    return no_nan(df).select(F.concat_ws(",", *quoted).alias("line"))


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a path with their bytes and SHA-256; contents stay on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def append_months(old: DataFrame, new: DataFrame, values: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Old rows and the new ones whose month isn't there yet. Months in both must agree, or the append fails."""
    both = old.alias("o").join(new.alias("n"), "month")
    differs = [(F.abs(F.col(f"o.{c}") - F.col(f"n.{c}")) > tolerance) | (F.col(f"o.{c}").isNull() != F.col(f"n.{c}").isNull()) for c in values]
    bad = differs[0]
    for d in differs[1:]:
        bad = bad | d
    if not both.filter(bad).limit(1).isEmpty():
        raise PanelError("E_NULL_DATA", "appended months differ from those that are there")
    return old.unionByName(new.join(old.select("month"), "month", "left_anti").select(old.columns))


def replace_notes(kept: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows take the place of old ones with their key."""
    return kept.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
