"""Every registered query against its SQL on the smallest tables; streams against their batch forms."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelforge import queries
from panelforge.streaming import monthly

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    cell = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 6) + 0.0 if isinstance(v, float) else v if isinstance(v, (int, str)) else str(v)
    return sorted(([cell(r[i]) for i in order] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, sf, con, name):
    df = queries.QUERIES[name](spark, sf)
    cursor = con.execute(queries.ORACLE_SQL[name])
    columns = [x[0] for x in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain(df.collect(), df.columns) == plain(cursor.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_without_sql(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).collect() is not None


def test_entry(spark):
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 3


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = queries.panel(spark, sf)._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("\n") if "ReadSchema" in x or "FileScan" in x)
    assert "l_comment" not in scan and "l_orderkey" not in scan


def test_stream_is_its_batch_form(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "event_type", "value")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = monthly.last_per_window(stream, "event_type", "ts", "value", late="365 days").writeStream.outputMode("complete").format("memory").queryName("last_values").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp1")).start()
    q.awaitTermination(120)
    got = {(str(r.start)[:10], r.event_type): r.n for r in spark.table("last_values").collect()}
    want = {(r.day, r.event_type): r.n for r in batch.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want
    for _ in range(2):
        fresh = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
        w = monthly.append_only(fresh, str(tmp_path / "out"), "event_id", str(tmp_path / f"cp{_ + 2}")).trigger(availableNow=True).start()
        w.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count()
