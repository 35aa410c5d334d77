"""The history panel: one row a month with levels, returns, income, yield and status columns.

``panel_from_trades`` builds one from any table of priced trades: a level is the mean price of a flag's
trades in a month. Means are exact decimal sums over counts, so any partitioning gives the same doubles.
The trades are aggregated with partial sums before the one shuffle on (month, flag); what follows has a
row a month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.months import month_index, month_of

#: Months before these have no observed total return; estimates stand in.
NDX_TR_FROM, SPX_TR_FROM = "1997-01", "1996-01"
BANDS = {"default": 1.0, "low": 0.75, "high": 1.25}


def exact_mean(column: str) -> Column:
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double") / F.count(column)


def monthly_levels(trades: DataFrame) -> DataFrame:
    """month, flag -> mean price, income, quantity, tax sums."""
    rows = trades.select(month_of("l_shipdate").alias("month"), F.col("l_returnflag").alias("flag"), "l_extendedprice", "l_discount", "l_quantity", "l_tax")
    return rows.groupBy("month", "flag").agg(
        exact_mean("l_extendedprice").alias("level"),
        (exact_mean("l_discount") / 12).alias("income"),
        exact_mean("l_quantity").alias("pe"),
        F.sum(F.col("l_tax").cast("decimal(18,2)")).alias("tax_sum"),
        F.count("l_tax").alias("tax_n"),
    )


def levels_panel(levels: DataFrame) -> DataFrame:
    """One row a month with the three assets' levels; months without all three are out (inner join on the key)."""
    pick = lambda flag, c: F.max(F.when(F.col("flag") == flag, F.col(c)))  # noqa: E731  one row for each month and flag
    wide = levels.groupBy("month").agg(
        pick("N", "level").alias("NDX"), pick("A", "level").alias("SPX"), pick("R", "level").alias("OTHER"),
        pick("N", "income").alias("inc_ndx"), pick("A", "income").alias("inc_spx"),
        pick("N", "pe").alias("ndx_pe"), pick("A", "pe").alias("spx_pe"),
        (F.sum("tax_sum").cast("double") / F.sum("tax_n")).alias("dgs10"),
    )
    return wide.filter("NDX is not null and SPX is not null and OTHER is not null").drop("OTHER")


def by_month() -> W:
    return W.partitionBy().orderBy("month")  # a row a month: hundreds, whatever the size of the trades


def bond_columns(y0: Column, y1: Column) -> tuple[Column, Column, Column]:
    """(coupon, price return, total return) of a par bond of ten years, held for a month while the yield goes from y0 to y1."""
    discount = F.pow(1 + y1 / 2, F.lit(-2 * (10 - 1 / 12)))
    price = y0 / y1 * (1 - discount) + discount - 1
    return y0 / 12, price, price + y0 / 12


def history(levels: DataFrame) -> DataFrame:
    """The panel: ``t`` from 0 (a level row), price returns, total returns where observed, estimates and bands elsewhere, bond columns, statuses."""
    w = by_month()
    back = lambda c: F.lag(c).over(w)
    df = levels.withColumn("t", F.row_number().over(w) - 1).withColumn("mi", month_index(F.col("month")))
    df = df.withColumn("ndx_pr", F.col("NDX") / back("NDX") - 1).withColumn("spx_pr", F.col("SPX") / back("SPX") - 1)
    coupon, bond_pr, bond_tr = bond_columns(back("dgs10"), F.col("dgs10"))
    df = df.withColumn("coupon", coupon).withColumn("bond_pr", bond_pr).withColumn("bond_tr", bond_tr)
    df = df.withColumn("RF", F.col("dgs10") / 12)
    df = df.withColumn("ndx_tr", F.when(F.col("month") >= NDX_TR_FROM, F.col("ndx_pr") + F.col("inc_ndx")))
    df = df.withColumn("spx_tr", F.when(F.col("month") >= SPX_TR_FROM, F.col("spx_pr") + F.col("inc_spx")))
    for band, k in BANDS.items():
        df = df.withColumn(f"ndx_div_{band}", F.when((F.col("month") < NDX_TR_FROM) & (F.col("t") > 0), F.col("inc_ndx") * k))
    df = df.withColumn("spx_tr_con", F.when(F.col("month") < SPX_TR_FROM, F.col("spx_pr") + F.col("inc_spx")))
    return with_status(df)


def with_status(df: DataFrame) -> DataFrame:
    """Extended total returns and how each came about."""
    df = df.withColumn("ndx_tr_ext", F.coalesce("ndx_tr", F.col("ndx_pr") + F.col("ndx_div_default")))
    df = df.withColumn("spx_tr_ext", F.coalesce("spx_tr", "spx_tr_con"))
    df = df.withColumn("ndx_tr_status", F.when(F.col("ndx_tr").isNotNull(), "observed").when(F.col("ndx_div_default").isNotNull(), "estimated").otherwise(""))
    return df.withColumn("spx_tr_status", F.when(F.col("spx_tr").isNotNull(), "observed").when(F.col("spx_tr_con").isNotNull(), "constructed").otherwise(""))


def panel_from_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(levels_panel(monthly_levels(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))))


def first_latest(panel: DataFrame) -> DataFrame:
    return panel.agg(F.min("month").alias("first_month"), F.max("month").alias("latest_month"), F.count("*").alias("n"))


def yield_at(panel: DataFrame, month: str) -> DataFrame:
    """The yield of one month, by a filter that reaches the scan."""
    return panel.filter(F.col("month") == month).select("month", "dgs10")
