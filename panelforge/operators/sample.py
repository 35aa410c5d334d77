"""Samples: a range of the panel on one return basis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import PanelError

ASSETS = ("ndx", "spx", "ust")


def equity_returns(basis: str = "tr", band: str = "default", wht: float = 0.0) -> tuple[Column, Column]:
    """Returns of the two equity assets on a basis: totals observed or estimated, less the tax on dividends, or prices."""
    if basis == "pr":
        return F.col("ndx_pr"), F.col("spx_pr")
    ndx, spx = F.coalesce("ndx_tr", F.col("ndx_pr") + F.col(f"ndx_div_{band}")), F.coalesce("spx_tr", "spx_tr_con")
    return ndx - wht * (ndx - F.col("ndx_pr")), spx - wht * (spx - F.col("spx_pr"))


def build(panel: DataFrame, start: str | None = None, end: str | None = None, basis: str = "tr", band: str = "default", wht: float = 0.0) -> DataFrame:
    """Return rows in (start, end]: ``t`` from 1, ``month``, ``r_ndx``, ``r_spx``, ``r_ust``, ``rf``, ``div_ndx``, ``div_spx``, ``dgs10``.

    The start month is a level row; without one the panel's first month is. ``wht`` is a tax on dividends.
    """
    if basis not in ("tr", "pr") or band not in ("default", "low", "high"):
        raise PanelError("E_BAD_RANGE", f"basis {basis}, band {band}")
    if start and end and start >= end:
        raise PanelError("E_BAD_RANGE", f"{start} to {end}")
    df = panel.filter(F.col("month") > start) if start else panel.filter("t > 0")
    df = df.filter(F.col("month") <= end) if end else df
    ndx, spx = equity_returns(basis, band, wht)
    if basis == "tr":
        gross = equity_returns(basis, band)
        div_n, div_s, ust = gross[0] - F.col("ndx_pr"), gross[1] - F.col("spx_pr"), F.col("bond_tr")
    else:
        ust = F.col("bond_pr")
        div_n = div_s = F.lit(0.0)
    out = df.select("month", "mi", ndx.alias("r_ndx"), spx.alias("r_spx"), ust.alias("r_ust"), F.col("RF").alias("rf"), div_n.alias("div_ndx"), div_s.alias("div_spx"), "dgs10")
    return out.withColumn("t", F.row_number().over(W.partitionBy().orderBy("month")).cast("int"))


def check(sample: DataFrame, least: int = 24) -> int:
    """The number of rows; raises unless there are enough without a null. One small aggregate."""
    need = ["r_ndx", "r_spx", "r_ust", "rf"]
    n, full = sample.agg(F.count("*"), F.count(F.when(sum((F.col(c).isNull().cast("int") for c in need), F.lit(0)) == 0, 1))).first()
    if n < least:
        raise PanelError("E_SHORT_SAMPLE", f"{n} months, {least} needed")
    if full < n:
        raise PanelError("E_NULL_DATA", f"{n - full} months without data")
    return n


def cut(sample: DataFrame, begin: int, end: int) -> DataFrame:
    """Rows at positions [begin, end), numbered anew."""
    return sample.filter(F.col("t").between(begin + 1, end)).withColumn("t", (F.col("t") - begin).cast("int"))


def long(sample: DataFrame, assets: tuple[str, ...] = ASSETS) -> DataFrame:
    """(``series``, ``t``, ``month``, ``r``, ``rf``): one row for each asset and month, without a shuffle."""
    pairs = F.array(*(F.struct(F.lit(a).alias("series"), F.col(f"r_{a}").alias("r")) for a in assets))
    return sample.select("t", "month", "rf", F.explode(pairs).alias("x")).select("x.series", "t", "month", "x.r", "rf")


def levered(r: Column, lev: Column, rf: Column, spread: Column) -> Column:
    """A return at a leverage, borrowed at rf and a spread a year."""
    return lev * r - (lev - 1) * rf - F.greatest(lev - 1, F.lit(0.0)) * spread / 12


def mix(sample: DataFrame, weights: DataFrame, leverage: bool = False) -> DataFrame:
    """(``series``, ``t``, ``month``, ``r``, ``rf``) of fixed-weight portfolios: ``weights`` has ``series``, ``w_ndx``, ``w_spx``, ``w_ust`` (and ``L``, ``spread``).

    The sample has a row a month and is broadcast; each portfolio's rows are made where its weights are.
    """
    r = sum((F.col(f"w_{a}") * F.col(f"r_{a}") for a in ASSETS), F.lit(0.0))
    if leverage:
        r = levered(r, F.coalesce("L", F.lit(1.0)), F.col("rf"), F.coalesce("spread", F.lit(0.0)))
    months = F.broadcast(sample.select("t", "month", "rf", *(f"r_{a}" for a in ASSETS)))
    return weights.join(months, F.lit(True)).select("series", "t", "month", r.alias("r"), "rf")


def estimated_ranges(panel: DataFrame, start: str | None = None) -> DataFrame:
    """Per kind of estimate: first and last month and how many."""
    rows = panel.filter("t > 0")
    rows = rows.filter(F.col("month") > start) if start else rows
    kinds = F.array(F.when(F.col("ndx_tr").isNull(), F.lit("ndx_div")), F.when(F.col("spx_tr").isNull(), F.lit("spx_con")))
    each = rows.select("month", F.explode(kinds).alias("kind")).filter("kind is not null")
    return each.groupBy("kind").agg(F.min("month").alias("from_month"), F.max("month").alias("to_month"), F.count("*").alias("n"))


def notes_in(notes: DataFrame, sample: DataFrame) -> DataFrame:
    """Notes on months of the sample."""
    return notes.join(sample.select("month"), "month", "left_semi")


def calendar_returns(series: DataFrame) -> DataFrame:
    """Per series and year with exactly 12 months: the year's return."""
    years = series.groupBy("series", F.substring("month", 1, 4).alias("year")).agg(F.expm1(F.sum(F.log1p("r"))).alias("ret"), F.count("*").alias("n"))
    return years.filter("n = 12").drop("n")


def annual_yield(y: Column) -> Column:
    """Semi-annual yield as an effective annual return."""
    return F.pow(1 + y / 2, F.lit(2.0)) - 1
