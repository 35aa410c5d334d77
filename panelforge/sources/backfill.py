"""Backfills of months without observed total returns: dividends from yearly yields, returns from a table of levels, and the checks on both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import PanelError
from . import files
from .panel import BANDS


def load_tables(spark: SparkSession, yields: str, levels: str) -> tuple[DataFrame, DataFrame]:
    """(``year``, ``dividend_yield_pct``) and (``month``, ``NDX``) from two CSV files; a yield that isn't published is null."""
    y = files.read_csv(spark, yields, key="year", numbers=("dividend_yield_pct",)).select(F.col("year").cast("int").alias("year"), "dividend_yield_pct")
    return y, files.read_csv(spark, levels, numbers=("NDX",)).select("month", "NDX")


def dividend_spread(levels: DataFrame, yields: DataFrame, first: str, last: str, assumed_year: int) -> DataFrame:
    """Monthly dividends of the months from ``first`` to ``last``: the year's yield on its December level, a twelfth of it over the month before's level.

    (``month``, ``NDX``, ``ndx_pr``, ``ndx_div_<band>``, ``flat``, ``assumed``); a year without a published yield takes that of ``assumed_year``.
    """
    rows = levels.select("month", "NDX", F.lag("NDX").over(W.partitionBy().orderBy("month")).alias("__before"), F.substring("month", 1, 4).cast("int").alias("__year"))  # a row a month
    december = levels.filter(F.col("month").endswith("-12")).select(F.substring("month", 1, 4).cast("int").alias("__year"), F.col("NDX").alias("__december"))
    told = yields.select(F.col("year").alias("__year"), F.col("dividend_yield_pct").alias("__yield"))
    stand_in = yields.filter(F.col("year") == assumed_year).agg(F.max("dividend_yield_pct").alias("__stand_in"))
    rows = rows.filter(F.col("month").between(first, last)).join(told, "__year", "left").join(december, "__year", "left").join(F.broadcast(stand_in), F.lit(True))
    base = F.coalesce("__yield", "__stand_in")
    bands = [(base * k / 100 * F.col("__december") / 12 / F.col("__before")).alias(f"ndx_div_{name}") for name, k in BANDS.items()]
    return rows.select("month", "NDX", (F.col("NDX") / F.col("__before") - 1).alias("ndx_pr"), *bands, (base / 1200).alias("flat"), F.col("__yield").isNull().alias("assumed"))


def constructed_returns(levels: DataFrame, observed: DataFrame, first: str, last: str) -> DataFrame:
    """(``month``, ``spx_tr_con``): total returns of constructed levels (``month``, ``level``) from ``first`` to ``last``; an observed level (``month``, ``observed``), where there is one, stands over the constructed one before it."""
    both = levels.join(observed, "month", "left")
    before = F.lag("level").over(W.partitionBy().orderBy("month"))
    return both.select("month", (F.coalesce("observed", "level") / before - 1).alias("spx_tr_con")).filter(F.col("month").between(first, last))


def attach(panel: DataFrame, dividends: DataFrame, constructed: DataFrame) -> DataFrame:
    """The panel's rows with their backfills, looked up by month; months without one have nulls."""
    own = [c for c in panel.columns if not (c.startswith("ndx_div_") or c == "spx_tr_con")]
    return panel.select(*own).join(dividends.select("month", *(f"ndx_div_{b}" for b in BANDS)), "month", "left").join(constructed, "month", "left")


def problems(panel: DataFrame) -> DataFrame:
    """Rows of the panel that contradict what must hold, as (``month``, ``rule``): estimates beside observations, bands out of order, total returns under price returns, values that aren't finite, months without any total return."""
    given = lambda c: F.col(c).isNotNull()
    numbers = [c for c in ("NDX", "SPX", "ndx_pr", "spx_pr", "bond_tr", "RF") if c in panel.columns]
    odd = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    later = F.col("t") > 0
    rules: dict[str, Column] = {
        "overlap_ndx": given("ndx_div_default") & given("ndx_tr"),
        "overlap_spx": given("spx_tr_con") & given("spx_tr"),
        "bands": given("ndx_div_default") & ~((F.col("ndx_div_low") <= F.col("ndx_div_default")) & (F.col("ndx_div_default") <= F.col("ndx_div_high"))),
        "constructed_under_price": given("spx_tr_con") & (F.col("spx_tr_con") < F.col("spx_pr")),
        "not_finite": F.greatest(*(F.coalesce(odd(F.col(c)), F.lit(False)) for c in numbers)),
        "missing": later & (F.coalesce("ndx_tr", F.col("ndx_pr") + F.col("ndx_div_default"), F.lit(None)).isNull() | F.coalesce("spx_tr", "spx_tr_con").isNull() | F.col("bond_tr").isNull() | F.col("RF").isNull()),
    }
    found = F.filter(F.array(*(F.when(v, F.lit(k)) for k, v in rules.items())), lambda x: x.isNotNull())
    return panel.select("month", F.explode(found).alias("rule"))


def calibrated(levels: DataFrame, targets: dict[int, float], tolerance: float = 1e-9) -> DataFrame:
    """(``year``, ``got``, ``target``, ``ok``) of calendar-year returns in percent that constructed levels (``month``, ``level``) must meet."""
    ends = levels.filter(F.col("month").endswith("-12")).select(F.substring("month", 1, 4).cast("int").alias("year"), "level")
    before = ends.select((F.col("year") + 1).alias("year"), F.col("level").alias("__before"))
    wanted = levels.sparkSession.createDataFrame(sorted(targets.items()), "year int, target double")
    got = wanted.join(ends.join(before, "year"), "year", "left").withColumn("got", 100 * (F.col("level") / F.col("__before") - 1))
    return got.select("year", "got", "target", F.coalesce(F.abs(F.col("got") - F.col("target")) < tolerance, F.lit(False)).alias("ok"))


def require(found: DataFrame, what: str) -> None:
    """Raises if there is any row."""
    if not found.limit(1).isEmpty():
        raise PanelError("E_NULL_DATA", what)
