"""Statistics of return series in long form (``series``, ``t``, ``month``, ``r``, ``rf``).

One implementation serves assets, mixes, lattice points, draws and windows: everything is grouped by
``series``. Path statistics need a series' rows in order; a series is a few hundred months, so the
window's partitions stay small however many series there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import sample as S

SQ12 = 12**0.5


def sharpe(excess_mean: Column, excess_sd: Column, n: Column) -> Column:
    return F.when((n >= 12) & (excess_sd > 0), SQ12 * excess_mean / F.nullif(excess_sd, F.lit(0.0)))


def summary(series: DataFrame) -> DataFrame:
    """Statistics that don't depend on order, in one aggregate: n, cagr, mu, vol, sharpe, cum_return. A month that loses more than everything has no growth rate: cagr is NaN."""
    agg = series.groupBy("series").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("r") < -1, F.lit(float("nan"))).otherwise(F.log1p("r"))).alias("lg"), F.product(1 + F.col("r")).alias("grown"), F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"),
        F.avg(F.col("r") - F.col("rf")).alias("em"), F.stddev_samp(F.col("r") - F.col("rf")).alias("esd"),
    )
    return agg.select(
        "series", "n", F.expm1(12 * F.col("lg") / F.col("n")).alias("cagr"), (12 * F.col("m")).alias("mu"), (SQ12 * F.col("sd")).alias("vol"),
        sharpe(F.col("em"), F.col("esd"), F.col("n")).alias("sharpe"), (F.col("grown") - 1).alias("cum_return"),
    )


def wealth(series: DataFrame, start_month: str | None = None) -> DataFrame:
    """Wealth from 1 at t = 0, its running peak (the earliest month that reached it), and the drawdown."""
    upto = W.partitionBy("series").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    df = series.withColumn("wealth", F.product(1 + F.col("r")).over(upto))
    top = F.greatest(F.struct(F.lit(1.0).alias("w"), F.lit(0).alias("k")), F.max(F.struct(F.col("wealth").alias("w"), (-F.col("t")).alias("k"))).over(upto))
    df = df.withColumn("top", top)
    df = df.withColumn("peak", F.col("top.w")).withColumn("peak_t", -F.col("top.k")).drop("top")
    return df.withColumn("drawdown", F.col("wealth") / F.col("peak") - 1)


def path_stats(series: DataFrame, start_month: Column | None = None) -> DataFrame:
    """``summary`` with the deepest drawdown (peak, trough, recovery) and the worst twelve months.

    The peak is the earliest maximum, the trough the earliest minimum, the recovery the first month
    after the trough that reaches the peak again. Label 0 is ``start_month``.
    """
    path = wealth(series)
    order = W.partitionBy("series").orderBy("t")
    before = F.when(F.col("t") > 12, F.lag("wealth", 12).over(order)).when(F.col("t") == 12, F.lit(1.0))
    path = path.withColumn("year", F.col("wealth") / before - 1)
    deep = path.groupBy("series").agg(
        F.min(F.struct("drawdown", "t", "peak_t", "peak")).alias("d"),
        F.min(F.when(F.col("year").isNotNull(), F.struct("year", "t"))).alias("w"),
    )
    deep = deep.select("series", F.least(F.lit(0.0), "d.drawdown").alias("mdd"), F.when(F.col("d.drawdown") < 0, F.col("d.t")).otherwise(0).alias("trough_t"), F.when(F.col("d.drawdown") < 0, F.col("d.peak_t")).otherwise(0).alias("peak_t"), F.col("d.peak").alias("peak_w"), F.col("w.year").alias("worst12m"), F.col("w.t").alias("worst_t"))
    months = path.select("series", "t", "month", "wealth").join(deep, "series")
    label = lambda c: F.max(F.when(F.col("t") == F.col(c), F.col("month")))
    later = (F.col("mdd") < 0) & (F.col("t") > F.col("trough_t")) & (F.col("wealth") >= F.col("peak_w") * (1 - 1e-12))
    found = months.groupBy("series").agg(
        F.first("mdd").alias("mdd"), label("peak_t").alias("mdd_peak"), label("trough_t").alias("mdd_trough"), F.first("trough_t").alias("trough_t"),
        F.min(F.when(later, F.col("t"))).alias("rec_t"), F.min(F.when(later, F.col("month"))).alias("mdd_recovery"),
        F.first("worst12m").alias("worst12m"), label("worst_t").alias("worst12m_end"),
    )
    found = found.withColumn("recovery_months", F.col("rec_t") - F.col("trough_t")).drop("rec_t", "trough_t")
    if start_month is not None:
        found = found.withColumns({c: F.coalesce(c, start_month) for c in ("mdd_peak", "mdd_trough")})
    return summary(series).join(found, "series")


def moments(sample: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Annualised means and covariances of the three assets, raw and over cash, one row (or one a group); wide samples."""
    names = ("ndx", "spx", "ust")
    out = [F.count("*").alias("n"), (12 * F.avg("rf")).alias("rf_ann")]
    for a in names:
        out += [(12 * F.avg(f"r_{a}")).alias(f"mu_{a}"), (12 * F.avg(F.col(f"r_{a}") - F.col("rf"))).alias(f"mux_{a}")]
    for i, a in enumerate(names):
        for b in names[i:]:
            out.append((12 * F.covar_samp(f"r_{a}", f"r_{b}")).alias(f"cov_{a}_{b}"))
            out.append((12 * F.covar_samp(F.col(f"r_{a}") - F.col("rf"), F.col(f"r_{b}") - F.col("rf"))).alias(f"covx_{a}_{b}"))
    if "dgs10" in sample.columns:
        out.append(S.annual_yield(F.max_by("dgs10", "t")).alias("y10"))  # the sample's last yield, as a year's return
    return sample.groupBy(*(by or [])).agg(*out)


def tracking(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Tracking error, active return and information ratio of ``r`` against ``rb``."""
    active = F.col("r") - F.col("rb")
    agg = pairs.groupBy(*by).agg((SQ12 * F.stddev_samp(active)).alias("te"), (12 * F.avg(active)).alias("active_mu"))
    return agg.withColumn("ir", F.when(F.col("te") > 0, F.col("active_mu") / F.nullif("te", F.lit(0.0))))


def alpha_beta(sample: DataFrame, y: str = "r_ndx", x: str = "r_spx", lags: int = 12) -> DataFrame:
    """OLS of excess returns with a Newey-West t-statistic (Bartlett weights, no degrees-of-freedom correction).

    The lagged products are one window over the sample and one aggregate.
    """
    df = sample.select("t", (F.col(y) - F.col("rf")).alias("y"), (F.col(x) - F.col("rf")).alias("x"))
    fit = df.agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.regr_slope("y", "x").alias("beta"), F.regr_intercept("y", "x").alias("alpha"), F.regr_r2("y", "x").alias("r2"))
    rows = df.join(F.broadcast(fit), F.lit(True))  # one row
    rows = rows.withColumn("u", F.col("y") - F.col("alpha") - F.col("beta") * F.col("x")).withColumn("v", F.col("x") * F.col("u"))
    order = W.partitionBy().orderBy("t")
    sums = []
    for k in range(lags + 1):
        u, v = F.lag("u", k).over(order), F.lag("v", k).over(order)
        rows = rows.withColumns({f"a{k}": F.col("u") * u, f"b{k}": F.col("u") * v + F.col("v") * u, f"c{k}": F.col("v") * v})
        weight = 1.0 if k == 0 else 2 * (1 - k / (lags + 1))
        half = 0.5 if k == 0 else (1 - k / (lags + 1))
        sums.append((weight * F.coalesce(F.sum(f"a{k}"), F.lit(0.0)), half * F.coalesce(F.sum(f"b{k}"), F.lit(0.0)), weight * F.coalesce(F.sum(f"c{k}"), F.lit(0.0))))
    s00, s01, s11 = (sum((s[i] for s in sums[1:]), sums[0][i]) for i in range(3))
    one = rows.agg(*(F.first(c).alias(c) for c in ("n", "sx", "sxx", "alpha", "beta", "r2")), s00.alias("s00"), s01.alias("s01"), s11.alias("s11"))
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    i00, i01 = F.col("sxx") / det, -F.col("sx") / det
    v00 = i00 * i00 * F.col("s00") + 2 * i00 * i01 * F.col("s01") + i01 * i01 * F.col("s11")
    return one.select("n", "alpha", (12 * F.col("alpha")).alias("alpha_ann"), "beta", (F.col("alpha") / F.sqrt(v00)).alias("t_alpha"), "r2")


def vol_matched(sample: DataFrame) -> DataFrame:
    """The first asset mixed with cash to the second one's excess volatility: (``series``, ``t``, ``month``, ``r``, ``rf``, ``a``)."""
    a = sample.agg((F.stddev_samp(F.col("r_spx") - F.col("rf")) / F.nullif(F.stddev_samp(F.col("r_ndx") - F.col("rf")), F.lit(0.0))).alias("a"))
    mixed = F.col("a") * F.col("r_ndx") + (1 - F.col("a")) * F.col("rf")
    return sample.join(F.broadcast(a), F.lit(True)).select(F.lit("vol_matched").alias("series"), "t", "month", mixed.alias("r"), "rf", "a")


def quantile(column: str, p: float) -> Column:
    """Interpolated quantile (type 7) as an exact aggregate."""
    return F.percentile(column, F.lit(p))


def upper_median(column: str) -> Column:
    """The element at floor(n / 2) of the sorted values: not the interpolated median."""
    return F.expr(f"get(sort_array(collect_list({column})), cast(floor(count({column}) / 2) as int))")


def domain(df: DataFrame, columns: list[str]) -> DataFrame:
    """Least and largest value of each column, 0 always between."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select("x.*")
    return long.groupBy("column").agg(F.least(F.lit(0.0), F.min("v")).alias("lo"), F.greatest(F.lit(0.0), F.max("v")).alias("hi"))


def column_coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """First and last month and number of values of each column that has any: one unpivot, one aggregate."""
    long = df.select("month", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select("month", "x.*")
    return long.filter("v is not null").groupBy("column").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.count("*").alias("n"))
