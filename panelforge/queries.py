"""Registered queries over the panel, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import months, numbers, rng
from .operators import compare, resample, rules, solvers, stats, tables, windows
from .operators import sample as S
from .sources import files, vendor
from .sources.panel import first_latest, monthly_levels, panel_from_trades, yield_at

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
START, YEARS, LOOKBACK, DRAWS, STEPS = "1995-06", 3, 36, 1000, 100  # windows of 3 years as the tables hold seven


def rounded(df: DataFrame, places: int = 8) -> DataFrame:
    """Doubles rounded, counts as bigint: sums are in another order in another engine."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), places) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, places: int = 8):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir), places)
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


def r(expr: str, name: str, places: int = 8) -> str:
    return f"round({expr}, {places}) + 0.0 as {name}"


def rr(names: str, places: int = 8) -> str:
    return ", ".join(r(n, n, places) for n in names.split())


PANEL = """
lv as (select strftime(l_shipdate, '%Y-%m') as month, l_returnflag as flag, sum(cast(l_extendedprice as decimal(18,2)))::double / count(l_extendedprice) as level,
  sum(cast(l_discount as decimal(18,2)))::double / count(l_discount) / 12 as income, sum(cast(l_quantity as decimal(18,2)))::double / count(l_quantity) as pe,
  sum(cast(l_tax as decimal(18,2))) as tax_sum, count(l_tax) as tax_n from lineitem group by all),
wide as (select month, max(level) filter (where flag = 'N') as NDX, max(level) filter (where flag = 'A') as SPX, max(level) filter (where flag = 'R') as OTHER,
  max(income) filter (where flag = 'N') as inc_ndx, max(income) filter (where flag = 'A') as inc_spx, max(pe) filter (where flag = 'N') as ndx_pe, max(pe) filter (where flag = 'A') as spx_pe,
  sum(tax_sum)::double / sum(tax_n) as dgs10 from lv group by month),
lagged as (select *, row_number() over (order by month) - 1 as t, cast(substr(month, 1, 4) as int) * 12 + cast(substr(month, 6, 2) as int) - 1 as mi,
  lag(NDX) over (order by month) as n0, lag(SPX) over (order by month) as s0, lag(dgs10) over (order by month) as y0
  from wide where NDX is not null and SPX is not null and OTHER is not null),
prices as (select *, NDX / n0 - 1 as ndx_pr, SPX / s0 - 1 as spx_pr, y0 / 12 as coupon, dgs10 / 12 as RF, pow(1 + dgs10 / 2, -2 * (10 - 1.0 / 12)) as disc from lagged),
bonds as (select *, y0 / dgs10 * (1 - disc) + disc - 1 as bond_pr, case when month >= '1997-01' then ndx_pr + inc_ndx end as ndx_tr, case when month >= '1996-01' then spx_pr + inc_spx end as spx_tr,
  case when month < '1997-01' and t > 0 then inc_ndx end as ndx_div_default, case when month < '1996-01' then spx_pr + inc_spx end as spx_tr_con from prices),
hist as (select *, bond_pr + coupon as bond_tr, ndx_div_default * 0.75 as ndx_div_low, ndx_div_default * 1.25 as ndx_div_high,
  coalesce(ndx_tr, ndx_pr + ndx_div_default) as ndx_tr_ext, coalesce(spx_tr, spx_tr_con) as spx_tr_ext,
  case when ndx_tr is not null then 'observed' when ndx_div_default is not null then 'estimated' else '' end as ndx_tr_status,
  case when spx_tr is not null then 'observed' when spx_tr_con is not null then 'constructed' else '' end as spx_tr_status from bonds)
"""


def sample_sql(name: str = "smp", start: str | None = None, end: str | None = None, basis: str = "tr", band: str = "default", wht: float = 0.0) -> str:
    where = f"month > '{start}'" if start else "t > 0"
    where += f" and month <= '{end}'" if end else ""
    if basis == "tr":
        n, s = f"coalesce(ndx_tr, ndx_pr + ndx_div_{band})", "coalesce(spx_tr, spx_tr_con)"
        cols = f"{n} - {wht} * ({n} - ndx_pr) as r_ndx, {s} - {wht} * ({s} - spx_pr) as r_spx, bond_tr as r_ust, RF as rf, {n} - ndx_pr as div_ndx, {s} - spx_pr as div_spx"
    else:
        cols = "ndx_pr as r_ndx, spx_pr as r_spx, bond_pr as r_ust, RF as rf, 0.0::double as div_ndx, 0.0::double as div_spx"
    return f"{name} as (select month, mi, {cols}, dgs10, row_number() over (order by month) as t from hist where {where})"


def long_sql(name: str = "ser", smp: str = "smp", assets: tuple[str, ...] = ("ndx", "spx", "ust")) -> str:
    return f"{name} as (" + " union all ".join(f"select '{a}' as series, t, month, r_{a} as r, rf from {smp}" for a in assets) + ")"


def path_sql(ser: str = "ser", p: str = "") -> str:
    """CTEs that end in {p}stats: path statistics of long rows."""
    return f"""
{p}lw as (select *, product(1 + r) over (partition by series order by t rows unbounded preceding) as wealth from {ser}),
{p}pk as (select *, greatest(1.0, max(wealth) over (partition by series order by t rows unbounded preceding)) as peak,
  case when t > 12 then wealth / lag(wealth, 12) over (partition by series order by t) - 1 when t = 12 then wealth - 1 end as yr from {p}lw),
{p}dd as (select *, wealth / peak - 1 as drawdown from {p}pk),
{p}deep as (select series, least(0.0, min(drawdown)) as mdd, arg_min(t, (drawdown, t)) as tt, arg_min(peak, (drawdown, t)) as pw, min(yr) as worst12m, arg_min(t, (yr, t)) filter (where yr is not null) as wt from {p}dd group by series),
{p}lab as (select d.series, any_value(p.mdd) as mdd, any_value(p.worst12m) as worst12m, case when any_value(p.mdd) < 0 then any_value(p.tt) else 0 end as trough_t,
  min(d.t) filter (where p.mdd < 0 and d.t < p.tt and d.wealth >= p.pw * (1 - 1e-12)) as peak_t0, min(d.t) filter (where p.mdd < 0 and d.t > p.tt and d.wealth >= p.pw * (1 - 1e-12)) as rec_t,
  max(d.month) filter (where p.mdd < 0 and d.t = p.tt) as mdd_trough, max(d.month) filter (where d.t = p.wt) as worst12m_end from {p}dd d join {p}deep p using (series) group by d.series),
{p}lab2 as (select l.*, (select any_value(month) from {ser} s where s.series = l.series and s.t = l.peak_t0 and l.mdd < 0) as mdd_peak, (select any_value(month) from {ser} s where s.series = l.series and s.t = l.rec_t) as mdd_recovery, rec_t - trough_t as recovery_months from {p}lab l),
{p}sums as (select series, count(*) as n, exp(12 * sum(case when r < -1 then 'nan'::double else ln(1 + r) end) / count(*)) - 1 as cagr, 12 * avg(r) as mu, sqrt(12) * stddev_samp(r) as vol,
  case when count(*) >= 12 and stddev_samp(r - rf) > 0 then sqrt(12) * avg(r - rf) / stddev_samp(r - rf) end as sharpe, product(1 + r) - 1 as cum_return from {ser} group by series),
{p}stats as (select s.*, l.mdd, l.mdd_peak, l.mdd_trough, l.mdd_recovery, l.worst12m, l.worst12m_end, l.recovery_months from {p}sums s join {p}lab2 l using (series))"""


STAT_COLS = "series, n, " + rr("cagr mu vol sharpe cum_return mdd worst12m") + ", mdd_peak, mdd_trough, mdd_recovery, worst12m_end, recovery_months"


def with_(*ctes: str) -> str:
    return "with " + ", ".join((PANEL, *ctes))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel_from_trades(spark, sf_dir)


def smp(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    return S.build(panel(spark, sf_dir), **kw)


# ---- panel, samples
_H = "NDX SPX dgs10 ndx_pr spx_pr coupon bond_pr bond_tr RF ndx_tr spx_tr ndx_div_default ndx_div_low ndx_div_high spx_tr_con ndx_tr_ext spx_tr_ext"


@query("c_history_panel", with_() + f" select month, t, {rr(_H)}, ndx_tr_status, spx_tr_status from hist")
def history_panel(spark, d):
    return panel(spark, d).select("month", "t", *_H.split(), "ndx_tr_status", "spx_tr_status")


@query("a_monthly_levels", with_() + f" select month, flag, {rr('level income pe')} from lv")
def levels(spark, d):
    return monthly_levels(spark.read.parquet(f"{d}/lineitem.parquet")).select("month", "flag", "level", "income", "pe")


@query("a10_first_latest", with_() + " select min(month) as first_month, max(month) as latest_month, count(*) as n from hist")
def first_last(spark, d):
    return first_latest(panel(spark, d))


@query("a11_yield_at", with_() + f" select month, {rr('dgs10')} from hist where month = '1998-03'")
def yield_point(spark, d):
    return yield_at(panel(spark, d), "1998-03")


_SMP = "month, t, " + rr("r_ndx r_spx r_ust rf div_ndx div_spx dgs10")


def _plain(df: DataFrame) -> DataFrame:
    return df.select("month", "t", "r_ndx", "r_spx", "r_ust", "rf", "div_ndx", "div_spx", "dgs10")


@query("d1_sample_tr", with_(sample_sql(start=START, wht=0.15, band="low")) + f" select {_SMP} from smp")
def sample_tr(spark, d):
    return _plain(smp(spark, d, start=START, wht=0.15, band="low"))


@query("c4_sample_pr", with_(sample_sql(basis="pr", end="2000-12")) + f" select {_SMP} from smp")
def sample_pr(spark, d):
    return _plain(smp(spark, d, basis="pr", end="2000-12"))


@query("d2_sample_slice", with_(sample_sql()) + f" select month, t - 12 as t, {rr('r_ndx r_spx r_ust rf div_ndx div_spx dgs10')} from smp where t between 13 and 48")
def sample_slice(spark, d):
    return _plain(S.cut(smp(spark, d), 12, 48))


@query("d4_estimated_ranges", with_() + " select kind, min(month) as from_month, max(month) as to_month, count(*) as n from (select month, 'ndx_div' as kind from hist where t > 0 and ndx_tr is null union all select month, 'spx_con' from hist where t > 0 and spx_tr is null) group by kind")
def estimated(spark, d):
    return S.estimated_ranges(panel(spark, d))


@query("d5_calendar_returns", with_(sample_sql(), long_sql()) + f" select series, year, {rr('ret')} from (select series, substr(month, 1, 4) as year, exp(sum(ln(1 + r))) - 1 as ret, count(*) as n from ser group by all) where n = 12")
def calendar(spark, d):
    return S.calendar_returns(S.long(smp(spark, d)))


@query("c7_annual_yield", with_() + f" select month, {r('pow(1 + dgs10 / 2, 2) - 1', 'y10')}, strftime(last_day(cast(month || '-01' as date)), '%Y-%m-%d') as month_end, mi::bigint as month_index from hist")
def annual(spark, d):
    return panel(spark, d).select("month", S.annual_yield(F.col("dgs10")).alias("y10"), months.month_end(F.col("month")).cast("string").alias("month_end"), F.col("mi").alias("month_index"))


@query("j_month_arithmetic", with_() + " select month, printf('%04d-%02d', (mi + 13) // 12, (mi + 13) % 12 + 1) as later, ((select max(mi) from hist) - mi)::bigint as months_left from hist")
def month_math(spark, d):
    p = panel(spark, d)
    return p.join(F.broadcast(p.agg(F.max("month").alias("last"))), F.lit(True)).select("month", months.add_months(F.col("month"), 13).alias("later"), months.month_diff(F.col("month"), F.col("last")).alias("months_left"))


# ---- statistics
@query("f2_path_stats", with_(sample_sql(), long_sql(), path_sql()) + f" select {STAT_COLS} from stats", 7)
def path(spark, d):
    return stats.path_stats(S.long(smp(spark, d)))


ORACLE_SQL["f2_path_stats"] = ORACLE_SQL["f2_path_stats"].replace(", 8) + 0.0", ", 7) + 0.0")


@query("g1_wealth_path", with_(sample_sql(), long_sql(), path_sql()) + f" select series, t, month, {rr('wealth peak drawdown')} from dd")
def wealth_path(spark, d):
    return stats.wealth(S.long(smp(spark, d))).select("series", "t", "month", "wealth", "peak", "drawdown")


_MOM = [("mu_" + a, f"12 * avg(r_{a})") for a in S.ASSETS] + [("mux_" + a, f"12 * avg(r_{a} - rf)") for a in S.ASSETS]
_MOM += [(f"cov_{a}_{b}", f"12 * covar_samp(r_{a}, r_{b})") for i, a in enumerate(S.ASSETS) for b in S.ASSETS[i:]]
_MOM += [(f"covx_{a}_{b}", f"12 * covar_samp(r_{a} - rf, r_{b} - rf)") for i, a in enumerate(S.ASSETS) for b in S.ASSETS[i:]]


@query("f7_moments", with_(sample_sql()) + " select count(*) as n, " + r("pow(1 + arg_max(dgs10, t) / 2, 2) - 1", "y10") + ", " + r("12 * avg(rf)", "rf_ann") + ", " + ", ".join(r(e, n) for n, e in _MOM) + " from smp")
def moments(spark, d):
    return stats.moments(smp(spark, d))


@query("f8_tracking", with_(sample_sql()) + f" select asset, {rr('te active_mu ir')} from (select asset, sqrt(12) * stddev_samp(x) as te, 12 * avg(x) as active_mu, 12 * avg(x) / (sqrt(12) * stddev_samp(x)) as ir from (select 'ndx' as asset, r_ndx - r_spx as x from smp union all select 'ust', r_ust - r_spx from smp) group by asset)", 7)
def tracking(spark, d):
    s = smp(spark, d)
    pairs = S.long(s, ("ndx", "ust")).join(F.broadcast(s.select("t", F.col("r_spx").alias("rb"))), "t")
    return stats.tracking(pairs, ["series"]).withColumnRenamed("series", "asset")


ORACLE_SQL["f8_tracking"] = ORACLE_SQL["f8_tracking"].replace(", 8) + 0.0", ", 7) + 0.0")

_NW = ", ".join(f"coalesce(sum(u * lag{k}u), 0) as a{k}, coalesce(sum(u * lag{k}v + v * lag{k}u), 0) as b{k}, coalesce(sum(v * lag{k}v), 0) as c{k}" for k in range(13))
_LAGS = ", ".join(f"lag(u, {k}) over (order by t) as lag{k}u, lag(v, {k}) over (order by t) as lag{k}v" for k in range(13))
_S = {c: " + ".join((f"{c}0 * {0.5 if c == 'b' else 1.0}" if k == 0 else f"{(1 if c == 'b' else 2) * (1 - k / 13)!r} * {c}{k}") for k in range(13)) for c in "abc"}


@query(
    "f9_alpha_beta_newey_west",
    with_(
        sample_sql(),
        "ex as (select t, r_ndx - rf as y, r_spx - rf as x from smp)",
        "fit as (select count(*) as n, sum(x) as sx, sum(x * x) as sxx, regr_slope(y, x) as beta, regr_intercept(y, x) as alpha, regr_r2(y, x) as r2 from ex)",
        "res as (select t, x, y - alpha - beta * x as u, x * (y - alpha - beta * x) as v from ex, fit)",
        f"lags as (select *, {_LAGS} from res)",
        f"sums as (select {_NW} from lags)",
        f"sw as (select {_S['a']} as s00, {_S['b']} as s01, {_S['c']} as s11 from sums)",
        "vv as (select fit.*, sxx / (n * sxx - sx * sx) as i00, -sx / (n * sxx - sx * sx) as i01, sw.* from fit, sw)",
    )
    + f" select n, {r('alpha', 'alpha')}, {r('12 * alpha', 'alpha_ann')}, {r('beta', 'beta')}, {r('alpha / sqrt(i00 * i00 * s00 + 2 * i00 * i01 * s01 + i01 * i01 * s11)', 't_alpha', 6)}, {r('r2', 'r2')} from vv",
)
def alpha_beta(spark, d):
    return stats.alpha_beta(smp(spark, d)).withColumn("t_alpha", F.round("t_alpha", 6))


@query("c12_vol_matched", with_(sample_sql(), "a as (select stddev_samp(r_spx - rf) / stddev_samp(r_ndx - rf) as a from smp)") + f" select t, month, {r('a * r_ndx + (1 - a) * rf', 'r')}, {r('a', 'a')}, a > 1 as levered from smp, a")
def vol_matched(spark, d):
    return stats.vol_matched(smp(spark, d)).select("t", "month", "r", "a", (F.col("a") > 1).alias("levered"))


@query("f10_quantiles", with_(sample_sql(), long_sql()) + " select series, " + ", ".join(r(f"quantile_cont(r, {p})", f"q{round(1000 * p)}") for p in (0.025, 0.1, 0.5, 0.9, 0.975)) + " from ser group by series")
def quantiles(spark, d):
    return S.long(smp(spark, d)).groupBy("series").agg(*(stats.quantile("r", p).alias(f"q{round(1000 * p)}") for p in (0.025, 0.1, 0.5, 0.9, 0.975)))


@query("f13_domain", with_(sample_sql()) + " select col as \"column\", " + r("least(0, min(v))", "lo") + ", " + r("greatest(0, max(v))", "hi") + " from (select 'rf' as col, rf as v from smp union all select 'r_ndx', r_ndx from smp) group by col")
def domain(spark, d):
    return stats.domain(smp(spark, d), ["rf", "r_ndx"])


@query("f14_column_coverage", with_() + " select col as \"column\", min(month) as first_month, max(month) as last_month, count(*) as n from (" + " union all ".join(f"select month, '{c}' as col, {c} as v from hist" for c in ("NDX", "ndx_tr", "spx_tr", "ndx_div_low", "spx_tr_con")) + ") where v is not null group by col")
def column_coverage(spark, d):
    return stats.column_coverage(panel(spark, d), ["NDX", "ndx_tr", "spx_tr", "ndx_div_low", "spx_tr_con"])


@query("f15_upper_median", with_() + " select " + r("list_sort(list(g))[cast(floor(count(g) / 2) as int) + 1]", "g") + " from (select abs(NDX / (ndx_pe * 1500) - 1) as g from hist)")
def upper_median(spark, d):
    return panel(spark, d).select(F.abs(F.col("NDX") / (F.col("ndx_pe") * 1500) - 1).alias("x")).agg(stats.upper_median("x").alias("g"))


@query("f16_mix_growth", with_(sample_sql()) + f" select series, {rr('cagr')} from (" + " union all ".join(f"select '{k}' as series, exp(12 * avg(ln(1 + {w[0]} * r_ndx + {w[1]} * r_spx + {w[2]} * r_ust))) - 1 as cagr from smp" for k, w in solvers.REFERENCES.items()) + ")")
def mix_growth(spark, d):
    return stats.summary(S.mix(smp(spark, d), solvers.references(spark))).select("series", "cagr")


@query("c9_levered_returns", with_(sample_sql()) + f" select t, month, {r('1.5 * (0.5 * r_ndx + 0.5 * r_ust) - 0.5 * rf - 0.5 * 0.005 / 12', 'r')} from smp")
def levered(spark, d):
    ws = spark.createDataFrame([("x", 0.5, 0.0, 0.5, 1.5, 0.005)], "series string, w_ndx double, w_spx double, w_ust double, L double, spread double")
    return S.mix(smp(spark, d), ws, leverage=True).select("t", "month", "r")


# ---- windows, islands, joins
_ROLL = with_(
    sample_sql(),
    f"""st as (select t as k, count(*) over w as n, last_value(month) over w as end_month, sum(ln(1 + r_ndx)) over w as gn, sum(ln(1 + r_spx)) over w as gs,
  stddev_samp(r_spx - rf) over w / stddev_samp(r_ndx - rf) over w as a, lag(month) over (order by t) as before from smp window w as (order by t rows between current row and {12 * YEARS - 1} following))""",
    f"vm as (select k, sum(ln(1 + a * r_ndx + (1 - a) * rf)) as gv from st join smp on t between k and k + {12 * YEARS - 1} where n = {12 * YEARS} group by k)",
    f"roll as (select k, coalesce(before, (select min(month) from hist)) as start_month, end_month, exp(12 * gn / {12 * YEARS}) - exp(12 * gs / {12 * YEARS}) as excess, exp(12 * gv / {12 * YEARS}) - exp(12 * gs / {12 * YEARS}) as matched from st join vm using (k))",
)


def _roll(spark, d):
    p = panel(spark, d)
    first = p.filter("t = 0").first()["month"]
    return windows.rolling_excess(S.build(p), YEARS, first)


@query("g6_rolling_excess", _ROLL + f" select k, start_month, end_month, {rr('excess matched')} from roll")
def rolling(spark, d):
    return _roll(spark, d)


@query("f12_rolling_summary", _ROLL + f" select count(*) as n_windows, count(*) filter (where excess > 0) as n_win, {r('avg((excess > 0)::int)', 'win_rate')}, {r('quantile_cont(excess, 0.5)', 'median')}, {r('quantile_cont(excess, 0.1)', 'p10')}, {r('quantile_cont(excess, 0.9)', 'p90')}, {r('min(excess)', 'worst')}, arg_min(start_month, (excess, k)) as worst_start, count(*) filter (where excess <= 0) as n_lose, {r('avg((matched > 0)::int)', 'vm_win_rate')} from roll")
def rolling_sum(spark, d):
    return windows.rolling_summary(_roll(spark, d))


@query("g11_losing_runs", _ROLL + ", lose as (select start_month, cast(substr(start_month, 1, 4) as int) * 12 + cast(substr(start_month, 6, 2) as int) - 1 as mi from roll where excess <= 0), op as (select *, coalesce(case when mi - lag(mi) over (order by mi) - 1 > 2 then 1 else 0 end, 1) as o, lag(mi) over (order by mi) as l from lose), rn as (select *, sum(case when l is null then 1 else o end) over (order by mi rows unbounded preceding) as run from op) select min(start_month) as from_month, max(start_month) as to_month, count(*) as n from rn group by run")
def losing(spark, d):
    return windows.losing_runs(_roll(spark, d), max_gap=2)


@query("g7_relative_wealth", with_(sample_sql()) + f" select t, month, {r('exp(sum(ln(1 + r_ndx) - ln(1 + r_spx)) over (order by t rows unbounded preceding))', 'ratio')} from smp")
def rel_wealth(spark, d):
    return windows.relative_wealth(smp(spark, d))


_COV = with_("kinds as (select t, month, 'NDX' as id, 'observed' as status from hist union all select t, month, 'SPX', 'observed' from hist union all select t, month, 'NDX_TR', case when ndx_tr is not null then 'observed' when ndx_div_default is not null then 'estimated' end from hist union all select t, month, 'SPX_TR', case when spx_tr is not null then 'observed' when t > 0 and spx_tr_con is not null then 'constructed' end from hist union all select t, month, 'UST', case when bond_tr is not null then 'model' end from hist)", "isl as (select *, t - row_number() over (partition by id, status order by t) as g from kinds where status is not null)", "segs as (select id, status, min(month) as from_month, max(month) as to_month, count(*) as n from isl group by id, status, g)")


@query("g12_coverage_segments", _COV + " select * from segs")
def cover(spark, d):
    return windows.coverage(panel(spark, d))


@query("f21_ranges_by_status", _COV + " select id, status, string_agg(from_month || '～' || to_month, ', ' order by from_month) as ranges from segs group by id, status")
def ranges(spark, d):
    return windows.by_status(windows.coverage(panel(spark, d)))


@query("g10_stale_runs", "with o as (select o_custkey, o_orderkey, o_orderstatus, o_totalprice, lag(o_orderstatus) over w as s0, lag(o_totalprice) over w as p0 from orders window w as (partition by o_custkey order by o_orderkey)), f as (select *, coalesce((case when s0 = o_orderstatus and abs(ln(o_totalprice) - ln(p0)) > 0.02 then 1 else 0 end), 0) as onn from o), b as (select *, sum(1 - onn) over (partition by o_custkey order by o_orderkey rows unbounded preceding) as blk from f), u as (select *, sum(onn) over (partition by o_custkey, blk order by o_orderkey rows unbounded preceding) as run from b) select o_custkey, o_orderkey, cast(run as bigint) as run from u where run = 3")
def stale(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").withColumn("code", F.ascii("o_orderstatus").cast("double"))
    return windows.repeats_run(o, "o_orderkey", "code", "o_totalprice", by=["o_custkey"]).select("o_custkey", "o_orderkey", F.col("run").cast("long").alias("run"))


@query("e8_as_of", with_(sample_sql(), "ev as (select month as m0, r_ndx as held from smp where month like '%-01')") + f" select month, {r('held', 'held')} from smp asof left join ev on smp.month >= ev.m0")
def as_of(spark, d):
    s = smp(spark, d)
    return windows.as_of(s.select("month"), windows.january(s).select("month", F.col("r_ndx").alias("held")), "month", ["held"])


@query("e9_nearest_month", with_("usable as (select month, mi from hist where mi % 7 = 0)", "cand as (select h.month as wanted, u.month as found, u.mi - h.mi as gap from hist h join usable u on abs(u.mi - h.mi) <= 2)", "best as (select wanted, arg_min(found, (abs(gap), gap)) as month, arg_min(gap, (abs(gap), gap)) as gap from cand group by wanted)") + " select h.month as wanted, b.month, cast(b.gap as bigint) as gap from hist h left join best b on h.month = b.wanted")
def nearest(spark, d):
    p = panel(spark, d)
    return windows.nearest(p.select("month"), p.filter("mi % 7 = 0").select("month"), 2)


ENDS = ["1995-01", "1996-12", "1998-12", "2000-12", "2001-10"]
_PER = "per as (select * from (values " + ", ".join(f"('{i}', '{a}', '{b}')" for i, a, b in compare.chained(ENDS)) + ") v(id, from_month, to_month))"


@query(
    "n2_period_table",
    with_(sample_sql(), _PER, "x as (select p.id as period, s.* from smp s join per p on s.month > p.from_month and s.month <= p.to_month)", "ser as (select period || '|ndx' as series, row_number() over (partition by period order by t) as t, month, r_ndx as r, rf from x union all select period || '|spx', row_number() over (partition by period order by t), month, r_spx, rf from x)", path_sql(), "pv as (select split_part(series, '|', 1) as period, split_part(series, '|', 2) as asset, * from stats)")
    + " select period, max(n) as n, " + ", ".join(r(f"max({c}) filter (where asset = '{a}')", f"{a}_{k}", 7) for a in ("ndx", "spx") for k, c in (("cagr", "cagr"), ("cum", "cum_return"), ("mdd", "mdd")))
    + ", " + ", ".join(r(f"case when max(n) >= 36 then max(sharpe) filter (where asset = '{a}') end", f"{a}_sharpe", 7) for a in ("ndx", "spx"))
    + ", max(n) < 36 as short, " + r("max(cagr) filter (where asset = 'ndx') - max(cagr) filter (where asset = 'spx')", "spread", 7) + " from pv group by period",
    7,
)
def period_table(spark, d):
    return compare.period_table(smp(spark, d), compare.periods(spark, compare.chained(ENDS)))


_VAR = [("tr", "default"), ("tr", "low"), ("tr", "high"), ("pr", "default")]


@query(
    "n1_head_to_head",
    with_(*(sample_sql(f"s{i}", basis=b, band=v) for i, (b, v) in enumerate(_VAR)), "u as (" + " union all ".join(f"select '{b}_{v}' as variant, * from s{i}" for i, (b, v) in enumerate(_VAR)) + ")", "g as (select variant, " + ", ".join(f"exp(12 * avg(ln(1 + r_{a}))) - 1 as {a}_cagr, sqrt(12) * stddev_samp(r_{a}) as {a}_vol, sqrt(12) * avg(r_{a} - rf) / stddev_samp(r_{a} - rf) as {a}_sharpe" for a in ("ndx", "spx")) + " from u group by variant)")
    + f" select variant, {rr('ndx_cagr ndx_vol ndx_sharpe spx_cagr spx_vol spx_sharpe', 7)}, {r('ndx_cagr - spx_cagr', 'diff_cagr', 7)}, {r('ndx_sharpe - spx_sharpe', 'diff_sharpe', 7)} from g",
    7,
)
def head_to_head(spark, d):
    return compare.head_to_head(panel(spark, d))


@query("h10_january_rows", with_() + f" select month, {rr('NDX')} from hist where month like '%-01'")
def january(spark, d):
    return windows.january(panel(spark, d)).select("month", "NDX")


@query("p2_year_ends", with_() + f" select month, {rr('NDX')} from hist where month like '%-12' or month = (select min(month) from hist) or month = (select max(month) from hist)")
def year_ends(spark, d):
    return windows.year_ends(panel(spark, d)).select("month", "NDX")


@query("h9_spaced_rows", with_("n as (select max(t) + 1 as n from hist)") + f" select month, t, {rr('NDX')} from hist, n where t % greatest(1, cast(ceil(n / 10.0) as int)) = 0 or t = n - 1")
def spaced(spark, d):
    return windows.spaced(panel(spark, d), "t", 10).select("month", "t", "NDX")


@query("h8_nearest_index", with_("g as (select t as i, NDX as x from hist)", "w as (select month as id, SPX as v from hist where t % 9 = 0)") + f" select id, {rr('v')}, arg_min(i, (abs(x - v), i)) as i from w, g group by id, v")
def nearest_index(spark, d):
    p = panel(spark, d)
    return windows.nearest_index(p.select(F.col("t").alias("i"), F.col("NDX").alias("x")), p.filter("t % 9 = 0").select(F.col("month").alias("id"), F.col("SPX").alias("v")))


@query("k5_interpolate", with_("pt as (select t::double as x, NDX as y, lead(t) over (order by t)::double as x1, lead(NDX) over (order by t) as y1 from hist where t % 6 = 0)", "w as (select t + 0.25 as v from hist where t % 5 = 0)") + " select " + r("v::double", "v") + ", " + r("case when x1 is null then y else y + (y1 - y) * (v - x) / (x1 - x) end", "y") + " from w left join pt on v >= x and (v < x1 or (x1 is null and v = x))")
def interpolate(spark, d):
    p = panel(spark, d)
    return windows.interpolate(p.filter("t % 6 = 0").select(F.col("t").cast("double").alias("x"), F.col("NDX").alias("y")), p.filter("t % 5 = 0").select((F.col("t") + 0.25).cast("double").alias("v")))


@query("k1_last_in_month", "select strftime(ts, '%Y-%m') as month, event_type as key, round(arg_max(value, (ts, event_id)), 8) + 0.0 as value from events group by all")
def last_in_month(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("key"), F.col("ts").alias("at"), "value", F.col("event_id").alias("seq"))
    return windows.last_in_month(e)


@query("k4_bill_return", with_() + f" select month, {r('1 / (1 - dgs10 * 30 / 360) - 1', 'rf')} from hist")
def bill(spark, d):
    return panel(spark, d).select("month", (1 / (1 - F.col("dgs10") * 30 / 360) - 1).alias("rf"))


@query("i6_merge_near", places=10)
def merge_near(spark, d):
    p = smp(spark, d).select(F.col("month").alias("id"), F.round("r_spx", 6).alias("x"))
    return windows.merge_near(p, 2e-3)


@query("i_set_operations", with_() + " select 'intersect' as op, count(*) as n from (select month from hist where ndx_tr is null intersect select month from hist where spx_tr is not null) union all select 'except', count(*) from (select month from hist except select month from hist where t % 2 = 0) union all select 'union', count(*) from (select month from hist where t < 9 union select month from hist where t < 5)")
def set_operations(spark, d):
    p = panel(spark, d)
    one = lambda name, df: df.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
    m = lambda cond: p.filter(cond).select("month")
    return one("intersect", m("ndx_tr is null").intersect(m("spx_tr is not null"))).unionByName(one("except", p.select("month").exceptAll(m("t % 2 = 0")))).unionByName(one("union", m("t < 9").union(m("t < 5")).distinct()))


@query("b10_append_months", with_() + f" select month, {rr('NDX SPX')} from hist")
def append(spark, d):
    p = panel(spark, d).select("month", "NDX", "SPX")
    return files.append_months(p.filter("month <= '2000-06'"), p.filter("month > '2000-01'"), ["NDX", "SPX"])


@query("d3_e3_notes_in_sample", with_(sample_sql(start="1996-06")) + " select note, month from (select 'odd level' as note, month from hist where t % 11 = 0) where month in (select month from smp)")
def notes(spark, d):
    p = panel(spark, d)
    return S.notes_in(p.filter("t % 11 = 0").select(F.lit("odd level").alias("note"), "month"), S.build(p, "1996-06")).select("note", "month")


# ---- lattices and rules
_LAT = with_(sample_sql(), f"ij as (select i::bigint as i, j::bigint as j from range({STEPS + 1}) a(i), range({STEPS + 1}) b(j) where i + j <= {STEPS})", f"ser as (select i || '-' || j as series, t, month, i / {STEPS}.0 * r_ndx + j / {STEPS}.0 * r_spx + ({STEPS} - i - j) / {STEPS}.0 * r_ust as r, rf, i, j from ij, smp)", "lw as (select *, exp(sum(ln(1 + r)) over (partition by series order by t rows unbounded preceding)) as w from ser)", "dd as (select *, w / greatest(1.0, max(w) over (partition by series order by t rows unbounded preceding)) - 1 as dd from lw)", "lat as (select i, j, exp(12 * avg(ln(1 + r))) - 1 as cagr, sqrt(12) * avg(r - rf) / stddev_samp(r - rf) as sharpe, sqrt(12) * stddev_samp(r) as vol, least(0.0, min(dd)) as mdd from dd group by i, j)")


@query("f19_ternary_lattice", _LAT + f" select i, j, {rr('cagr sharpe vol mdd', 7)} from lat", 7)
def lattice(spark, d):
    return solvers.lattice(smp(spark, d), STEPS)


@query("h1_lattice_best", _LAT + f" select i, j, {rr('cagr sharpe vol mdd', 7)} from (select *, row_number() over (order by round(sharpe, 10) desc, i, j) as k from lat where cagr >= (select cagr from lat where j = {STEPS}) - 1e-12) where k = 1", 7)
def lattice_best(spark, d):
    return solvers.lattice_best(solvers.lattice(smp(spark, d), STEPS), STEPS)


@query("p5_ternary_table", _LAT + f" select i, j, {rr('cagr sharpe vol mdd', 7)} from lat where i % 4 = 0 and j % 4 = 0", 7)
def ternary_table(spark, d):
    return tables.ternary_table(solvers.lattice(smp(spark, d), STEPS), STEPS, 4)


_CURVE = with_(sample_sql(), "ser as (select k::bigint as k, t, k / 1000.0 * r_ndx + (1 - k / 1000.0) * r_ust as r, rf from range(1001) a(k), smp)", "lw as (select *, exp(sum(ln(1 + r)) over (partition by k order by t rows unbounded preceding)) as w from ser)", "dd as (select *, w / greatest(1.0, max(w) over (partition by k order by t rows unbounded preceding)) - 1 as dd from lw)")


@query("l19_two_asset_curve", _CURVE + f" select k, {r('k / 1000.0', 'x')}, {r('exp(12 * avg(ln(1 + r))) - 1', 'cagr', 7)}, {r('sqrt(12) * avg(r - rf) / stddev_samp(r - rf)', 'sharpe', 7)}, {r('sqrt(12) * stddev_samp(r)', 'vol', 7)}, {r('least(0.0, min(dd))', 'mdd', 7)} from dd group by k", 7)
def curve(spark, d):
    return solvers.two_asset_curve(smp(spark, d), (0, 2), 1000)


ORACLE_SQL["l19_two_asset_curve"] = ORACLE_SQL["l19_two_asset_curve"].replace("round(k / 1000.0, 8)", "round(k / 1000.0, 7)")


@query("l21_reference_portfolios", with_(sample_sql(), "ser as (" + " union all ".join(f"select '{k}' as series, t, month, {w[0]} * r_ndx + {w[1]} * r_spx + {w[2]} * r_ust as r, rf from smp" for k, w in {**solvers.REFERENCES, "__spx": (0.0, 1.0, 0.0)}.items()) + ")", path_sql(), "bench as (select * from stats where series = '__spx')", "te as (select s.series, sqrt(12) * stddev_samp(s.r - m.r_spx) as te, 12 * avg(s.r - m.r_spx) as active_mu from ser s join smp m using (t) group by s.series)") + " select s.series, s.n, " + ", ".join(r(f"s.{c}", c, 7) for c in "cagr vol sharpe mdd worst12m".split()) + ", " + ", ".join(r(f"s.{c} - b.{c}", f"vs_{c}", 7) for c in "cagr sharpe vol mdd worst12m".split()) + ", " + r("te", "te", 7) + ", " + r("active_mu", "active_mu", 7) + " from stats s join te on s.series = te.series cross join bench b where s.series <> '__spx'", 7)
def portfolios(spark, d):
    out = solvers.evaluate(smp(spark, d), solvers.references(spark))
    return out.select("series", "n", "cagr", "vol", "sharpe", "mdd", "worst12m", *(f"vs_{c}" for c in ("cagr", "sharpe", "vol", "mdd", "worst12m")), "te", "active_mu")


@query("h5_largest_remainder", with_(sample_sql(), "w as (select month, abs(r_ndx) / s as a, abs(r_spx) / s as b, abs(r_ust) / s as c from (select *, abs(r_ndx) + abs(r_spx) + abs(r_ust) as s from smp))", "x as (select month, [round(a * 100, 9), round(b * 100, 9), round(c * 100, 9)] as v from w)", "f as (select month, [floor(v[1]), floor(v[2]), floor(v[3])] as b, v from x)", "m as (select *, 100 - (b[1] + b[2] + b[3]) as miss, [v[1] - b[1], v[2] - b[2], v[3] - b[3]] as e from f)") + " select month, cast(b[1] + (((e[2] > e[1])::int + (e[3] > e[1])::int) < miss)::int as bigint) as p_a, cast(b[2] + (((e[1] >= e[2])::int + (e[3] > e[2])::int) < miss)::int as bigint) as p_b, cast(b[3] + (((e[1] >= e[3])::int + (e[2] >= e[3])::int) < miss)::int as bigint) as p_c from m")
def remainder(spark, d):
    s = smp(spark, d)
    whole = F.abs("r_ndx") + F.abs("r_spx") + F.abs("r_ust")
    ws = s.select("month", (F.abs("r_ndx") / whole).alias("a"), (F.abs("r_spx") / whole).alias("b"), (F.abs("r_ust") / whole).alias("c"))
    return solvers.apportion(ws, ["a", "b", "c"]).select("month", "p_a", "p_b", "p_c")


def _moments(spark, d):
    return stats.moments(smp(spark, d))


@query("l12_iso_vol_te")
def iso(spark, d):
    return solvers.iso_vol(_moments(spark, d), [])


@query("l12_iso_vol_path")
def iso_path(spark, d):
    return solvers.iso_vol_path(_moments(spark, d), [], (0.02, 0.03, 0.04, 0.05, 0.08, 0.12))


@query("l13_feasibility")
def feasible(spark, d):
    return solvers.feasibility(_moments(spark, d))


@query("l4_frontier")
def frontier(spark, d):
    return solvers.frontier(_moments(spark, d), [], 121)


@query("l5_tangency_path")
def tangency_path(spark, d):
    return solvers.tangency_path(_moments(spark, d), -0.05, 0.08, 0.0005)


@query("l7_thresholds")
def thresholds(spark, d):
    return solvers.thresholds(_moments(spark, d), -0.05, 0.08, 0.0005)


@query("l6_implied_intercept")
def implied(spark, d):
    m = _moments(spark, d)
    w = solvers.iso_vol(m, [], te_cap=None).select("w_ndx", "w_spx", "w_ust")
    return solvers.implied_intercept(m.join(w, F.lit(True)), ["w_ndx", "w_spx", "w_ust"])


@query("l11_kinked_line")
def kinked(spark, d):
    return solvers.kinked_line(_moments(spark, d), [])


@query("l15_path_objectives", places=5)
def path_objectives(spark, d):
    return solvers.optimise_path(smp(spark, d))


@query("l19_two_asset_roots")
def roots(spark, d):
    return solvers.two_asset_roots(smp(spark, d))


@query("p6_contours")
def contours(spark, d):
    points = solvers.lattice(smp(spark, d), STEPS)
    return tables.polylines(tables.contour_segments(points, STEPS, "cagr", 0.05))


# ---- random numbers, bootstraps, walk-forward
_M = 4294967296
_MUL = lambda a, b: f"(({a})::hugeint * ({b})::hugeint % {_M})"


def _rng_sql(seed: str, k: str) -> list[str]:
    """CTE steps for the k-th number of a seed, from a table src."""
    return [
        f"r1 as (select *, ({seed}::hugeint + {_MUL(k + ' + 1', str(rng.STEP))}) % {_M} as a0 from src)",
        f"r2 as (select *, {_MUL('xor(a0::bigint, a0::bigint >> 15)', 'a0::bigint | 1')} as t0 from r1)",
        f"r3 as (select *, xor(((t0 + {_MUL('xor(t0::bigint, t0::bigint >> 7)', 't0::bigint | 61')}) % {_M})::bigint, t0::bigint) as t1 from r2)",
        "rnd as (select *, xor(t1, t1 >> 14) / 4294967296.0 as u from r3)",
    ]


_SEED = f"xor(20260912::bigint, {_MUL('b + 1', str(rng.GOLDEN))}::bigint)"


@query("m1_random_numbers", "with " + ", ".join([f"src as (select b::bigint as b, k::bigint as k, {_SEED} as seed from range(50) x(b), range(40) y(k))", *_rng_sql("seed", "k")]) + " select b, k, seed, round(u, 10) as u from rnd", 10)
def random_numbers(spark, d):
    bk = spark.range(50).select(F.col("id").cast("int").alias("b")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(39))))
    return rng.with_uniform(bk.withColumn("seed", rng.draw_seed(20260912, F.col("b"))), "u", F.col("seed"), F.col("k"))


_DRAW = [
    sample_sql(),
    "cnt as (select count(*) as n, greatest(1, least(24, count(*) // 4)) as blk from smp)",
    f"src as (select b::bigint as b, m::bigint as m, n, blk, m // blk as k, {_SEED} as seed from cnt, range({DRAWS}) x(b), range(200) y(m) where m < n)",
    *_rng_sql("seed", "k"),
    "idx as (select b, m, cast((floor(u * n)::bigint + m % blk) % n + 1 as bigint) as t from rnd)",
]


@query("m4_block_indices", with_(*_DRAW) + " select b, m, t from idx")
def block_indices(spark, d):
    return resample.block_indices(spark, smp(spark, d).count(), DRAWS)


_SH = lambda c: f"sqrt(12) * avg({c} - rf) / stddev_samp({c} - rf)"


@query("m5_sharpe_difference", with_(*_DRAW, f"dd as (select b, {_SH('r_ndx')} - {_SH('r_spx')} as d from idx join smp using (t) group by b)") + f" select {r('quantile_cont(d, 0.025)', 'lo', 7)}, {r('quantile_cont(d, 0.975)', 'hi', 7)}, count(*) as draws, (select round({_SH('r_ndx')} - {_SH('r_spx')}, 7) + 0.0 from smp) as point from dd", 7)
def sharpe_difference(spark, d):
    s = smp(spark, d)
    return resample.sharpe_difference(s, s.count(), DRAWS)


@query("m7_draw_moments", with_(*_DRAW) + f" select b, {r('12 * avg(r_ndx)', 'mu_ndx')}, {r('12 * covar_samp(r_ndx, r_ust)', 'cov_ndx_ust')} from idx join smp using (t) group by b")
def draw_moments(spark, d):
    s = smp(spark, d)
    return stats.moments(resample.resampled(s, s.count(), DRAWS), ["b"]).select("b", "mu_ndx", "cov_ndx_ust")


@query("m7_bootstrap_rule")
def bootstrap(spark, d):
    s = smp(spark, d)
    return solvers.iso_vol(stats.moments(resample.resampled(s, s.count(), DRAWS), ["b"]), ["b"])


@query("f11_draws_summary")
def draws_summary(spark, d):
    s = smp(spark, d)
    return resample.summarise_draws(resample.bootstrap_rule(s, s.count(), DRAWS))


@query("m7_bootstrap_levered")
def bootstrap_levered(spark, d):
    s = smp(spark, d)
    return resample.summarise_draws(resample.bootstrap_rule(s, s.count(), DRAWS, rules.Rule(kind="tangency")), levered=True)


@query("m8_rebalance_windows", with_(sample_sql()) + f" select month as tau, t - {LOOKBACK} as lo, t - 1 as hi from smp where month like '%-01' and t > {LOOKBACK} and month > (select min(month) from smp)")
def rebalance(spark, d):
    return resample.rebalance_windows(smp(spark, d), LOOKBACK)


@query("m8_walk_forward_weights")
def walk_weights(spark, d):
    return resample.walk_forward_weights(smp(spark, d), LOOKBACK).drop("L")


@query("m8_walk_forward")
def walk(spark, d):
    return resample.walk_forward(smp(spark, d), LOOKBACK)


# ---- decomposition
_DEC = with_(
    sample_sql(),
    _PER,
    "cum as (select h.month, sum(coalesce((ln(1 + s.r_ndx) - ln(1 + h.ndx_pr)) - (ln(1 + s.r_spx) - ln(1 + h.spx_pr)), 0)) over (order by h.t rows unbounded preceding) as cum_d, h.ndx_pe / h.spx_pe as M, h.NDX / h.SPX as R, h.mi from hist h left join smp s using (month))",
    "dec0 as (select p.*, a.M as m_start, b.M as m_end, ln(b.R / a.R) as ln_r, ln(b.M / a.M) as ln_m, b.cum_d - a.cum_d as ln_d, (b.mi - a.mi) / 12.0 as years from per p join cum a on p.from_month = a.month join cum b on p.to_month = b.month)",
    "dec as (select *, ln_r - ln_m as ln_e, ln_r + ln_d as ln_t from dec0)",
)
_IDENT = ", ".join(r(e, n) for n, e in (("price_lp_yr", "100 * ln_r / years"), ("pe_lp_yr", "100 * ln_m / years"), ("eps_lp_yr", "100 * ln_e / years"), ("div_lp_yr", "100 * ln_d / years"), ("tr_lp_yr", "100 * ln_t / years"), ("f_price", "exp(ln_r)"), ("f_pe", "exp(ln_m)"), ("f_eps", "exp(ln_e)"), ("f_tr", "exp(ln_t)"), ("pe_share", "case when abs(ln_r) >= 0.1 and abs(100 * ln_r / years) >= 1 then ln_m / ln_r end"), ("eps_share", "case when abs(ln_r) >= 0.1 and abs(100 * ln_r / years) >= 1 then ln_e / ln_r end")))
_DCOLS = ["price_lp_yr", "pe_lp_yr", "eps_lp_yr", "div_lp_yr", "tr_lp_yr", "f_price", "f_pe", "f_eps", "f_tr", "pe_share", "eps_share"]


@query("n4_decomposition", _DEC + f" select id, {r('years', 'years')}, {_IDENT} from dec")
def decomposition(spark, d):
    return compare.decomposition(panel(spark, d), compare.periods(spark, compare.chained(ENDS))).select("id", "years", *_DCOLS)


@query("f18_chain_totals", _DEC + f", tot as (select sum(years) as years, sum(ln_r) as ln_r, sum(ln_m) as ln_m, sum(ln_d) as ln_d, sum(ln_e) as ln_e, sum(ln_t) as ln_t from dec) select {r('years', 'years')}, {_IDENT} from tot")
def chain_totals(spark, d):
    return compare.totals(compare.decomposition(panel(spark, d), compare.periods(spark, compare.chained(ENDS)))).select("years", *_DCOLS)


_BE = with_("e as (select min(month) as a, max(month) as b from hist)", "be as (select h1.NDX / h1.SPX as R0, h2.NDX / h2.SPX as RT, h2.ndx_pe / h2.spx_pe as m_end, ln((h2.NDX / h2.SPX) / (h1.NDX / h1.SPX)) as ln_r, (h2.mi - h1.mi) / 12.0 as years from e join hist h1 on h1.month = a join hist h2 on h2.month = b)")


@query("n5_break_even", _BE + f" select {rr('R0 RT m_end ln_r years')}, {r('m_end', 'p0')}, {r('m_end * exp(-0.25 * ln_r)', 'p25')}, {r('m_end * exp(-0.5 * ln_r)', 'p50')} from be")
def break_even(spark, d):
    return compare.break_even(panel(spark, d)).select("R0", "RT", "m_end", "ln_r", "years", "p0", "p25", "p50")


@query("n5_sensitivity", _BE + f", g as (select unnest([0.6, 0.8, 1.0, 1.2, 1.5, 1.9, 2.5, 3.0])::double as m0) select m0, {r('100 * ln(m_end / m0) / years', 'pe_lp_yr')}, {r('100 * (ln_r - ln(m_end / m0)) / years', 'eps_lp_yr')}, {r('case when abs(ln_r) >= 0.1 and abs(100 * ln_r / years) >= 1 then (ln_r - ln(m_end / m0)) / ln_r end', 'eps_share')} from be, g")
def sensitivity(spark, d):
    return compare.sensitivity(panel(spark, d))


@query("p12_rounded_terms", _DEC + ", x as (select id, round(100 * 100 * ln_r / years)::bigint as t, 100 * 100 * ln_m / years as a, 100 * 100 * ln_e / years as b from dec), y as (select *, round(a)::bigint as ra, round(b)::bigint as rb from x), z as (select *, t - ra - rb as miss, abs(ra + sign(t - ra - rb) - a) as ca, abs(rb + sign(t - ra - rb) - b) as cb from y) select id, t / 100.0 + 0.0 as s_price, (ra + case when ca <= cb then miss else 0 end) / 100.0 + 0.0 as s_pe, (rb + case when cb < ca then miss else 0 end) / 100.0 + 0.0 as s_eps from z")
def rounded_terms(spark, d):
    dec = compare.decomposition(panel(spark, d), compare.periods(spark, compare.chained(ENDS)))
    named = dec.select("id", F.col("price_lp_yr").alias("price"), F.col("pe_lp_yr").alias("pe"), F.col("eps_lp_yr").alias("eps"))
    return tables.add_up(named, "price", ["pe", "eps"], 2).select("id", "s_price", "s_pe", "s_eps")


# ---- texts, imports
@query("j_number_formats", with_(sample_sql()) + " select month, case when round(round(100 * r_ndx, 12), 1) < 0 then '−' || printf('%.1f', -round(round(100 * r_ndx, 12), 1)) else printf('%.1f', abs(round(round(100 * r_ndx, 12), 1))) end || '%' as pct, case when r_ndx > 0 then '▲' when r_ndx < 0 then '▼' else '' end as arrow from smp")
def formats(spark, d):
    return smp(spark, d).select("month", numbers.fmt_pct(F.col("r_ndx")).alias("pct"), numbers.delta_arrow(F.col("r_ndx")).alias("arrow"))


@query("b4_csv_lines", with_() + " select month || ',' || ndx_tr_status || ',' || t as line from hist")
def csv_lines(spark, d):
    return files.csv_lines(panel(spark, d), ["month", "ndx_tr_status", "t"])


def export_rows(spark: SparkSession, d: str) -> DataFrame:
    """The panel as a vendor would export it."""
    p = panel(spark, d)
    return p.select("month", months.month_end(F.col("month")).alias("date"), F.col("NDX").alias("ndx_px"), F.col("SPX").alias("spx_px"), F.col("ndx_pe"), F.col("spx_pe"), F.lit(None).cast("double").alias("ndx_eps"), F.lit(None).cast("double").alias("spx_eps"), F.lit(None).cast("double").alias("ndx_tr"), F.lit(None).cast("double").alias("spx_tr"), F.lit(None).cast("double").alias("ndx_pe_fwd"), F.lit(None).cast("double").alias("spx_pe_fwd"))


@query("o1_import_text", with_() + f" select month, strftime(last_day(cast(month || '-01' as date)), '%Y-%m-%d') as date, {rr('NDX SPX ndx_pe').replace('as NDX', 'as ndx_px').replace('as SPX', 'as spx_px')} from hist")
def import_text(spark, d):
    """The panel written as semicolon text with decimal commas and day-first dates, and parsed again."""
    p = panel(spark, d)
    num = lambda c: F.translate(F.format_string("%.10f", F.col(c)), ".", ",")
    lines = p.select((F.col("t") + 2).cast("int").alias("n"), F.concat_ws(";", F.date_format(months.month_end(F.col("month")), "dd.MM.yyyy"), num("NDX"), num("SPX"), num("ndx_pe")).alias("line"))
    head = spark.createDataFrame([(0, "# source: panel"), (1, "date;ndx_px;spx_px;ndx_pe")], "n int, line string")
    got = vendor.parse_lines(head.unionByName(lines))["rows"]
    return got.select("month", F.col("date").cast("string").alias("date"), "ndx_px", "spx_px", "ndx_pe")


def faulty_rows(spark: SparkSession, d: str) -> DataFrame:
    """An export with faults in known months, so that most rules of the validator have something to find."""
    e = export_rows(spark, d)
    at = lambda c, month, v: F.when(F.col("month") == month, v).otherwise(F.col(c))
    e = e.withColumn("date", at("date", "1995-05", F.lit("1995-05-20").cast("date"))).withColumn("ndx_pe", at("ndx_pe", "1995-07", F.lit(-2.0)))
    e = e.withColumn("spx_px", at("spx_px", "1995-09", F.lit(0.0))).withColumn("ndx_px", at("ndx_px", "1996-04", F.col("ndx_px") * 1.5)).withColumn("ndx_eps", F.col("ndx_px") / F.col("ndx_pe") * 1.01)
    return e.withColumn("spx_pe", F.when(F.col("month").between("1997-01", "1997-12"), F.lit(21.0)).otherwise(F.col("spx_pe")))


def _validate_sql() -> str:
    rows = """
fx as (select month, case when month = '1995-05' then date '1995-05-20' else cast(last_day(cast(month || '-01' as date)) as date) end as date,
  case when month = '1996-04' then NDX * 1.5 else NDX end as ndx_px, case when month = '1995-09' then 0.0 else SPX end as spx_px,
  case when month = '1995-07' then -2.0 else ndx_pe end as ndx_pe, case when month between '1997-01' and '1997-12' then 21.0 else spx_pe end as spx_pe, mi, NDX, SPX from hist),
ex as (select *, ndx_px / ndx_pe * 1.01 as ndx_eps from fx)"""
    parts = ["select 'warning' as severity, 'NOT_MONTH_END' as code, month, 'date' as key, null::double as value from ex where month(date + 4) = month(date)"]
    parts += [f"select 'warning', 'PE_NOT_POSITIVE', month, '{a}_pe', {a}_pe from ex where {a}_pe <= 0" for a in ("ndx", "spx")]
    parts += [f"select 'error', 'PRICE_NOT_POSITIVE', month, '{a}_px', {a}_px from ex where {a}_px <= 0" for a in ("ndx", "spx")]
    for a in ("ndx", "spx"):
        u = f"case when {a}_px > 0 and {a}_pe > 0 then {a}_px / {a}_pe end"
        parts.append(f"select 'warning', 'EPS_JUMP', month, '{a}_pe', v from (select month, ln(u) - lag(ln(u)) over (order by month) as v from (select month, {u} as u from ex)) where abs(v) > 0.25")
        p, p0 = f"case when {a}_px > 0 then {a}_px end", f"case when lag({a}_px) over w > 0 then lag({a}_px) over w end"
        parts.append(f"""
select 'warning', 'STALE_PE', month, '{a}_pe', pe from (select *, row_number() over (partition by g order by month) as run from (select *, sum(o) over (order by month rows unbounded preceding) as g
  from (select month, {a}_pe as pe, case when lag({a}_pe) over w = {a}_pe and {a}_pe > 0 and abs(ln({p}) - ln({p0})) > 0.02 then 0 else 1 end as o from ex window w as (order by month)))) where run = 4""")
        parts.append(f"""
select severity, 'RETURN_MISMATCH', month, '{a}_px', v from (select *, case when count(*) over () > 3 then 'error' else 'warning' end as severity from (select month, mi - lag(mi) over w as step,
  ln(p) - lag(ln(p)) over w - (ln(q) - lag(ln(q)) over w) as v from (select month, mi, {p} as p, {a.upper()} as q from ex) window w as (order by month)) where step = 1 and abs(v) > 0.005)""")
        span = f"""(select min({a}_px / {a.upper()}) as lo, max({a}_px / {a.upper()}) as hi from
  (select *, mi - lag(mi) over w as gap, lag({a}_px) over w as before from ex window w as (order by month)) where gap = 1 and {a}_px > 0 and before > 0)"""
        parts.append(f"\nselect 'warning', 'LEVEL_DRIFT', null, '{a}_px', hi / lo - 1 from {span} where abs(hi / lo - 1) > 0.02")
    gap = "(select abs(ndx_px / (ndx_pe * ndx_eps) - 1) as g from ex where ndx_pe > 0 and ndx_px > 0 and ndx_eps <> 0)"
    parts.append(f"\nselect 'info', 'CLOSURE', null, 'ndx_pe', list_sort(list(g))[cast(floor(count(g) / 2) as int) + 1] from {gap}")
    parts.append("\nselect 'status', 'PARTIAL_FROM_' || min(month), min(month), 'ndx_pe', null from ex where ndx_pe > 0 and spx_pe > 0")
    return with_(rows) + f" select severity, code, month, key, {r('value', 'value')} from ({' union all '.join(parts)})"


@query("o4_validate", _validate_sql())
def validate(spark, d):
    """Every finding of the validator on an export with faults."""
    return vendor.validate(faulty_rows(spark, d), panel(spark, d))


@query("o5_decompose_windows", _DEC + f" select id, true as computable, {r('years', 'years')}, {r('100 * ln_r / years', 'price_lp_yr')}, {r('100 * ln_m / years', 'pe_lp_yr')} from dec")
def decompose(spark, d):
    out = vendor.decompose_windows(export_rows(spark, d), compare.periods(spark, compare.chained(ENDS)), 2)
    return out.select("id", "computable", "years", "price_lp_yr", "pe_lp_yr")


@query("p18_clipped_periods", "with " + _PER + " select id, greatest(from_month, '1997-03') as from_month, least(to_month, '2000-02') as to_month from per where greatest(from_month, '1997-03') < least(to_month, '2000-02')")
def clipped(spark, d):
    return tables.clip_periods(compare.periods(spark, compare.chained(ENDS)), "1997-03", "2000-02")


@query("ext_daily_last_event", "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(arg_max(value, (ts, event_id)), 8) + 0.0 as value from events group by all")
def daily_last(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.max_by("value", F.struct("ts", "event_id")).alias("value"))


# ---- SQL of the solvers: the same geometry as candidate rows
def _quad(q: str, x: str, y: str) -> str:
    """x'Qy for vectors of columns x1..x3, y1..y3 and a symmetric matrix q11..q33."""
    return " + ".join(f"{q}{min(i, j)}{max(i, j)} * {x}{i} * {y}{j}" for i in (1, 2, 3) for j in (1, 2, 3))


def iso_sql(source: str = "iso_in", p: str = "") -> list[str]:
    """CTEs that end in {p}iso (id, w1..w3, mean, vol, te; one row an id, nulls where infeasible) from rows (id, m1..m3, s11..s33, vcap2, te2)."""
    lines = [
        f"select id, k, cap, true as edge, q11, q12, q13, q22, q23, q33, v.* from {p}cons, (values (1.0::double, 0.0::double, 0.0::double, -1.0::double, 1.0::double, 0.0::double), (1, 0, 0, -1, 0, 1), (0, 1, 0, 0, -1, 1)) v(p1, p2, p3, d1, d2, d3)",
        f"select id, k, cap, false, q11, q12, q13, q22, q23, q33, y1, y2, 1 - y1 - y2, e1, e2, -e1 - e2 from {p}ext",
        f"select i.id, 1, vcap2, false, s11, s12, s13, s22, s23, s33, (h - s22) / (s12 - s22), 1 - (h - s22) / (s12 - s22), 0.0, s23 - s22, s12 - s23, s22 - s12 from (select *, (s22 + vcap2 - te2) / 2 as h from {source}) i where te2 is not null and s12 <> s22",
    ]
    return [
        f"{p}cons as (select id, m1, m2, m3, 1 as k, vcap2 as cap, s11 as q11, s12 as q12, s13 as q13, s22 as q22, s23 as q23, s33 as q33 from {source} union all select id, m1, m2, m3, 2, te2, s11 - 2 * s12 + s22, 0.0, s13 - s12 - s23 + s22, 0.0, 0.0, s33 - 2 * s23 + s22 from {source} where te2 is not null)",
        f"{p}h as (select *, q11 - 2 * q13 + q33 as h11, q12 - q13 - q23 + q33 as h12, q22 - 2 * q23 + q33 as h22, q13 - q33 as g1, q23 - q33 as g2 from {p}cons)",
        f"{p}ext as (select *, -(h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12) as y1, -(h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) as y2, (h22 * (m1 - m3) - h12 * (m2 - m3)) / (h11 * h22 - h12 * h12) as e1, (h11 * (m2 - m3) - h12 * (m1 - m3)) / (h11 * h22 - h12 * h12) as e2 from {p}h where h11 * h22 - h12 * h12 <> 0)",
        f"{p}lines as ({' union all '.join(lines)})",
        f"{p}abc as (select *, {_quad('q', 'd', 'd')} as qa, {_quad('q', 'p', 'd')} as qb, {_quad('q', 'p', 'p')} - cap as qc from {p}lines)",
        f"{p}roots as (select id, edge, p1, p2, p3, d1, d2, d3, (-qb + sg * sqrt(qb * qb - qa * qc)) / qa as t from {p}abc, (values (1.0), (-1.0)) v(sg) where qa > 0 and qb * qb - qa * qc >= 0)",
        f"{p}cand as (select id, v.w1, v.w2, v.w3 from {source}, (values (1.0::double, 0.0::double, 0.0::double), (0, 1, 0), (0, 0, 1)) v(w1, w2, w3) union all select id, p1 + x * d1, p2 + x * d2, p3 + x * d3 from (select *, case when edge then least(1.0, greatest(0.0, t)) else t end as x from {p}roots where not edge or (t >= -1e-12 and t <= 1 + 1e-12)))",
        f"{p}okay as (select c.* from {p}cand c where least(w1, w2, w3) >= -1e-12 and not exists (select 1 from {p}cons q where q.id = c.id and not ({_quad('q.q', 'c.w', 'c.w')} - q.cap <= 1e-12)))",
        f"{p}clean as (select id, greatest(w1, 0) / s as w1, greatest(w2, 0) / s as w2, greatest(w3, 0) / s as w3 from (select *, greatest(w1, 0) + greatest(w2, 0) + greatest(w3, 0) as s from {p}okay))",
        f"{p}valued as (select c.*, w1 * m1 + w2 * m2 + w3 * m3 as mean, {_quad('s', 'w', 'w')} as var, (s12 * w1 + s22 * w2 + s23 * w3) as aw, s22 from {p}clean c join {source} using (id))",
        f"{p}best as (select *, row_number() over (partition by id order by round(mean, 12) desc, var) as rk from {p}valued)",
        f"{p}iso as (select i.id, w1, w2, w3, mean, case when w1 is not null then sqrt(greatest(var, 0)) end as vol, case when w1 is not null then sqrt(greatest(var - 2 * aw + b.s22, 0)) end as te from {source} i left join {p}best b on b.id = i.id and b.rk = 1)",
    ]


def _iso_in(rows: str, key: str, te: str = "0.05", name: str = "iso_in") -> str:
    cov = ", ".join(f"12 * covar_samp(r_{a}, r_{b}) as s{i}{j}" for i, a in enumerate(S.ASSETS, 1) for j, b in enumerate(S.ASSETS, 1) if j >= i)
    mu = ", ".join(f"12 * avg(r_{a}) as m{i}" for i, a in enumerate(S.ASSETS, 1))
    return f"{name}0 as (select {key} as id, {mu}, {cov} from {rows} group by {key}), {name} as (select *, s22 as vcap2, pow({te}, 2) as te2 from {name}0)"


_W = "round(w1, 8) + 0.0 as w_ndx, round(w2, 8) + 0.0 as w_spx, round(w3, 8) + 0.0 as w_ust"
_MODEL = f"{_W}, round(mean, 8) + 0.0 as mu, round(vol, 8) + 0.0 as vol, round(te, 8) + 0.0 as te"
_CAPS = "(values (0.02::double), (0.03), (0.04), (0.05), (0.08), (0.12)) v(te_cap)"

ORACLE_SQL["l12_iso_vol_te"] = with_(sample_sql(), "one as (select 1 as g, * from smp)", _iso_in("one", "g"), *iso_sql()) + f" select {_MODEL}, case when w1 is null then 'infeasible' else 'ok' end as status from iso"
ORACLE_SQL["l12_iso_vol_path"] = with_(sample_sql(), f"one as (select te_cap as g, smp.* from smp, {_CAPS})", _iso_in("one", "g", "id"), *iso_sql()) + f" select id as te_cap, {_MODEL} from iso where w1 is not null"
ORACLE_SQL["m7_bootstrap_rule"] = with_(*_DRAW, "rs as (select b, r_ndx, r_spx, r_ust from idx join smp using (t))", _iso_in("rs", "b"), *iso_sql()) + f" select id as b, {_MODEL}, case when w1 is null then 'infeasible' else 'ok' end as status from iso"
ORACLE_SQL["f11_draws_summary"] = (
    with_(*_DRAW, "rs as (select b, r_ndx, r_spx, r_ust from idx join smp using (t))", _iso_in("rs", "b"), *iso_sql())
    + " select count(w1) as n_feasible, " + ", ".join([r(f"quantile_cont(w{i}, {q})", f"w_{a}_p{round(100 * q)}") for i, a in enumerate(S.ASSETS, 1) for q in (0.1, 0.5, 0.9)] + [r(f"avg(w{i})", f"w_{a}_mean") for i, a in enumerate(S.ASSETS, 1)])
    + ", " + ", ".join(r(f"avg(case when w1 is not null then ({c})::int end)", n) for n, c in (("p_ust_over_50", "w3 > 0.5"), ("p_spx_under_1", "w2 < 0.01"), ("p_corner", "greatest(w1, w2, w3) >= 0.99")))
    + ", " + r("avg((w1 is null)::int)", "p_infeasible") + " from iso"
)
_WALK = [sample_sql(), f"win as (select month as tau, t - {LOOKBACK} as lo, t - 1 as hi from smp where month like '%-01' and t > {LOOKBACK} and month > (select min(month) from smp))", "est as (select tau, smp.* from win join smp on t between lo and hi)", _iso_in("est", "tau"), *iso_sql(), "wts as (select id as tau, coalesce(w1, 0.0) as w1, coalesce(w2, 1.0) as w2, coalesce(w3, 0.0) as w3, w1 is null as infeasible from iso)"]
ORACLE_SQL["m8_walk_forward_weights"] = with_(*_WALK) + f" select tau, {_W}, infeasible from wts"
ORACLE_SQL["m8_walk_forward"] = (
    with_(*_WALK, "held as (select s.*, w1, w2, w3 from smp s asof join wts on s.month >= wts.tau)",
          "ser as (" + " union all ".join(f"select '{k}' as series, row_number() over (order by month) as t, month, {e} as r, rf from held" for k, e in {"rule": "w1 * r_ndx + w2 * r_spx + w3 * r_ust", **{k: f"{w[0]} * r_ndx + {w[1]} * r_spx + {w[2]} * r_ust" for k, w in solvers.REFERENCES.items()}}.items()) + ")", path_sql())
    + f" select {STAT_COLS}, case when n >= 36 then 'ok' else 'insufficient' end as status from stats"
)


def _face(number: int, z: tuple[str, str, str]) -> str:
    return f"select k, c, {number} as face, {z[0]} as z1, {z[1]} as z2, {z[2]} as z3 from g"


def _tangency_sql() -> str:
    x = {i: f"(m{i} - c)" for i in (1, 2, 3)}
    zero, faces = "0.0::double", []
    for n, i in enumerate((1, 2, 3)):
        faces.append(_face(n, tuple("1.0::double" if j == i else zero for j in (1, 2, 3))))
    for n, (i, j) in enumerate(((1, 2), (1, 3), (2, 3)), 3):
        det = f"(s{i}{i} * s{j}{j} - s{i}{j} * s{i}{j})"
        z = {i: f"(s{j}{j} * {x[i]} - s{i}{j} * {x[j]}) / {det}", j: f"(s{i}{i} * {x[j]} - s{i}{j} * {x[i]}) / {det}"}
        faces.append(_face(n, tuple(z.get(k, zero) for k in (1, 2, 3))))
    adj = {(1, 1): "(s22 * s33 - s23 * s23)", (1, 2): "(s13 * s23 - s12 * s33)", (1, 3): "(s12 * s23 - s13 * s22)", (2, 2): "(s11 * s33 - s13 * s13)", (2, 3): "(s12 * s13 - s11 * s23)", (3, 3): "(s11 * s22 - s12 * s12)"}
    det = f"(s11 * {adj[1, 1]} + s12 * {adj[1, 2]} + s13 * {adj[1, 3]})"
    faces.append(_face(6, tuple("(" + " + ".join(f"{adj[min(i, j), max(i, j)]} * {x[j]}" for j in (1, 2, 3)) + f") / {det}" for i in (1, 2, 3))))
    return with_(
        sample_sql(), "one as (select 1 as g, * from smp)", _iso_in("one", "g"),
        "g as (select i.*, k::bigint as k, -0.05 + k * 0.0005 as c from iso_in i, range(261) v(k))",
        f"faces as ({' union all '.join(faces)})",
        "w as (select k, c, face, greatest(z1, 0) as w1, greatest(z2, 0) as w2, greatest(z3, 0) as w3 from faces where z1 + z2 + z3 > 0 and least(z1, z2, z3) / (z1 + z2 + z3) >= -1e-10)",
        "u as (select w.k, face, w1 / (w1 + w2 + w3) as w1, w2 / (w1 + w2 + w3) as w2, w3 / (w1 + w2 + w3) as w3 from w)",
        f"v as (select u.*, g.c, w1 * m1 + w2 * m2 + w3 * m3 as mean, {_quad('s', 'w', 'w')} as var, s12 * w1 + s22 * w2 + s23 * w3 as aw, s22 from u join g using (k))",
        "b as (select *, (mean - c) / sqrt(var) as slope, row_number() over (partition by k order by round((mean - c) / sqrt(var), 12) desc, face) as rk from v where mean > c)",
        f"o as (select g.k, g.c, case when b.k is null then 'no-premium' else 'ok' end as status, w1, w2, w3, mean, sqrt(var) as vol, case when b.k is not null then sqrt(greatest(var - 2 * aw + b.s22, 0)) end as te, slope from g left join b on b.k = g.k and b.rk = 1)",
    ) + f" select k, {r('c::double', 'c')}, status, {_MODEL}, {r('slope', 'slope')} from o"


ORACLE_SQL["l5_tangency_path"] = _tangency_sql()

from . import rule_queries  # noqa: E402,F401  registers the rest
