"""Comparison of the first two assets: periods, head to head, log-identity decomposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.months import index_of, month_index
from . import sample as S
from . import stats, windows

SHORT_MONTHS = 36


def periods(spark, bounds: list[tuple[str, str, str]]) -> DataFrame:
    """(``id``, ``from_month``, ``to_month``) from a short list."""
    return spark.createDataFrame(bounds, "id string, from_month string, to_month string")


def chained(ends: list[str]) -> list[tuple[str, str, str]]:
    """Periods between consecutive boundaries; each is named after its first year."""
    return [(f"d{int(a[:4]) + (a[5:] == '12')}", a, b) for a, b in zip(ends, ends[1:], strict=False)]


def period_table(sample: DataFrame, table: DataFrame) -> DataFrame:
    """Both assets in each period: growth, cumulative return, Sharpe ratio (null under 36 months), drawdown, and the spread."""
    rows = windows.in_periods(sample, table)
    pairs = F.array(F.struct(F.lit("ndx").alias("a"), F.col("r_ndx").alias("r")), F.struct(F.lit("spx").alias("a"), F.col("r_spx").alias("r")))
    long = rows.select("period", "t", "month", "rf", F.explode(pairs).alias("x")).select(F.concat_ws("|", "period", "x.a").alias("series"), "t", "month", "x.r", "rf")
    number = F.row_number().over(W.partitionBy("series").orderBy("t"))
    st = stats.path_stats(long.withColumn("t", number))
    st = st.withColumn("period", F.split("series", "\\|")[0]).withColumn("asset", F.split("series", "\\|")[1])
    pick = lambda a, c: F.max(F.when(F.col("asset") == a, F.col(c)))
    shown = {"cagr": "cagr", "cum": "cum_return", "mdd": "mdd"}
    out = st.groupBy("period").agg(
        F.max("n").alias("n"), *(pick(a, c).alias(f"{a}_{k}") for a in ("ndx", "spx") for k, c in shown.items()),
        *(F.when(F.max("n") >= SHORT_MONTHS, pick(a, "sharpe")).alias(f"{a}_sharpe") for a in ("ndx", "spx")),
    )
    return out.withColumn("short", F.col("n") < SHORT_MONTHS).withColumn("spread", F.col("ndx_cagr") - F.col("spx_cagr"))


VARIANTS = (("tr", "default"), ("tr", "low"), ("tr", "high"), ("pr", "default"))


def head_to_head(panel: DataFrame, start: str | None = None, end: str | None = None, wht: float = 0.0) -> DataFrame:
    """Growth and Sharpe ratios of both assets on every basis and dividend band, one row a variant.

    Every row of the panel gives its returns on all variants at once, so the panel is read once.
    """
    rows = panel.filter(F.col("month") > start) if start else panel.filter("t > 0")
    rows = rows.filter(F.col("month") <= end) if end else rows
    each = [F.struct(F.lit(f"{basis}_{band}").alias("variant"), F.lit(a).alias("series"), r.alias("r")) for basis, band in VARIANTS for a, r in zip(("ndx", "spx"), S.equity_returns(basis, band, wht), strict=True)]
    long = rows.select("t", F.col("RF").alias("rf"), F.explode(F.array(*each)).alias("x")).select(F.concat_ws("|", "x.variant", "x.series").alias("series"), "t", "x.r", "rf")
    st = stats.summary(long).withColumn("variant", F.split("series", "\\|")[0]).withColumn("series", F.split("series", "\\|")[1])
    pick = lambda a, c: F.max(F.when(F.col("series") == a, F.col(c)))
    wide = st.groupBy("variant").agg(*(pick(a, c).alias(f"{a}_{c}") for a in ("ndx", "spx") for c in ("cagr", "vol", "sharpe")))
    return wide.withColumn("diff_cagr", F.col("ndx_cagr") - F.col("spx_cagr")).withColumn("diff_sharpe", F.col("ndx_sharpe") - F.col("spx_sharpe"))


MEASURES = ("cagr", "sharpe", "vol", "mdd", "worst12m")


def full_head_to_head(panel: DataFrame, start: str | None = None, end: str | None = None, basis: str = "tr", band: str = "default", wht: float = 0.0, draws: int = 1000, seed: int = 20260912) -> DataFrame:
    """Everything told of the first two assets, as (``measure``, ``ndx``, ``spx``, ``diff``): statistics and their differences, the first asset at the second's
    volatility, the regression, the interval of the Sharpe ratios' difference, and on total returns the price basis, what dividends add, and what the estimates' bands change.
    """
    from . import resample

    s = S.build(panel, start, end, basis, band, wht)
    none = F.lit(None).cast("double")

    def rows(df: DataFrame, told: list[tuple]) -> DataFrame:
        """One row of numbers as rows of measures."""
        each = F.array(*(F.struct(F.lit(m).alias("measure"), *(c.cast("double").alias(k) for c, k in zip(cells, ("ndx", "spx", "diff"), strict=True))) for m, *cells in told))
        return df.select(F.explode(each).alias("x")).select("x.*")

    st = stats.path_stats(S.long(s, ("ndx", "spx")))
    pick = lambda a, c: F.max(F.when(F.col("series") == a, F.col(c)))
    one = st.agg(*(pick(a, c).alias(f"{a}_{c}") for a in ("ndx", "spx") for c in MEASURES))
    out = rows(one, [(m, F.col(f"ndx_{m}"), F.col(f"spx_{m}"), F.col(f"ndx_{m}") - F.col(f"spx_{m}")) for m in MEASURES])
    vm = stats.vol_matched(s)
    matched = stats.path_stats(vm.select("series", "t", "month", "r", "rf")).join(vm.agg(F.first("a").alias("a")), F.lit(True)).join(one, F.lit(True))
    out = out.unionByName(rows(matched, [("vol_matched_cagr", F.col("cagr"), F.col("spx_cagr"), F.col("cagr") - F.col("spx_cagr")), ("vol_matched_mdd", F.col("mdd"), none, none), ("vol_matched_share", F.col("a"), none, none)]))
    ab = stats.alpha_beta(s)
    out = out.unionByName(rows(ab, [(m, F.col(m), none, none) for m in ("alpha_ann", "beta", "t_alpha", "r2")]))
    ci = resample.sharpe_difference(s, S.check(s), draws, seed=seed)
    out = out.unionByName(rows(ci, [("sharpe_difference_low", none, none, F.col("lo")), ("sharpe_difference_high", none, none, F.col("hi"))]))
    if basis != "tr":
        return out
    variants = head_to_head(panel, start, end, wht)
    cell = lambda v, c: F.max(F.when(F.col("variant") == v, F.col(c)))
    wide = variants.agg(*(cell(f"{b}_{d}", f"{a}_{c}").alias(f"{b}_{d}_{a}_{c}") for b, d in VARIANTS for a in ("ndx", "spx") for c in ("cagr", "sharpe")))
    at = lambda v, a, c: F.col(f"{v}_{a}_{c}")
    told = [(f"price_{c}", at("pr_default", "ndx", c), at("pr_default", "spx", c), at("pr_default", "ndx", c) - at("pr_default", "spx", c)) for c in ("cagr", "sharpe")]
    own = {a: at(f"tr_{band}", a, "cagr") - at("pr_default", a, "cagr") for a in ("ndx", "spx")}
    told.append(("dividends_add", own["ndx"], own["spx"], own["ndx"] - own["spx"]))
    for b in ("low", "high"):
        told += [(f"band_{b}_cagr", at(f"tr_{b}", "ndx", "cagr"), none, none), (f"band_{b}_sharpe", at(f"tr_{b}", "ndx", "sharpe"), none, at(f"tr_{b}", "ndx", "sharpe") - at(f"tr_{b}", "spx", "sharpe"))]
    return out.unionByName(rows(wide, told))


#: Named regimes and the boundaries of decades; null is the latest month.
REGIMES = (
    ("prebubble", "1985-01", "1994-12"), ("bubble", "1994-12", "2000-03"), ("bust", "2000-03", "2002-09"), ("recovery", "2002-09", "2007-10"), ("gfc", "2007-10", "2009-02"),
    ("bull", "2009-02", "2019-12"), ("covid", "2019-12", "2021-12"), ("hike", "2021-12", "2022-12"), ("ai", "2022-12", None),
)
DECADES = ("1985-01", "1994-12", "2004-12", "2014-12", "2024-12", None)


def regimes(latest: str) -> list[tuple[str, str, str]]:
    return [(i, a, b or latest) for i, a, b in REGIMES]


def decades(latest: str) -> list[tuple[str, str, str]]:
    return chained([m or latest for m in DECADES])


def named_period_table(panel: DataFrame, bounds: list[tuple[str, str, str]], basis: str = "tr", band: str = "default", wht: float = 0.0) -> DataFrame:
    """``period_table`` of named periods, cut to the months that are there; periods outside of them have no row."""
    from . import tables

    first, last = panel.agg(F.min("month"), F.max("month")).first()
    spark = panel.sparkSession
    return period_table(S.build(panel, basis=basis, band=band, wht=wht), tables.clip_periods(periods(spark, [b for b in bounds if b[1] < b[2]]), first, last))


def is_material(ln: Column, years: Column) -> Column:
    return (F.abs(ln) >= 0.10) & (F.abs(100 * ln / years) >= 1)


def identity(df: DataFrame) -> DataFrame:
    """Log terms (``ln_r``, ``ln_m``, ``ln_d``, ``years``) to annual log points, factors and shares; a null dividend term leaves its columns null."""
    ln_e, ln_t, y = F.col("ln_r") - F.col("ln_m"), F.col("ln_r") + F.col("ln_d"), F.col("years")
    df = df.withColumns({"price_lp_yr": 100 * F.col("ln_r") / y, "pe_lp_yr": 100 * F.col("ln_m") / y, "eps_lp_yr": 100 * ln_e / y, "div_lp_yr": 100 * F.col("ln_d") / y, "tr_lp_yr": 100 * ln_t / y})
    df = df.withColumns({"f_price": F.exp("ln_r"), "f_pe": F.exp("ln_m"), "f_eps": F.exp(ln_e), "f_div": F.exp("ln_d"), "f_tr": F.exp(ln_t)})
    price, total = is_material(F.col("ln_r"), y), is_material(ln_t, y)
    return df.withColumns({"pe_share": F.when(price, F.col("ln_m") / F.col("ln_r")), "eps_share": F.when(price, ln_e / F.col("ln_r")), "div_share_tr": F.when(total, F.col("ln_d") / ln_t)})


def dividend_term(panel: DataFrame, band: str = "default", wht: float = 0.0) -> DataFrame:
    """Cumulative dividend term at each month, 0 at the first: differences of it are the terms of any period."""
    s = S.build(panel, basis="tr", band=band, wht=wht).select("month", "r_ndx", "r_spx")
    each = panel.select("month", "t", "ndx_pr", "spx_pr").join(s, "month", "left")
    d = F.coalesce((F.log1p("r_ndx") - F.log1p("ndx_pr")) - (F.log1p("r_spx") - F.log1p("spx_pr")), F.lit(0.0))
    return each.select("month", F.sum(d).over(W.partitionBy().orderBy("t").rowsBetween(W.unboundedPreceding, 0)).alias("cum_d"))


def anchors(panel: DataFrame) -> DataFrame:
    """Relative valuation at each month: ``M`` and the price ratio ``R``."""
    return panel.select("month", (F.col("ndx_pe") / F.col("spx_pe")).alias("M"), (F.col("NDX") / F.col("SPX")).alias("R"))


def decomposition(panel: DataFrame, segments: DataFrame, band: str = "default", wht: float = 0.0, m0: float | None = None) -> DataFrame:
    """Each segment (``id``, ``from_month``, ``to_month``) as price = valuation + earnings, and dividends; ``m0`` replaces the first segment's start valuation.

    Endpoints are two equi-joins of the segments with the months.
    """
    points = anchors(panel).join(dividend_term(panel, band, wht), "month")
    a, b = (points.select(*(F.col(c).alias(f"{c}_{k}") for c in points.columns)) for k in ("a", "b"))
    rows = segments.join(a, F.col("from_month") == F.col("month_a")).join(b, F.col("to_month") == F.col("month_b"))
    start = F.col("M_a")
    if m0 is not None:
        first = F.col("from_month") == F.min("from_month").over(W.partitionBy())  # a short list
        start = F.when(first, F.lit(float(m0))).otherwise(start)
    rows = rows.select("id", "from_month", "to_month", start.alias("m_start"), F.col("M_b").alias("m_end"), "R_a", "R_b", (F.col("cum_d_b") - F.col("cum_d_a")).alias("ln_d"))
    rows = rows.withColumn("years", (month_index(F.col("to_month")) - month_index(F.col("from_month"))) / 12)
    return identity(rows.withColumn("ln_r", F.ln(F.col("R_b") / F.col("R_a"))).withColumn("ln_m", F.ln(F.col("m_end") / F.col("m_start"))))


def anchored_decomposition(panel: DataFrame, anchors: DataFrame, latest: DataFrame, segments: DataFrame, m0: tuple[float, float, float], band: str = "default", wht: float = 0.0, user_m0: float | None = None) -> DataFrame:
    """Segments between valuation anchors, the splice between their tiers, and the full period.

    ``anchors`` and ``latest`` (one row) have ``month``, ``tier``, ``M``; an end (``from_month``/``from_tier``, ``to_month``/``to_tier`` of ``segments``)
    is looked up by month and tier, first among the anchors, then in the latest one; a segment without an anchor raises. ``m0`` is (low, central, high) of the first valuation, ``user_m0``
    replaces it. Rows are told apart by ``part``: ``segment``, ``splice`` (valuations of segments chain up to this), ``full`` (with the earnings share at either end of ``m0``).
    """
    known = anchors.select("month", "tier", "M", F.lit(0).alias("rank")).unionByName(latest.select("month", "tier", "M", F.lit(1).alias("rank")))
    known = known.groupBy("month", "tier").agg(F.min_by("M", "rank").alias("M"))
    levels = panel.select("month", (F.col("NDX") / F.col("SPX")).alias("R")).join(dividend_term(panel, band, wht), "month")
    ends = {}
    for k, side in (("a", "from"), ("b", "to")):
        m = known.select(F.col("month").alias(f"{side}_month"), F.col("tier").alias(f"{side}_tier"), F.col("M").alias(f"M_{k}"))
        r = levels.select(F.col("month").alias(f"{side}_month"), F.col("R").alias(f"R_{k}"), F.col("cum_d").alias(f"D_{k}"))
        ends[side] = (m, r)
    rows = segments
    for side, (m, r) in ends.items():
        rows = rows.join(m, [f"{side}_month", f"{side}_tier"], "left").join(r, f"{side}_month", "left")
    start = F.min("from_month").over(W.partitionBy())  # a short list
    if user_m0 is not None:
        first = F.col("from_month") == start
        rows = rows.withColumn("M_a", F.when(first, F.lit(float(user_m0))).otherwise(F.col("M_a"))).withColumn("from_tier", F.when(first, "user").otherwise(F.col("from_tier")))
    whole = lambda c: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"E_NULL_DATA {c} "), F.col("id"))).cast("double"))
    rows = rows.withColumns({c: whole(c) for c in ("M_a", "M_b", "R_a", "R_b")})
    years = lambda a, b: (month_index(F.col(b)) - month_index(F.col(a))) / 12
    part = rows.select(F.lit("segment").alias("part"), "id", "from_month", "to_month", "from_tier", "to_tier", (F.col("from_tier") != F.col("to_tier")).alias("splice"), F.col("M_a").alias("m_start"), F.col("M_b").alias("m_end"), "R_a", "R_b", (F.col("D_b") - F.col("D_a")).alias("ln_d"), years("from_month", "to_month").alias("years"))
    used = float(user_m0) if user_m0 is not None else float(m0[1])
    full = part.agg(*(F.min_by(c, "from_month").alias(c) for c in ("from_month", "from_tier", "R_a")), *(F.max_by(c, "to_month").alias(c) for c in ("to_month", "R_b")), F.sum("ln_d").alias("ln_d"))
    full = full.join(latest.select(F.col("M").alias("m_end"), F.col("tier").alias("to_tier")), F.lit(True))
    full = full.select(F.lit("full").alias("part"), F.lit("full").alias("id"), "from_month", "to_month", "from_tier", "to_tier", F.lit(False).alias("splice"), F.lit(used).alias("m_start"), "m_end", "R_a", "R_b", "ln_d", years("from_month", "to_month").alias("years"))
    both = part.unionByName(full).withColumn("ln_r", F.ln(F.col("R_b") / F.col("R_a"))).withColumn("ln_m", F.ln(F.col("m_end") / F.col("m_start")))
    told = identity(both)
    band_of = lambda m: (F.col("ln_r") - F.ln(F.col("m_end") / F.lit(float(m)))) / F.col("ln_r")
    shown = (F.col("part") == "full") & is_material(F.col("ln_r"), F.col("years"))
    told = told.withColumn("eps_share_low", F.when(shown, F.least(band_of(m0[0]), band_of(m0[2])))).withColumn("eps_share_high", F.when(shown, F.greatest(band_of(m0[0]), band_of(m0[2]))))
    kept = ["part", "id", "from_month", "to_month", "from_tier", "to_tier", "splice", "m_start", "m_end", "years", "price_lp_yr", "pe_lp_yr", "eps_lp_yr", "div_lp_yr", "tr_lp_yr", "pe_share", "eps_share", "div_share_tr", "eps_share_low", "eps_share_high"]
    told = told.select(*kept, "ln_m")
    gap = told.agg(F.sum(F.when(F.col("part") == "full", F.col("ln_m")).otherwise(-F.col("ln_m"))).alias("g"), F.max(F.when(F.col("part") == "full", F.col("years"))).alias("years"))
    splice = gap.select(F.lit("splice").alias("part"), F.lit("splice").alias("id"), "years", (100 * F.col("g") / F.col("years")).alias("pe_lp_yr"), (-100 * F.col("g") / F.col("years")).alias("eps_lp_yr"))
    return told.drop("ln_m").unionByName(splice, allowMissingColumns=True)


def date_adjusted_anchor(label: float, at_end: tuple[float, float], closes: DataFrame, end: str, labelled: str, tolerance: float = 0.005) -> DataFrame:
    """A valuation read off on one day, moved to the month's end by the price ratio: (``M``, ``verified``).

    ``closes`` has ``date``, ``ndx``, ``spx``; it is verified if both days are there and the end's closes agree with the levels ``at_end``; else the label stands.
    """
    one = closes.agg(*(F.max(F.when(F.col("date") == F.lit(day).cast("date"), F.col(c))).alias(f"{c}_{k}") for k, day in (("end", end), ("label", labelled)) for c in ("ndx", "spx")))
    there = F.coalesce(F.col("ndx_end") * F.col("spx_end") * F.col("ndx_label") * F.col("spx_label"), F.lit(0.0)) > 0
    verified = there & (F.abs(F.col("ndx_end") - at_end[0]) <= tolerance) & (F.abs(F.col("spx_end") - at_end[1]) <= tolerance)
    moved = F.lit(label) * F.lit(at_end[0] / at_end[1]) / (F.col("ndx_label") / F.col("spx_label"))
    return one.select(F.when(verified, moved).otherwise(F.lit(label)).alias("M"), F.coalesce(verified, F.lit(False)).alias("verified"))


def chain_gap(parts: DataFrame, full: DataFrame) -> DataFrame:
    """Log points of the full period less the segments' sum: prices chain exactly, valuations up to splices."""
    p = parts.agg(F.sum("ln_r").alias("r"), F.sum("ln_m").alias("m"))
    return full.join(F.broadcast(p), F.lit(True)).select((100 * (F.col("ln_r") - F.col("r"))).alias("price"), (100 * (F.col("ln_m") - F.col("m"))).alias("pe"))


def totals(parts: DataFrame) -> DataFrame:
    """Sum of consecutive segments; the dividend term only if every one has it."""
    return identity(parts.agg(F.sum("years").alias("years"), F.sum("ln_r").alias("ln_r"), F.sum("ln_m").alias("ln_m"), F.when(F.bool_and(F.col("ln_d").isNotNull()), F.sum("ln_d")).alias("ln_d")))


def break_even(panel: DataFrame) -> DataFrame:
    """Start valuations at which valuation explains 0, 25 and 50 % of the price move."""
    ends = panel.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    pts = anchors(panel).join(F.broadcast(ends), (F.col("month") == F.col("a")) | (F.col("month") == F.col("b")))
    one = pts.groupBy("a", "b").agg(F.max(F.when(F.col("month") == F.col("a"), F.col("R"))).alias("R0"), F.max(F.when(F.col("month") == F.col("b"), F.col("R"))).alias("RT"), F.max(F.when(F.col("month") == F.col("b"), F.col("M"))).alias("m_end"))
    one = one.withColumn("ln_r", F.ln(F.col("RT") / F.col("R0"))).withColumn("years", (month_index(F.col("b")) - month_index(F.col("a"))) / 12)
    return one.withColumns({"p0": F.col("m_end"), "p25": F.col("m_end") * F.exp(-0.25 * F.col("ln_r")), "p50": F.col("m_end") * F.exp(-0.5 * F.col("ln_r"))})


def sensitivity(panel: DataFrame, grid: tuple[float, ...] = (0.6, 0.8, 1.0, 1.2, 1.5, 1.9, 2.5, 3.0)) -> DataFrame:
    """The split of the full price move for each start valuation of a grid."""
    one = break_even(panel).withColumn("m0", F.explode(F.array(*map(F.lit, grid))))
    ln_m = F.ln(F.col("m_end") / F.col("m0"))
    ln_e = F.col("ln_r") - ln_m
    return one.select("m0", (100 * ln_m / F.col("years")).alias("pe_lp_yr"), (100 * ln_e / F.col("years")).alias("eps_lp_yr"), F.when(is_material(F.col("ln_r"), F.col("years")), ln_e / F.col("ln_r")).alias("eps_share"))


def months_between(a: str, b: str) -> int:
    return index_of(b) - index_of(a)
