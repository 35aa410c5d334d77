"""Portfolios that are shown side by side: two-asset points, the nine asked for, the active one, and the tables made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import sample as S
from . import solvers, stats, windows

#: The asked portfolios in order, with the rule that an out-of-sample result comes from, or the reference series.
ASKED = (
    ("spx", "asked", None, "spx"), ("ndxUstSharpeEqSpx", "asked", None, None), ("ndxUstCagrEqSpx", "asked", None, None), ("maxSharpeCagrFloor", "asked", "maxSharpeCagrFloor", None),
    ("isoVolTe", "asked", "isoVolTe", None), ("tangencyLevered", "asked", "tangency", None), ("ndx", "asked", None, "ndx"), ("sixty40", "reference", None, "sixty40"), ("ndxSpx5050", "reference", None, "ndx_spx_5050"),
)
NEAR = 1e-4


def two_asset_points(sample: DataFrame, pair: tuple[int, int] = (0, 2)) -> DataFrame:
    """The marked shares of a two-asset line: roots and the best share whose growth is at least the benchmark's, merged where they differ by ``NEAR`` at most.

    (``x``, ``ids`` joined by +, ``status``, weights); ``status`` says whether the Sharpe ratio meets the benchmark's: ``ok``, ``all-above`` past a single root, ``none``.
    """
    roots = solvers.two_asset_roots(sample, pair)
    best = solvers.two_asset_best(sample, pair).filter("x is not null")
    names = F.when(F.col("kind") == "sharpe", "sharpeEqSpx").when(F.col("kind") == "cagr", "cagrEqSpx").when(F.col("kind") == "vol", "volEqSpx")
    raw = roots.select(names.alias("id"), "x").unionByName(best.select(F.lit("maxSharpeCagrFloor").alias("id"), "x"))
    status = solvers.two_asset_best(sample, pair).select("status")
    merged = windows.merge_near(raw, NEAR).join(F.broadcast(status), F.lit(True))  # a handful of rows
    share = lambda a: (F.col("x") if a == pair[0] else F.lit(0.0)) + ((1 - F.col("x")) if a == pair[1] else F.lit(0.0))
    return merged.select("x", F.col("id").alias("ids"), "status", *(share(i).alias(f"w_{a}") for i, a in enumerate(S.ASSETS)))


def asked(sample: DataFrame, iso: DataFrame, tangency: DataFrame, path: DataFrame, spread: float = 0.005) -> DataFrame:
    """The nine portfolios as (``place``, ``id``, ``group``, weights, ``L``) with their statistics; one that doesn't exist has nulls.

    Two-asset points are found by id and share: the largest root, within ``NEAR``.
    """
    spark = sample.sparkSession
    cols = ["w_ndx", "w_spx", "w_ust"]
    none = F.lit(None).cast("double").alias("L")
    ref = solvers.references(spark).select(F.when(F.col("series") == "ndx_spx_5050", "ndxSpx5050").otherwise(F.col("series")).alias("id"), *cols, none)
    points = two_asset_points(sample)
    largest = solvers.two_asset_roots(sample).groupBy("kind").agg(F.max("x").alias("wanted"))
    line = None
    for kind, name, mark in (("sharpe", "ndxUstSharpeEqSpx", "sharpeEqSpx"), ("cagr", "ndxUstCagrEqSpx", "cagrEqSpx")):
        hit = largest.filter(F.col("kind") == kind).join(points, (F.abs(F.col("x") - F.col("wanted")) <= NEAR) & F.array_contains(F.split("ids", "\\+"), mark))
        own = hit.select(F.lit(name).alias("id"), *cols, none)
        line = own if line is None else line.unionByName(own)
    found = ref.unionByName(line)
    found = found.unionByName(path.filter("objective = 'maxSharpeAtLeastSpxCagr'").select(F.lit("maxSharpeCagrFloor").alias("id"), *cols, none))
    found = found.unionByName(iso.filter("item = 'rule'").select(F.lit("isoVolTe").alias("id"), *cols, none))
    found = found.unionByName(tangency.filter("item = 'levered'").select(F.lit("tangencyLevered").alias("id"), *cols, "L"))
    order = spark.createDataFrame([(k, i, g) for k, (i, g, _, _) in enumerate(ASKED, 1)], "place int, id string, group string")
    listed = order.join(found, "id", "left")
    mixes = listed.filter("w_ndx is not null").select(F.col("id").alias("series"), *cols, "L", F.lit(spread).alias("spread"))
    st = stats.path_stats(S.mix(sample, mixes, leverage=True)).withColumnRenamed("series", "id")
    return listed.join(st.select("id", "n", "cagr", "vol", "sharpe", "mdd", "worst12m"), "id", "left")


def held(sample: DataFrame, weights: DataFrame, spread: float = 0.005) -> DataFrame:
    """A rule's portfolio with its statistics, differences to the benchmark's and tracking error; no row where it is infeasible."""
    mix = weights.filter("w_ndx is not null").select(F.lit("active").alias("series"), "w_ndx", "w_spx", "w_ust", "L", F.lit(spread).alias("spread"))
    return mix.join(solvers.evaluate(sample, mix, leverage=True), "series")


def out_of_sample(table: DataFrame, walks: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """The asked portfolios with ``oos_cagr`` and ``infeasible_windows``: rules from their own walk-forward (statistics, weights), references from the volatility rule's; null under 36 months and where every window was infeasible."""
    spark = table.sparkSession
    kinds = spark.createDataFrame([(i, rule or "isoVolTe", "rule" if rule else ref) for i, _, rule, ref in ASKED if rule or ref], "id string, rule string, series string")
    told = None
    for rule, (st, weights) in walks.items():
        bad = weights.agg(F.count_if("infeasible").alias("infeasible_windows"), F.count("*").alias("windows"))
        own = st.filter("status = 'ok'").join(F.broadcast(bad), F.lit(True)).select(F.lit(rule).alias("rule"), "series", "cagr", "infeasible_windows", "windows")
        told = own if told is None else told.unionByName(own)
    cell = kinds.join(told, ["rule", "series"], "left")
    gone = (F.col("series") == "rule") & (F.col("infeasible_windows") >= F.col("windows"))
    return table.join(cell.select("id", F.when(~gone, F.col("cagr")).alias("oos_cagr"), F.when(F.col("series") == "rule", F.col("infeasible_windows")).alias("infeasible_windows")), "id", "left")


# ---- tables behind the displays
def frontier_table(frontier: DataFrame, markers: DataFrame, assets: DataFrame, points: int = 11) -> DataFrame:
    """(``part``, ``label``, weights, ``mu``, ``vol``): markers, single assets, and so many points spread over the frontier."""
    w = ["w_ndx", "w_spx", "w_ust"]
    none = [F.lit(None).cast("double").alias(c) for c in w]
    valid = "mu is not null and vol is not null"
    own = markers.filter(valid).select(F.lit("marker").alias("part"), "label", *w, "mu", "vol")
    own = own.unionByName(assets.filter(valid).select(F.lit("asset").alias("part"), "label", *none, "mu", "vol"))
    return own.unionByName(sampled(frontier.filter(valid), "i", points).select(F.lit("frontier").alias("part"), F.col("i").cast("string").alias("label"), *w, "mu", "vol"))


def sampled(df: DataFrame, order: str, points: int) -> DataFrame:
    """At most so many rows at equal steps of the order, first and last among them; all of a shorter table."""
    whole = W.partitionBy()  # a table that is shown
    rows = df.withColumn("__n", F.count("*").over(whole)).withColumn("__i", F.row_number().over(whole.orderBy(order)) - 1)
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.floor(k * (F.col("__n") - 1) / (points - 1) + 0.5)))
    wanted = rows.limit(1).select(at.alias("__w")).distinct()
    return rows.join(F.broadcast(wanted), (F.col("__n") > points) & (F.col("__i") == F.col("__w")), "left").filter("__n <= " + str(points) + " or __w is not null").drop("__n", "__i", "__w")


def stacked_table(points: DataFrame, wanted: DataFrame, x: str = "x", values: tuple[str, ...] = ("w_ndx", "w_spx", "w_ust")) -> DataFrame:
    """The values of a line of points at wanted places (``label``, ``x``): linear between points, flat beyond the ends."""
    rows = points.select(F.col(x).alias("__x"), *(F.col(v).alias(f"__{v}") for v in values))
    order = W.partitionBy().orderBy("__x")
    ends = rows.withColumns({f"__next_{v}": F.lead(f"__{v}").over(order) for v in values}).withColumn("__to", F.lead("__x").over(order)).withColumn("__from", F.when(F.row_number().over(order) > 1, F.col("__x")))
    inside = (F.coalesce(F.col("__from") <= F.col("x"), F.lit(True))) & F.coalesce(F.col("x") < F.col("__to"), F.lit(True))
    share = F.coalesce(F.greatest(F.col("x") - F.col("__x"), F.lit(0.0)) / (F.col("__to") - F.col("__x")), F.lit(0.0))
    met = wanted.join(F.broadcast(ends), inside)  # a line that is drawn: hundreds of points
    return met.select("label", "x", *(F.when(share == 0, F.col(f"__{v}")).otherwise(F.col(f"__{v}") + share * (F.col(f"__next_{v}") - F.col(f"__{v}"))).alias(v) for v in values))


def two_asset_table(curve: DataFrame, guides: DataFrame) -> DataFrame:
    """The curve's rows nearest to each guide (``label``, ``x``) and to every tenth."""
    tenths = curve.sparkSession.range(11).select((100 * F.col("id") / 10).cast("int").cast("string").alias("label"), (F.col("id") / 10).alias("x"))
    wanted = guides.select(F.lit("guide").alias("part"), "label", "x").unionByName(tenths.select(F.lit("tenth").alias("part"), "label", "x"))
    pairs = wanted.join(F.broadcast(curve.withColumnRenamed("x", "at")), F.lit(True))
    best = pairs.groupBy("part", "label", "x").agg(F.min(F.struct(F.abs(F.col("at") - F.col("x")).alias("gap"), "k")).alias("b"))
    return best.select("part", "label", F.col("b.k").alias("k")).join(curve, "k")


def weight_table(weights: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """(``asset``, ``weight``, ``percent``, ``p10``, ``p50``, ``p90``): whole percents that add up to 100, with the quantiles of a bootstrap."""
    whole = solvers.apportion(weights, ["w_ndx", "w_spx", "w_ust"], 100)
    if summary is not None:
        whole = whole.join(F.broadcast(summary), F.lit(True))
    q = lambda a, p: F.col(f"w_{a}_p{p}") if summary is not None else F.lit(None).cast("double")
    each = F.array(*(F.struct(F.lit(a).alias("asset"), F.col(f"w_{a}").alias("weight"), F.col(f"p_w_{a}").alias("percent"), *(q(a, p).alias(f"p{p}") for p in (10, 50, 90))) for a in S.ASSETS))
    return whole.select(F.explode(each).alias("x")).select("x.*")


def period_cells(periods: DataFrame) -> DataFrame:
    """What a period table shows: yearly growth, and of short periods the cumulative return instead and no Sharpe ratio."""
    pick = lambda a: F.when(F.col("short"), F.col(f"{a}_cum")).otherwise(F.col(f"{a}_cagr"))
    return periods.select("period", "n", "short", pick("ndx").alias("ndx"), pick("spx").alias("spx"), (pick("ndx") - pick("spx")).alias("gap"), "ndx_sharpe", "spx_sharpe", "ndx_mdd", "spx_mdd")


def bar_table(rows: DataFrame, columns: tuple[str, ...] = ("price_lp_yr", "pe_lp_yr", "eps_lp_yr", "div_lp_yr", "tr_lp_yr")) -> DataFrame:
    """Cells of a bar table, (``id``, ``column``, ``value``, ``lo``, ``hi``, ``left``, ``width``): every column on a domain of its own that reaches a twentieth of its largest value to either side of 0."""
    from .tables import bar_geometry

    cells = rows.select("id", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns))).alias("x")).select("id", "x.*").filter("value is not null")
    m = F.greatest(F.lit(1e-9), F.max(F.abs("value")))
    ends = cells.groupBy("column").agg(F.least(F.lit(0.0), F.min("value"), -0.05 * m).alias("lo"), F.greatest(F.lit(0.0), F.max("value"), 0.05 * m).alias("hi"))
    left, width = bar_geometry(F.col("value"), F.col("lo"), F.col("hi"))
    return cells.join(F.broadcast(ends), "column").select("id", "column", "value", "lo", "hi", left.alias("left"), width.alias("width"))
