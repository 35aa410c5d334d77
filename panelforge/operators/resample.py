"""Seeded block bootstraps and walk-forward re-estimation, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rng
from . import rules, solvers, stats, windows
from . import sample as S
from .rules import Rule

DEFAULT = Rule()
#: Draws of a bootstrap by kind of rule.
DRAWS = {"isoVolTe": 1000, "tangency": 1000, "maxSharpeCagrFloor": 200}


def effective_block(n: int, block: int = 24) -> int:
    return max(1, min(block, n // 4))


def block_indices(spark, n: int, draws: int, block: int = 24, seed: int = 20260912) -> DataFrame:
    """(``b``, ``m``, ``t``): place m of draw b takes row t (from 1) of the sample. A pure function of (seed, b, m): any partitioning or chunk gives the same draws.

    One random number is made for each block of a draw; its places follow by counting on.
    """
    size = effective_block(n, block)
    blocks = -(-n // size)
    each = spark.range(draws * blocks).select(F.expr(f"cast(id div {blocks} as int)").alias("b"), (F.col("id") % blocks).cast("int").alias("k"))
    each = rng.with_uniform(each.withColumn("__seed", rng.draw_seed(seed, F.col("b"))), "u", F.col("__seed"), F.col("k"))
    start = F.coalesce(F.floor(F.col("u") * n).cast("int"), F.lit(0))
    places = each.select("b", "k", start.alias("start"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("o"))
    m = F.col("k") * size + F.col("o")
    return places.filter(m < n).select("b", m.cast("int").alias("m"), ((F.col("start") + F.col("o")) % n + 1).cast("int").alias("t"))


def resampled(sample: DataFrame, n: int, draws: int, block: int = 24, seed: int = 20260912) -> DataFrame:
    """Rows of every draw: the sample has a row a month and is broadcast to the draws. The yield stays the sample's last one, as a draw has no end."""
    last = sample.agg(F.max_by("dgs10", "t").alias("dgs10"))
    rows = F.broadcast(sample.select("t", "r_ndx", "r_spx", "r_ust", "rf").join(F.broadcast(last), F.lit(True)))
    return block_indices(sample.sparkSession, n, draws, block, seed).join(rows, "t")


def sharpe_difference(sample: DataFrame, n: int, draws: int = 1000, block: int = 24, seed: int = 20260912) -> DataFrame:
    """Difference of the first two Sharpe ratios: the sample's, and the 2.5 and 97.5 % quantiles over the draws."""
    ratio = lambda c: stats.SQ12 * F.avg(F.col(c) - F.col("rf")) / F.nullif(F.stddev_samp(F.col(c) - F.col("rf")), F.lit(0.0))
    each = resampled(sample, n, draws, block, seed).groupBy("b").agg((ratio("r_ndx") - ratio("r_spx")).alias("d"))
    point = sample.agg((ratio("r_ndx") - ratio("r_spx")).alias("point"))
    return each.agg(F.percentile("d", F.lit(0.025)).alias("lo"), F.percentile("d", F.lit(0.975)).alias("hi"), F.count("*").alias("draws")).join(point, F.lit(True))


def bootstrap_rule(sample: DataFrame, n: int, draws: int | None = None, rule: Rule = DEFAULT, block: int = 24, seed: int = 20260912) -> DataFrame:
    """A rule's weights on every draw (``b``, weights, ``L`` for levered rules, ``status``): join, then the rule by draw. Without ``draws``, as many as the rule's kind takes."""
    rows = resampled(sample, n, draws or DRAWS.get(rule.kind, 1000), block, seed).withColumn("t", F.col("m") + 1).drop("m")
    return rules.weights(rows, ["b"], rule)


def summarise_draws(draws: DataFrame, levered: bool = False) -> DataFrame:
    """One row: quantiles and means of the weights over feasible draws, shares of draws by kind; infeasible ones as a share of all. Levered rules add the quantiles of leverage and of notional weights."""
    ok = F.col("w_ndx").isNotNull()
    share = lambda p: F.avg(F.when(ok, p.cast("double")))
    out = [F.count_if(ok).alias("n_feasible")]
    for c in ("w_ndx", "w_spx", "w_ust"):
        out += [F.percentile(c, F.lit(p)).alias(f"{c}_p{round(100 * p)}") for p in (0.1, 0.5, 0.9)] + [F.avg(c).alias(f"{c}_mean")]
    corner = F.greatest("w_ndx", "w_spx", "w_ust") >= 0.99
    out += [share(F.col("w_ust") > 0.5).alias("p_ust_over_50"), share(F.col("w_spx") < 0.01).alias("p_spx_under_1"), share(corner).alias("p_corner"), F.avg((~ok).cast("double")).alias("p_infeasible")]
    if levered:
        out += [F.percentile("L", F.lit(p)).alias(f"L_p{round(100 * p)}") for p in (0.1, 0.5, 0.9)]
        out += [F.percentile(F.col("L") * F.col(c), F.lit(p)).alias(f"n{c[1:]}_p{round(100 * p)}") for c in ("w_ndx", "w_spx", "w_ust") for p in (0.1, 0.5, 0.9)]
    return draws.agg(*out)


def rebalance_windows(sample: DataFrame, lookback: int, trailing: bool = True, first: str | None = None) -> DataFrame:
    """Rebalance months: ``tau`` and rows [``lo``, ``hi``] strictly before it.

    ``sample`` is the full range of data; months are the first one of the user's range (``first``; the sample's without one) and every January after it, as
    far as they have ``lookback`` rows before them.
    """
    start = F.lit(first) if first else F.min("month").over(W.partitionBy())  # a row a month
    marks = sample.withColumn("__first", start).filter((F.col("t") > lookback) & ((F.col("month") == F.col("__first")) | (F.col("month").endswith("-01") & (F.col("month") > F.col("__first")))))
    lo = (F.col("t") - lookback) if trailing else F.lit(1)
    return marks.select(F.col("month").alias("tau"), lo.cast("int").alias("lo"), (F.col("t") - 1).cast("int").alias("hi"))


def walk_forward_weights(sample: DataFrame, lookback: int, trailing: bool = True, rule: Rule = DEFAULT, first: str | None = None) -> DataFrame:
    """The rule's weights at each rebalance month, from rows before it only; an infeasible window holds the benchmark.

    Windows meet their rows in an interval join with the short list of windows broadcast.
    """
    win = F.broadcast(rebalance_windows(sample, lookback, trailing, first))
    rows = sample.join(win, F.col("t").between(F.col("lo"), F.col("hi")))
    solved = rules.weights(rows, ["tau"], rule)
    bad = F.col("w_ndx").isNull()
    held = {"w_ndx": 0.0, "w_spx": 1.0, "w_ust": 0.0}
    return solved.select("tau", *(F.when(bad, v).otherwise(F.col(c)).alias(c) for c, v in held.items()), F.when(~bad, F.col("L")).alias("L"), bad.alias("infeasible"))


def walk_forward_returns(sample: DataFrame, weights: DataFrame, spread: float = 0.005) -> DataFrame:
    """Out-of-sample rows (``series`` rule, spx, ndx, sixty40, ndx_spx_5050): weights, and leverage where there is one, held until the next rebalance month."""
    marks = weights.select(F.col("tau").alias("month"), "w_ndx", "w_spx", "w_ust", F.coalesce("L", F.lit(1.0)).alias("L"))
    held = windows.as_of(sample.select("month", "t", "r_ndx", "r_spx", "r_ust", "rf"), marks, "month", ["w_ndx", "w_spx", "w_ust", "L"])
    oos = held.filter("w_ndx is not null")
    rule = S.levered(F.col("w_ndx") * F.col("r_ndx") + F.col("w_spx") * F.col("r_spx") + F.col("w_ust") * F.col("r_ust"), F.col("L"), F.col("rf"), F.lit(spread))
    paths = {"rule": rule, **{k: sum((F.lit(x) * F.col(f"r_{a}") for x, a in zip(w, S.ASSETS, strict=True)), F.lit(0.0)) for k, w in solvers.REFERENCES.items()}}
    each = oos.withColumn("x", F.explode(F.array(*(F.struct(F.lit(k).alias("series"), v.alias("r")) for k, v in paths.items()))))
    number = F.row_number().over(W.partitionBy("series").orderBy("month"))
    return each.select("x.series", "month", "x.r", "rf").withColumn("t", number)


def walk_forward(sample: DataFrame, lookback: int, trailing: bool = True, rule: Rule = DEFAULT, first: str | None = None) -> DataFrame:
    """Path statistics out of sample, rule and references; ``status`` is insufficient under 36 months."""
    rows = walk_forward_returns(sample, walk_forward_weights(sample, lookback, trailing, rule, first), rule.spread)
    return stats.path_stats(rows).withColumn("status", F.when(F.col("n") >= 36, "ok").otherwise("insufficient"))


def walk_forward_static(sample: DataFrame, weights: DataFrame, rule: Rule = DEFAULT) -> DataFrame:
    """The rule fitted on the out-of-sample months themselves and held: one row of weights and statistics."""
    since = weights.agg(F.min("tau").alias("since"))
    own = sample.join(F.broadcast(since), F.col("month") >= F.col("since")).drop("since")
    own = own.withColumn("t", F.row_number().over(W.partitionBy().orderBy("month")))
    found = rules.weights(own.withColumn("g", F.lit(1)), ["g"], rule).filter("w_ndx is not null")
    mix = found.select(F.lit("static").alias("series"), "w_ndx", "w_spx", "w_ust", "L", F.lit(rule.spread).alias("spread"))
    return mix.join(stats.summary(S.mix(own, mix, leverage=True)), "series")


def walk_forward_notes(weights: DataFrame, returns: DataFrame, year: str) -> DataFrame:
    """One row: windows, infeasible ones, years with more than half in bonds, least, largest and latest leverage, and a calendar year's returns (null unless it has twelve months)."""
    told = weights.agg(
        F.count("*").alias("windows"), F.count_if("infeasible").alias("infeasible_windows"), F.count_if(F.col("w_ust") > 0.5).alias("ust_over_50_years"),
        F.min("L").alias("min_L"), F.max("L").alias("max_L"), F.max_by("L", "tau").alias("latest_L"), F.min("tau").alias("first_oos"),
    )
    y = S.calendar_returns(returns).filter(F.col("year") == year).agg(*(F.max(F.when(F.col("series") == k, F.col("ret"))).alias(f"{k}_year") for k in ("rule", "spx")))
    return told.join(y, F.lit(True))
