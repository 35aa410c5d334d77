"""Allocation rules: which weights a rule takes on a sample, on every draw or on every window.

A rule is a record of its kind and parameters. Rules on moments are solved on one row a group, made by aggregation; the path rule
sees a group's months. Weights come with the leverage at which the rule is held.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import PanelError
from . import geometry as G
from . import sample as S
from . import solvers, stats

INTERCEPTS = ("implied", "rf", "y10", "custom")


@dataclass(frozen=True)
class Rule:
    """``levered`` holds the tangency levered to the benchmark's volatility times ``vol_mult``; ``intercept`` says over what the unlevered one is steepest."""

    kind: str = "isoVolTe"
    mu: str = "hist"
    vol_mult: float = 1.0
    te_cap: float | None = 0.05
    spread: float = 0.005
    intercept: str = "implied"
    c: float | None = None
    w: tuple[float, float, float] | None = None
    levered: bool = True


def resolve_intercept(row: dict, intercept: str = "implied", c: float | None = None, vol_mult: float = 1.0) -> dict:
    """``c``, ``c_implied`` and what is known of it, on one row of moments.

    The implied intercept is that over which the best mix at the benchmark's volatility is the tangency; of an interval, its lower end.
    """
    mu, cov = solvers.mu_of(row), solvers.cov_of(row)
    pure = G.iso_vol(mu, cov, vol_mult, None)
    kind, low, high, above = (None if pure is None else G.implied_intercept(mu, cov, pure)) or (None, None, None, None)
    told = {"implied": low, "rf": row["rf_ann"], "y10": row.get("y10"), "custom": c}
    return {"c": told.get(intercept), "c_implied": low, "kind": kind, "c_high": high if kind == "interval" else None, "at_least": bool(kind == "interval" and above)}


_BLOCK = f"item string, c double, status string, {solvers.W3}, mu double, vol double, te double, slope double, L double, mode string, kind string, at_least boolean"


def tangency_items(moments: DataFrame, keep: list[str], rule: Rule = Rule(kind="tangency")) -> DataFrame:
    """The tangency rule in rows: over the chosen intercept (``unlevered``), over cash (``rf``), the yield (``y10``) and the implied one (``implied``), and ``levered`` to the target volatility."""
    if rule.intercept not in INTERCEPTS:
        raise PanelError("E_BAD_RANGE", rule.intercept)

    def solve(r: dict) -> list[dict]:
        mu, cov = solvers.mu_of(r), solvers.cov_of(r)
        found = resolve_intercept(r, rule.intercept, rule.c, rule.vol_mult)
        out = []
        for item, c in (("unlevered", found["c"]), ("rf", r["rf_ann"]), ("y10", r["y10"]), ("implied", found["c_implied"])):
            status, w = ("undefined", None) if c is None else G.tangency(mu, cov, c)
            m = solvers._model(w, mu, cov)
            implied = item == "implied" or (item == "unlevered" and rule.intercept == "implied")
            out.append({"item": item, "c": c, "status": status, **solvers._w(w), **m, "slope": None if w is None else (m["mu"] - c) / m["vol"], "L": None, "mode": None, "kind": found["kind"] if implied else None, "at_least": found["at_least"] if implied else None})
        k = G.kinked_line(mu, cov, r["rf_ann"], rule.spread, rule.vol_mult * cov[1, 1] ** 0.5)
        out.append({"item": "levered", "c": k["c_used"], "status": "infeasible" if k["w"] is None else "ok", **solvers._w(k["w"]), **solvers._model(k["w"], mu, cov), "slope": None, "L": k["L"], "mode": k["mode"], "kind": None, "at_least": None})
        return out

    return solvers.over_rows(moments, keep, _BLOCK, solve)


def weights(rows: DataFrame, by: list[str], rule: Rule = Rule()) -> DataFrame:
    """(``by``, weights, ``L``, ``status``) of a rule on each group of sample rows; null weights where it is infeasible, null leverage where it has none."""
    done = ["w_ndx", "w_spx", "w_ust", "L", "status"]
    if rule.kind == "maxSharpeCagrFloor":
        found = solvers.optimise_path(rows.select(*by, "t", "r_ndx", "r_spx", "r_ust", "rf"), ("maxSharpeAtLeastSpxCagr",), by)
        return found.select(*by, "w_ndx", "w_spx", "w_ust", F.lit(None).cast("double").alias("L"), F.when(F.col("w_ndx").isNull(), "infeasible").otherwise("ok").alias("status"))
    if rule.kind == "custom":
        w = solvers.normalise_weights(list(rule.w or ()))
        return rows.select(*by).distinct().select(*by, *(F.lit(x).alias(f"w_{a}") for x, a in zip(w, S.ASSETS, strict=True)), F.lit(None).cast("double").alias("L"), F.lit("ok").alias("status"))
    moments = solvers.with_mu(stats.moments(rows, by), rule.mu)
    if rule.kind == "isoVolTe":
        return solvers.iso_vol(moments, by, rule.vol_mult, rule.te_cap).withColumn("L", F.lit(None).cast("double")).select(*by, *done)
    if rule.kind == "tangency" and rule.levered:
        return solvers.kinked_line(moments, by, rule.spread, rule.vol_mult).select(*by, "w_ndx", "w_spx", "w_ust", "L", F.when(F.col("w_ndx").isNull(), "infeasible").otherwise("ok").alias("status"))
    if rule.kind == "tangency":
        return tangency_items(moments, by, rule).filter("item = 'unlevered'").select(*by, *done)
    raise PanelError("E_BAD_RANGE", f"rule {rule.kind}")


def iso_vol_items(moments: DataFrame, keep: list[str], vol_mult: float = 1.0, te_cap: float | None = 0.05) -> DataFrame:
    """The volatility rule in rows: the ``rule`` itself, ``pure`` without a tracking-error limit, and with the first asset's mean lower by 1 and 2 %; with the limits that bind."""

    def solve(r: dict) -> list[dict]:
        mu, cov = solvers.mu_of(r), solvers.cov_of(r)
        cap, out = (vol_mult**2) * cov[1, 1], []
        for item, shift, te in (("rule", 0.0, te_cap), ("pure", 0.0, None), ("ndx_less_1", -0.01, te_cap), ("ndx_less_2", -0.02, te_cap)):
            moved = mu + np.array([shift, 0.0, 0.0])
            w = G.iso_vol(moved, cov, vol_mult, te)
            m = solvers._model(w, mu, cov)
            vol = None if w is None else bool(abs(m["vol"] ** 2 - cap) < 1e-10 * cap)
            close = None if w is None else bool(te is not None and abs(m["te"] ** 2 - te * te) < 1e-10 * te * te)
            out.append({"item": item, **solvers._w(w), **m, "binds_vol": vol, "binds_te": close})
        return out

    return solvers.over_rows(moments, keep, f"item string, {solvers.W3}, mu double, vol double, te double, binds_vol boolean, binds_te boolean", solve)


#: Tracking-error limits that the path of limits always shows.
LIMITS = (0.02, 0.03, 0.04, 0.05)


def limit_path(moments: DataFrame, keep: list[str], vol_mult: float = 1.0, steps: int = 20) -> DataFrame:
    """The rule along tracking-error limits from 1 % to that of the mix without one: (``k``, weights, model), the last one without a limit."""

    def solve(r: dict) -> list[dict]:
        mu, cov = solvers.mu_of(r), solvers.cov_of(r)
        pure = G.iso_vol(mu, cov, vol_mult, None)
        if pure is None:
            return []
        free = solvers._model(pure, mu, cov)["te"]
        ks = [free] if free <= 0.01 else [0.01 + (free - 0.01) * i / (steps - 1) for i in range(steps)]
        ks = sorted(ks + [k for k in LIMITS if k <= free and all(abs(k - x) >= 1e-9 for x in ks)])
        found = [(k, pure if k >= free - 1e-12 else G.iso_vol(mu, cov, vol_mult, k)) for k in ks]
        return [{"k": k, **solvers._w(w), **solvers._model(w, mu, cov)} for k, w in found if w is not None]

    return solvers.over_rows(moments, keep, f"k double, {solvers.W3}, mu double, vol double, te double", solve)


def flat_top(sample: DataFrame, path: DataFrame) -> DataFrame:
    """What loosening the limit from 3 % to none changes: the first asset's share at either end and the growth gained; no row where the path ends at 3 % or less."""
    ends = path.agg(F.max("k").alias("k_to"), F.max_by("w_ndx", "k").alias("ndx_to"), F.max(F.when(F.abs(F.col("k") - 0.03) < 1e-9, F.col("w_ndx"))).alias("ndx_from")).filter("k_to > 0.03 and ndx_from is not null")
    at = path.join(F.broadcast(ends.select("k_to")), (F.col("k") == F.col("k_to")) | (F.abs(F.col("k") - 0.03) < 1e-9))
    growth = stats.summary(S.mix(sample, at.select(F.when(F.col("k") == F.col("k_to"), "to").otherwise("from").alias("series"), "w_ndx", "w_spx", "w_ust")))
    gap = growth.agg((F.max(F.when(F.col("series") == "to", F.col("cagr"))) - F.max(F.when(F.col("series") == "from", F.col("cagr")))).alias("cagr_gap"))
    return ends.join(gap, F.lit(True)).select(F.lit(0.03).alias("k_from"), "k_to", "ndx_from", "ndx_to", "cagr_gap")


def path_bounds(moments: DataFrame, c: float | None = None, vol_mult: float = 1.0) -> DataFrame:
    """The range of intercepts worth drawing: (``c_min``, ``c_max``) from a percent under the least one of interest to where the first asset stands alone, and a percent."""

    def solve(r: dict) -> list[dict]:
        mu, cov = solvers.mu_of(r), solvers.cov_of(r)
        low = min(x for x in (r["rf_ann"], r["y10"], resolve_intercept(r, vol_mult=vol_mult)["c_implied"], c) if x is not None) - 0.01
        alone = G.implied_intercept(mu, cov, np.array([1.0, 0.0, 0.0]))
        top = mu.max() if alone is None or alone[1] is None else alone[1]
        return [{"c_min": float(low), "c_max": float(max(low, min(mu.max() - 1e-6, top + 0.01)))}]

    return solvers.over_rows(moments, [], "c_min double, c_max double", solve)


def default_custom(iso: DataFrame) -> DataFrame:
    """Whole percents of the volatility rule's weights by largest remainder; the benchmark alone where it is infeasible."""
    names = ["w_ndx", "w_spx", "w_ust"]
    whole = solvers.apportion(iso, names, 100)
    return whole.select(*(F.when(F.col(c).isNull(), F.lit(1.0 if c == "w_spx" else 0.0)).otherwise(F.col(f"p_{c}") / 100).alias(c) for c in names))


def robust_variant(kind: str) -> str:
    """The tangency is always looked at levered, every other rule as it is."""
    return "levered" if kind == "tangency" else "unlevered"


def plan(rule: Rule) -> list[tuple[str, str, Rule]]:
    """(stage, what, rule) of a robustness job in order: three walk-forwards, the volatility rule's bootstrap, and what the active rule adds."""
    kinds = {k: Rule(kind=k, mu=rule.mu, vol_mult=rule.vol_mult, te_cap=rule.te_cap, spread=rule.spread, intercept=rule.intercept, c=rule.c) for k in ("isoVolTe", "maxSharpeCagrFloor", "tangency")}
    stages = [(f"wf:{k}", "walk_forward", r) for k, r in kinds.items()] + [("bs:isoVolTe", "bootstrap", kinds["isoVolTe"])]
    if rule.kind in ("maxSharpeCagrFloor", "tangency"):
        stages.append((f"bs:{rule.kind}", "bootstrap", kinds[rule.kind]))
    if rule.kind == "custom":
        stages.append(("wf:custom", "walk_forward", rule))
    return stages
