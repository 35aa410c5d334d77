"""Jobs: a parameter record is checked, resolved and run as one of four kinds.

Each kind has a key made of the parameters it depends on; ``Engine`` keeps a kind's frames while its key stays the same.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import PanelError
from ..functions.months import index_of, text_of
from ..operators import compare, portfolios, resample, rules, solvers, stats, windows
from ..operators import sample as S

KINDS = ("context", "sample", "alloc", "robust")
BASES, DIVIDENDS, RULES, MEANS = ("tr", "pr"), ("default", "low", "high"), ("isoVolTe", "maxSharpeCagrFloor", "tangency", "twoAsset", "custom"), ("hist", "y10bond")


@dataclass(frozen=True)
class Spec:
    """Parameters of a job; ``None`` for a month means the first or latest one."""

    start: str | None = None
    end: str | None = None
    basis: str = "tr"
    band: str = "default"
    wht: float = 0.0
    mu: str = "hist"
    rule: str = "isoVolTe"
    vol_mult: float = 1.0
    te_cap: float | None = 0.05
    spread: float = 0.005
    years: int = 10
    lookback: int = 120
    trailing: bool = True
    draws: int = 1000
    block: int = 24
    seed: int = 20260912
    steps: int = 100
    intercept: str = "implied"
    c: float | None = None
    year: str = "2022"
    m0: float | None = None
    w_ndx: float | None = None
    w_spx: float | None = None

    def checked(self) -> Spec:
        tests = [(self.basis, BASES), (self.band, DIVIDENDS), (self.rule, RULES), (self.mu, MEANS), (self.intercept, rules.INTERCEPTS)]
        if any(v not in allowed for v, allowed in tests):
            raise PanelError("E_BAD_RANGE", "unknown value")
        if not (0 <= self.wht <= 1 and 0 < self.vol_mult <= 5 and self.years > 0 and self.lookback >= 12 and 1 <= self.draws and self.steps > 0):
            raise PanelError("E_BAD_RANGE", "number out of range")
        if self.mu == "y10bond" and self.basis != "tr":
            raise PanelError("E_Y10_REQUIRES_TR", "the yield stands for a total return")
        if self.rule == "custom" and self.w_ndx is not None:
            solvers.normalise_weights([self.w_ndx, self.w_spx or 0.0, 1 - self.w_ndx - (self.w_spx or 0.0)])
        return self

    def as_rule(self) -> rules.Rule:
        w = None if self.w_ndx is None else (self.w_ndx, self.w_spx or 0.0, 1 - self.w_ndx - (self.w_spx or 0.0))
        return rules.Rule(self.rule, self.mu, self.vol_mult, self.te_cap, self.spread, self.intercept, self.c, w)

    def keys(self) -> dict[str, str]:
        """What each kind depends on, as canonical JSON."""
        d = asdict(self)
        basis = {k: d[k] for k in ("basis", "band", "wht")}
        rng = basis | {k: d[k] for k in ("start", "end")}
        rule = rng | {k: d[k] for k in ("mu", "rule", "vol_mult", "te_cap", "spread", "intercept", "c", "w_ndx", "w_spx")}
        parts = {
            "context": basis | {k: d[k] for k in ("years", "m0")},
            "sample": rng | {"steps": d["steps"], "seed": d["seed"]},
            "alloc": rule,
            "robust": rule | {k: d[k] for k in ("lookback", "trailing", "draws", "block", "seed", "year")},
        }
        return {k: json.dumps(v, sort_keys=True) for k, v in parts.items()}


def parse_query(query: str) -> Spec:
    """A URL query as parameters; unknown names and unreadable values are errors."""
    kinds, got = {f.name: f for f in fields(Spec)}, {}
    for name, text in parse_qsl(query.lstrip("?"), keep_blank_values=True):
        if name not in kinds:
            raise PanelError("E_BAD_RANGE", f"unknown parameter {name}")
        default = kinds[name].default
        try:
            if text == "":
                got[name] = None
            elif isinstance(default, bool):
                got[name] = {"true": True, "false": False}[text.lower()]
            elif isinstance(default, int):
                got[name] = int(text)
            elif isinstance(default, float) or name in ("m0", "c", "w_ndx", "w_spx"):
                got[name] = float(text)
            else:
                got[name] = text
        except (ValueError, KeyError):
            raise PanelError("E_BAD_RANGE", f"{name}={text}") from None
    return Spec(**got).checked()


def serialise(spec: Spec) -> str:
    """The parameters that differ from the defaults, as a query."""
    base = asdict(Spec())
    told = {k: "" if v is None else str(v).lower() if isinstance(v, bool) else repr(v) if isinstance(v, float) else v for k, v in asdict(spec).items() if v != base[k]}
    return urlencode(told)


def preset(latest: str, years: int | None) -> tuple[str | None, str]:
    """(start, end) of the last so many years, or of everything."""
    return (None if years is None else text_of(index_of(latest) - 12 * years)), latest


class Engine:
    """Runs jobs on one panel; a kind is computed anew only when its key has changed."""

    def __init__(self, panel: DataFrame):
        self.panel = panel.cache()  # a row a month
        self.done: dict[str, tuple[str, dict[str, DataFrame]]] = {}

    def run(self, kind: str, spec: Spec) -> dict[str, DataFrame]:
        if kind not in KINDS:
            raise PanelError("E_BAD_RANGE", kind)
        key = spec.checked().keys()[kind]
        if self.done.get(kind, ("",))[0] != key:
            self.done[kind] = (key, getattr(self, f"_{kind}")(spec))
        return self.done[kind][1]

    def _sample(self, spec: Spec) -> dict[str, DataFrame]:
        s = S.build(self.panel, spec.start, spec.end, spec.basis, spec.band, spec.wht)
        m = stats.moments(s)
        return {"head_to_head": compare.full_head_to_head(self.panel, spec.start, spec.end, spec.basis, spec.band, spec.wht, seed=spec.seed), "stats": stats.path_stats(S.long(s)), "relative_wealth": windows.relative_wealth(s), "moments": m, "frontier": solvers.frontier(m, []), "lattice": solvers.lattice(s, spec.steps), "references": solvers.evaluate(s, solvers.references(s.sparkSession))}

    def _context(self, spec: Spec) -> dict[str, DataFrame]:
        s = S.build(self.panel, basis=spec.basis, band=spec.band, wht=spec.wht)
        points = windows.rolling_excess(s, spec.years)
        lo, hi = self.panel.agg({"month": "min"}).first()[0], self.panel.agg({"month": "max"}).first()[0]
        ends = [lo, *(f"{y}-12" for y in range(int(lo[:4]) + 1, int(hi[:4]), 2)), hi]
        named = {k: compare.named_period_table(self.panel, b, spec.basis, spec.band, spec.wht) for k, b in (("regimes", compare.regimes(hi)), ("decades", compare.decades(hi)))}
        table = compare.periods(s.sparkSession, compare.chained(ends))
        return named | {"rolling": points, "rolling_summary": windows.rolling_summary(points), "losing_runs": windows.losing_runs(points), "periods": compare.period_table(s, table), "decomposition": compare.decomposition(self.panel, table, spec.band, spec.wht, spec.m0), "break_even": compare.break_even(self.panel), "coverage": windows.coverage(self.panel)}

    def _alloc(self, spec: Spec) -> dict[str, DataFrame]:
        s = S.build(self.panel, spec.start, spec.end, spec.basis, spec.band, spec.wht)
        m = solvers.with_mu(stats.moments(s), spec.mu)
        rule = spec.as_rule()
        iso, items = rules.iso_vol_items(m, [], spec.vol_mult, spec.te_cap), rules.tangency_items(m, [], rule)
        path, limits = solvers.optimise_path(s), rules.limit_path(m, [], spec.vol_mult)
        active = rules.weights(s.withColumn("g", F.lit(1)), ["g"], replace(rule, levered=False)) if rule.kind != "twoAsset" else None
        out = {
            "iso_vol": iso, "limit_path": limits, "flat_top": rules.flat_top(s, limits), "feasibility": solvers.feasibility(m, spec.vol_mult), "tangency": items, "path_bounds": rules.path_bounds(m, rule.c, spec.vol_mult),
            "kinked_line": solvers.kinked_line(m, [], spec.spread, spec.vol_mult), "path": path, "two_asset": solvers.two_asset_curve(s), "two_asset_roots": solvers.two_asset_roots(s), "two_asset_points": portfolios.two_asset_points(s),
            "portfolios": portfolios.asked(s, iso, items, path, spec.spread),
        }
        if active is not None:
            out["active"] = portfolios.held(s, active, spec.spread)
        return out

    def _robust(self, spec: Spec) -> dict[str, DataFrame]:
        full = S.build(self.panel, None, spec.end, spec.basis, spec.band, spec.wht)
        s = S.build(self.panel, spec.start, spec.end, spec.basis, spec.band, spec.wht)
        n, out = S.check(s), {}
        first = s.agg({"month": "min"}).first()[0]
        rule = spec.as_rule()
        if rule.kind == "custom" and rule.w is None:
            m = solvers.with_mu(stats.moments(s), spec.mu)
            rule = replace(rule, w=tuple(rules.default_custom(solvers.iso_vol(m, [], spec.vol_mult, spec.te_cap)).first()))
        for stage, what, r in rules.plan(rule):
            if what == "bootstrap":
                draws = resample.bootstrap_rule(s, n, min(spec.draws, resample.DRAWS[r.kind]), r, spec.block, spec.seed)
                out[stage] = draws
                out[f"{stage}:summary"] = resample.summarise_draws(draws, rules.robust_variant(r.kind) == "levered")
            else:
                w = resample.walk_forward_weights(full, spec.lookback, spec.trailing, r, first)
                out[f"{stage}:weights"] = w
                out[stage] = resample.walk_forward(full, spec.lookback, spec.trailing, r, first)
                out[f"{stage}:static"] = resample.walk_forward_static(full, w, r)
                out[f"{stage}:notes"] = resample.walk_forward_notes(w, resample.walk_forward_returns(full, w, r.spread), spec.year)
        return out
