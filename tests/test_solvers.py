"""Exact solvers are never beaten by a grid; draws and windows are what a plain loop gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.errors import PanelError
from panelforge.functions import rng
from panelforge.operators import geometry as G
from panelforge.operators import resample, solvers, stats
from panelforge.operators import sample as S
from panelforge.plans.engine import Engine, Spec, parse_query, serialise
from panelforge.queries import panel
from test_stats import sample_of

GRID = np.array([(i, j, 100 - i - j) for i in range(101) for j in range(101 - i)]) / 100


def cases(n=40):
    r = np.random.default_rng(11)
    for _ in range(n):
        a = r.normal(size=(3, 3)) * [0.2, 0.15, 0.06]
        cov = a.T @ a + np.diag([0.01, 0.005, 0.001])
        yield r.normal([0.12, 0.09, 0.04], 0.05), cov


def test_max_return_dominates_the_grid():
    for mu, cov in cases():
        for te in (None, 0.05, 0.15):
            cap = cov[1, 1] ** 0.5
            w = G.iso_vol(mu, cov, 1.0, te)
            d = GRID - G.SPX
            ok = np.einsum("ij,jk,ik->i", GRID, cov, GRID) <= cap**2 + 1e-12
            if te is not None:
                ok &= np.einsum("ij,jk,ik->i", d, cov, d) <= te**2 + 1e-12
            assert w is not None and w.min() >= 0 and w.sum() == pytest.approx(1)
            assert w @ cov @ w <= cap**2 + 1e-9 and (te is None or (w - G.SPX) @ cov @ (w - G.SPX) <= te**2 + 1e-9)
            assert w @ mu >= (GRID[ok] @ mu).max() - 1e-9


def test_frontier_tangency_and_feasibility_dominate_the_grid():
    for mu, cov in cases(15):
        var = np.einsum("ij,jk,ik->i", GRID, cov, GRID)
        line = G.frontier(mu, cov, 21)
        assert line[0] @ cov @ line[0] <= var.min() + 1e-12
        means = [w @ mu for w in line]
        assert means == sorted(means) and means[-1] == pytest.approx(mu.max())
        for w in line[1:-1]:
            assert w @ cov @ w <= var[GRID @ mu >= w @ mu].min() + 1e-9
        status, w = G.tangency(mu, cov, 0.01)
        slope = (GRID @ mu - 0.01) / np.sqrt(var)
        if status == "ok":
            assert (w @ mu - 0.01) / np.sqrt(w @ cov @ w) >= slope.max() - 1e-9
            found = G.implied_intercept(mu, cov, w)
            assert found and (found[0] == "interval" or found[1] == pytest.approx(0.01, abs=1e-7))
        d = GRID - G.SPX
        te = np.einsum("ij,jk,ik->i", d, cov, d)
        f = G.feasibility(cov)
        assert f["vol_mult_free"] * cov[1, 1] ** 0.5 <= var.min() ** 0.5 + 1e-9
        assert f["vol_mult_te_5"] * cov[1, 1] ** 0.5 <= var[te <= 0.05**2].min() ** 0.5 + 1e-9
        assert f["min_te"] <= 1e-9  # the benchmark itself is under its own cap
    assert G.tangency(np.array([0.0, 0.0, 0.0]), np.eye(3), 0.01)[0] == "no-premium"
    assert G.iso_vol(np.ones(3), np.diag([1.0, 0.01, 1.0]), 0.5, 0.0) is None


def test_kinked_line():
    for mu, cov in cases(15):
        for vol in (0.03, 0.1, 0.4):
            k = G.kinked_line(mu, cov, 0.02, 0.01, vol)
            if k["mode"] == "infeasible":
                continue
            sd = (k["w"] @ cov @ k["w"]) ** 0.5
            assert k["L"] * sd <= vol + 1e-9
            assert (k["mode"] == "lever") == (k["L"] > 1 + 1e-12) or k["L"] == pytest.approx(1)


def test_path_objectives(spark):
    r = np.random.default_rng(2)
    x = r.normal(0.007, 0.04, (120, 3)) * [1.3, 1, 0.4] + [0.002, 0, 0]
    rf = np.full(120, 0.002)
    p = G.Path(x, rf)
    g0, s0 = p.growth(G.SPX[None])[0], p.sharpe(G.SPX[None])[0]
    g, s = p.growth(GRID), p.sharpe(GRID)
    got = {r.objective: r for r in solvers.optimise_path(sample_of(spark, x, rf)).collect()}
    assert got["maxSharpe"].sharpe >= s.max() - 1e-9
    assert got["maxSharpeAtLeastSpxCagr"].sharpe >= s[g >= g0].max() - 1e-6 and got["maxSharpeAtLeastSpxCagr"].cagr >= g0 - 1e-9
    assert got["maxCagrAtLeastSpxSharpe"].cagr >= g[s >= s0].max() - 1e-6
    assert got["equalSpxCagr"].cagr == pytest.approx(g0, abs=1e-4)


def test_random_numbers(spark):
    def plain(seed, n):
        a, out = seed, []
        for _ in range(n):
            a = (a + 0x6D2B79F5) & 0xFFFFFFFF
            t = ((a ^ (a >> 15)) * (a | 1)) & 0xFFFFFFFF
            t = ((t + (((t ^ (t >> 7)) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF) ^ t
            out.append((t ^ (t >> 14)) / 4294967296)
        return out

    bk = spark.range(6).select(F.col("id").alias("b")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(19))))
    got = rng.with_uniform(bk.withColumn("s", rng.draw_seed(42, F.col("b"))), "u", F.col("s"), F.col("k")).collect()
    for b in range(6):
        seed = 42 ^ ((b + 1) * 0x9E3779B1 & 0xFFFFFFFF)
        want = plain(seed, 20)
        assert [r.u for r in sorted((r for r in got if r.b == b), key=lambda r: r.k)] == want


def test_draws_do_not_depend_on_chunks(spark):
    few, many = (sorted(map(tuple, resample.block_indices(spark, 30, n, seed=9).filter("b < 5").collect())) for n in (5, 50))
    assert few == many and len(few) == 150 and {t for _, _, t in few} <= set(range(1, 31))
    assert resample.effective_block(30) == 7 and resample.effective_block(3) == 1


def test_walk_forward_looks_back_only(spark):
    r = np.random.default_rng(4).normal(0.006, 0.04, (96, 3))
    rf = np.full(96, 0.002)
    changed = r.copy()
    changed[72:] *= -2
    a, b = ({x.tau: x for x in resample.walk_forward_weights(sample_of(spark, v, rf), 36).collect()} for v in (r, changed))
    early = [t for t in a if t < "2006-01"]
    assert early and all(a[t] == b[t] for t in early)
    out = resample.walk_forward(sample_of(spark, r, rf), 36).collect()
    assert {x.series for x in out} == {"rule", *solvers.REFERENCES} and {x.n for x in out} == {60}


def test_rules_over_a_panel(spark, sf):
    p = panel(spark, sf)
    with pytest.raises(PanelError):
        S.check(S.build(p, "2001-09"))
    with pytest.raises(PanelError):
        S.build(p, basis="xx")
    assert S.check(S.build(p)) == p.count() - 1
    m = stats.moments(S.build(p))
    w = solvers.iso_vol(m, []).first()
    assert w.status == "ok" and w.w_ndx + w.w_spx + w.w_ust == pytest.approx(1)


def test_engine_keeps_what_has_not_changed(spark, sf):
    e = Engine(panel(spark, sf))
    spec = Spec(steps=4, draws=5, lookback=24, years=2)
    a = e.run("sample", spec)
    assert e.run("sample", Spec(steps=4, draws=9, lookback=24, years=2)) is a and e.run("sample", Spec(steps=5)) is not a
    for kind in ("context", "alloc", "robust"):
        for name, df in e.run(kind, spec).items():
            assert df.limit(3).collect() is not None, name


def test_queries_as_urls():
    spec = Spec(start="1996-01", basis="pr", te_cap=None, trailing=False, steps=10, m0=1.5)
    assert parse_query(serialise(spec)) == spec and parse_query("") == Spec()
    for bad in ("nothing=1", "steps=x", "basis=zz", "basis=pr&mu=y10bond"):
        with pytest.raises(PanelError):
            parse_query(bad)
    with pytest.raises(PanelError):
        solvers.normalise_weights([0.5, 0.2, 0.2])
    assert solvers.normalise_weights([50, 30, 20]) == [0.5, 0.3, 0.2]


def test_apportion(spark):
    df = spark.createDataFrame([(1 / 3, 1 / 3, 1 / 3), (0.126, 0.255, 0.619)], "a double, b double, c double")
    rows = [tuple(r)[3:] for r in solvers.apportion(df, ["a", "b", "c"]).collect()]
    assert rows[0] == (34, 33, 33) and all(sum(r) == 100 for r in rows)
