"""Registered queries of the rules, the comparisons in full, backfills and the tables behind displays, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import compare, portfolios, resample, rules, solvers, stats
from .operators import sample as S
from .queries import (
    _DEC, _DRAW, _MODEL, _W, DRAWS, ENDS, LOOKBACK, ORACLE_SQL, STAT_COLS, _iso_in, _moments, _quad, iso_sql, long_sql, panel, path_sql, query, r, rr, sample_sql, smp, with_,
)
from .sources import backfill

TANGENCY = rules.Rule(kind="tangency")


# ---- SQL of intercepts, tangencies and the kinked line, for any number of ids
def moments_in(rows: str, key: str, name: str = "iso_in") -> str:
    """CTE of moments by id without a tracking-error limit, with cash and the last yield as a year's return."""
    cov = ", ".join(f"12 * covar_samp(r_{a}, r_{b}) as s{i}{j}" for i, a in enumerate(S.ASSETS, 1) for j, b in enumerate(S.ASSETS, 1) if j >= i)
    mu = ", ".join(f"12 * avg(r_{a}) as m{i}" for i, a in enumerate(S.ASSETS, 1))
    first = f"select {key} as id, {mu}, {cov}, 12 * avg(rf) as rf, pow(1 + arg_max(dgs10, t) / 2, 2) - 1 as y10 from {rows} group by {key}"
    return f"{name}0 as ({first}), {name} as (select *, s22 as vcap2, null::double as te2 from {name}0)"


def implied_ctes(source: str = "iso_in") -> list[str]:
    """CTEs that end in imp (id, kind, c_low, c_high, open_above): the intercept over which the mix of iso is the tangency."""
    row = lambda i: f"({i}, m{i}, " + " + ".join(f"s{min(i, j)}{max(i, j)} * w{j}" for j in (1, 2, 3)) + f", w{i})"
    bound = "(j.cw / i.cw * i.m - j.m) / (j.cw / i.cw - 1)"
    return [
        f"hold as (select i.id, v.a, v.m, v.cw, v.w from iso i join {source} s using (id), lateral (values {row(1)}, {row(2)}, {row(3)}) v(a, m, cw, w) where w1 is not null)",
        "fit as (select id, count(*) filter (where w > 1e-8) as held, regr_intercept(m, cw) filter (where w > 1e-8) as c, regr_slope(m, cw) filter (where w > 1e-8) as gamma, min(a) filter (where w > 1e-8) as i from hold group by id)",
        """fits as (select f.id, f.held, f.c, f.gamma, f.i, bool_and(case when w > 1e-8 then abs(m - c - gamma * cw) <= 1e-9 else m - c - gamma * cw <= 1e-9 end) as okay
  from fit f join hold h on h.id = f.id group by all)""",
        f"""vert as (select j.id, max({bound}) filter (where j.cw < i.cw) as low, least(any_value(i.m), min({bound}) filter (where j.cw > i.cw)) as high, any_value(i.m) as own
  from fit f join hold i on i.id = f.id and i.a = f.i join hold j on j.id = f.id and j.a <> f.i where f.held = 1 group by j.id)""",
        """imp0 as (select f.*, low, high, own, case when held >= 2 and okay and gamma > 1e-9 then 'point' when held = 1 and coalesce(low, -1e300) < high then 'interval' end as kind
  from fits f left join vert v using (id))""",
        """imp as (select s.id, kind, case kind when 'point' then c when 'interval' then low end as c_low, case kind when 'point' then c when 'interval' then high end as c_high,
  case kind when 'point' then false when 'interval' then high >= own - 1e-12 end as open_above from """ + source + " s left join imp0 using (id))",
    ]


def tangency_ctes(grid: str = "g", p: str = "t") -> list[str]:
    """CTEs that end in {p}an (id, k, c, status, weights, mean, vol, te, slope) from rows (id, k, c) of a grid and iso_in."""
    x = {i: f"(m{i} - c)" for i in (1, 2, 3)}
    zero, faces = "0.0::double", []
    face = lambda number, z: f"select id, k, c, {number} as face, {z[0]} as z1, {z[1]} as z2, {z[2]} as z3 from {p}in"
    for n, i in enumerate((1, 2, 3)):
        faces.append(face(n, tuple("1.0::double" if j == i else zero for j in (1, 2, 3))))
    for n, (i, j) in enumerate(((1, 2), (1, 3), (2, 3)), 3):
        det = f"(s{i}{i} * s{j}{j} - s{i}{j} * s{i}{j})"
        z = {i: f"(s{j}{j} * {x[i]} - s{i}{j} * {x[j]}) / {det}", j: f"(s{i}{i} * {x[j]} - s{i}{j} * {x[i]}) / {det}"}
        faces.append(face(n, tuple(z.get(k, zero) for k in (1, 2, 3))))
    adj = {(1, 1): "(s22 * s33 - s23 * s23)", (1, 2): "(s13 * s23 - s12 * s33)", (1, 3): "(s12 * s23 - s13 * s22)", (2, 2): "(s11 * s33 - s13 * s13)", (2, 3): "(s12 * s13 - s11 * s23)", (3, 3): "(s11 * s22 - s12 * s12)"}
    det = f"(s11 * {adj[1, 1]} + s12 * {adj[1, 2]} + s13 * {adj[1, 3]})"
    faces.append(face(6, tuple("(" + " + ".join(f"{adj[min(i, j), max(i, j)]} * {x[j]}" for j in (1, 2, 3)) + f") / {det}" for i in (1, 2, 3))))
    return [
        f"{p}in as (select i.*, gg.k, gg.c from {grid} gg join iso_in i using (id))",
        f"{p}faces as ({' union all '.join(faces)})",
        f"{p}w as (select id, k, c, face, greatest(z1, 0) as w1, greatest(z2, 0) as w2, greatest(z3, 0) as w3 from {p}faces where z1 + z2 + z3 > 0 and least(z1, z2, z3) / (z1 + z2 + z3) >= -1e-10)",
        f"{p}u as (select id, k, face, w1 / (w1 + w2 + w3) as w1, w2 / (w1 + w2 + w3) as w2, w3 / (w1 + w2 + w3) as w3 from {p}w)",
        f"{p}v as (select u.*, g.c, w1 * m1 + w2 * m2 + w3 * m3 as mean, {_quad('s', 'w', 'w')} as var, s12 * w1 + s22 * w2 + s23 * w3 as aw, s22 from {p}u u join {p}in g using (id, k))",
        f"{p}b as (select *, (mean - c) / sqrt(var) as slope, row_number() over (partition by id, k order by round((mean - c) / sqrt(var), 12) desc, face) as rk from {p}v where mean > c)",
        f"""{p}an as (select g.id, g.k, g.c, case when g.c is null then 'undefined' when b.k is null then 'no-premium' else 'ok' end as status, w1, w2, w3, mean, sqrt(var) as vol,
  case when b.k is not null then sqrt(greatest(var - 2 * aw + b.s22, 0)) end as te, slope from {p}in g left join {p}b b on b.id = g.id and b.k = g.k and b.rk = 1)""",
    ]


def line_ctes(spread: float = 0.005) -> list[str]:
    """CTEs that end in line (id, mode, weights, mean, vol, te, L, c_used, exp_return): the tangency levered to the benchmark's volatility."""
    pick = lambda c: f"case mode when 'lever' then b.{c} when 'delever' then l.{c} else i.{c} end as {c}"
    return [
        f"lg as (select id, 'b' as k, rf + {spread} as c from iso_in union all select id, 'l', rf from iso_in)",
        *tangency_ctes("lg", "ln"),
        """modes as (select s.id, s.rf, sqrt(s.vcap2) as target, case when b.status = 'ok' and sqrt(s.vcap2) >= b.vol then 'lever' when l.status = 'ok' and sqrt(s.vcap2) <= l.vol then 'delever'
  when i.w1 is not null then 'frontier' else 'infeasible' end as mode from iso_in s join lnan b on b.id = s.id and b.k = 'b' join lnan l on l.id = s.id and l.k = 'l' join iso i on i.id = s.id)""",
        f"""line0 as (select m.id, m.mode, m.rf, m.target, {', '.join(map(pick, ('w1', 'w2', 'w3', 'mean', 'vol', 'te')))}, case mode when 'lever' then m.rf + {spread} when 'delever' then m.rf else case when p.kind = 'point' then p.c_low end end as c_used
  from modes m join lnan b on b.id = m.id and b.k = 'b' join lnan l on l.id = m.id and l.k = 'l' join iso i on i.id = m.id join imp p on p.id = m.id)""",
        "line1 as (select *, case when mode = 'infeasible' then null when mode = 'frontier' then 1.0 else target / vol end as L from line0)",
        f"line as (select *, L * mean - (L - 1) * rf - greatest(L - 1, 0) * {spread} as exp_return from line1)",
    ]


_ONE = [sample_sql(), "one as (select 1 as g, * from smp)", moments_in("one", "g"), *iso_sql(), *implied_ctes()]
ORACLE_SQL["l6_implied_intercept"] = with_(*_ONE) + f" select {_W}, kind, {r('c_low', 'c_low')}, {r('c_high', 'c_high')}, open_above from imp join iso using (id)"
ORACLE_SQL["l11_kinked_line"] = with_(*_ONE, *line_ctes()) + f" select mode, {_W}, {r('L', 'L')}, {r('exp_return', 'exp_return')}, {r('c_used', 'c_used')} from line"

_ITEMS = with_(
    *_ONE, *line_ctes(),
    "tg as (select s.id, v.k, v.c from iso_in s join imp p using (id), lateral (values ('unlevered', p.c_low), ('rf', s.rf), ('y10', s.y10), ('implied', p.c_low)) v(k, c))",
    *tangency_ctes("tg"),
)


@query(
    "l17_tangency_rule",
    _ITEMS + f" select k as item, {r('c', 'c')}, status, {_MODEL}, {r('slope', 'slope')}, {r('null::double', 'L')}, null::varchar as mode, case when k in ('implied', 'unlevered') then kind end as kind, case when k in ('implied', 'unlevered') then coalesce(kind = 'interval' and open_above, false) end as at_least from tan join imp using (id)"
    + f" union all select 'levered', {r('c_used', 'c')}, case when mode = 'infeasible' then 'infeasible' else 'ok' end, {_MODEL}, null, {r('L', 'L')}, mode, null, null from line",
)
def tangency_rule(spark, d):
    return rules.tangency_items(_moments(spark, d), [])


@query("l18_path_bounds", with_(*_ONE, "v1 as (select id, greatest((s12 / s11 * m1 - m2) / (s12 / s11 - 1), (s13 / s11 * m1 - m3) / (s13 / s11 - 1)) as low, m1, m2, m3, rf, y10 from iso_in where s12 < s11 and s13 < s11)")
       + f" select {r('least(rf, y10, c_low) - 0.01', 'c_min')}, {r('greatest(least(rf, y10, c_low) - 0.01, least(greatest(m1, m2, m3) - 1e-6, coalesce(case when low < m1 then low end, greatest(m1, m2, m3)) + 0.01))', 'c_max')} from imp join v1 using (id)")
def path_bounds(spark, d):
    return rules.path_bounds(_moments(spark, d))


_LEV_MIX = "w1 * r_ndx + w2 * r_spx + w3 * r_ust"
_LEV = f"L * ({_LEV_MIX}) - (L - 1) * rf - greatest(L - 1, 0) * 0.005 / 12"


@query("l23_levered_tangency", with_(*_ONE, *line_ctes(), f"ser as (select 'levered' as series, t, month, L * ({_LEV_MIX}) - (L - 1) * smp.rf - greatest(L - 1, 0) * 0.005 / 12 as r, smp.rf as rf from smp, line)", path_sql())
       + f" select {STAT_COLS}, {r('(select exp(sum(ln(1 + r))) - 1 from ser where month like ' + chr(39) + '1999-%' + chr(39) + ')', 'year_1999')} from stats")
def levered_tangency(spark, d):
    s = smp(spark, d)
    w = rules.tangency_items(stats.moments(s), []).filter("item = 'levered'").select(F.col("item").alias("series"), "w_ndx", "w_spx", "w_ust", "L", F.lit(0.005).alias("spread"))
    rows = S.mix(s, w, leverage=True)
    year = S.calendar_returns(rows).filter("year = '1999'").select("series", F.col("ret").alias("year_1999"))
    return stats.path_stats(rows).join(year, "series", "left")


_SHIFTS = "(values ('rule', 0.0, 0.05), ('pure', 0.0, null), ('ndx_less_1', -0.01, 0.05), ('ndx_less_2', -0.02, 0.05)) v(item, shift, cap)"
_SHIFTED = [sample_sql(), "one as (select 1 as g, * from smp)", moments_in("one", "g", "base"), f"iso_in as (select item as id, m1 + shift as m1, m1 as m0, m2, m3, s11, s12, s13, s22, s23, s33, s22 as vcap2, pow(cap, 2)::double as te2 from base, {_SHIFTS})", *iso_sql()]


@query("l12_iso_vol_items", with_(*_SHIFTED) + f" select id as item, {_W}, {r('w1 * m0 + w2 * m2 + w3 * m3', 'mu')}, {rr('vol te')}, abs(vol * vol - vcap2) < 1e-10 * vcap2 as binds_vol, coalesce(te2 is not null and abs(te * te - te2) < 1e-10 * te2, false) as binds_te from iso join iso_in using (id)")
def iso_items(spark, d):
    return rules.iso_vol_items(_moments(spark, d), [])


_KS = [
    sample_sql(), "one as (select 1 as g, * from smp)", moments_in("one", "g", "base"), *iso_sql("base", "p"),
    """ks0 as (select te as free, v.k::double as k from piso, (select 0.01 + (te - 0.01) * i / 19 as k from piso, range(20) x(i)) v where te > 0.01 union all select te, te from piso where te <= 0.01),
  ks1 as (select distinct free, x as k from ks0, (values (0.02::double), (0.03), (0.04), (0.05)) v(x) where x <= free and not exists (select 1 from ks0 q where abs(q.k - v.x) < 1e-9)),
  ks as (select * from ks0 union all select * from ks1)""",
    "iso_in as (select k as id, m1, m2, m3, s11, s12, s13, s22, s23, s33, s22 as vcap2, case when k >= free - 1e-12 then null else k * k end as te2 from base, ks)",
    *iso_sql(),
]


@query("l12_limit_path", with_(*_KS) + f" select {r('id', 'k')}, {_MODEL} from iso where w1 is not null")
def limit_path(spark, d):
    return rules.limit_path(_moments(spark, d), [])


_GROW = lambda w: f"(select exp(12 * avg(ln(1 + {w}.w1 * r_ndx + {w}.w2 * r_spx + {w}.w3 * r_ust))) - 1 from smp)"


@query("l12_flat_top", with_(*_KS, "lo as (select * from iso where abs(id - 0.03) < 1e-9)", "hi as (select * from iso order by id desc limit 1)") + f" select 0.03::double as k_from, {r('hi.id', 'k_to')}, {r('lo.w1', 'ndx_from')}, {r('hi.w1', 'ndx_to')}, {r(_GROW('hi') + ' - ' + _GROW('lo'), 'cagr_gap')} from lo, hi where hi.id > 0.03")
def flat_top(spark, d):
    s = smp(spark, d)
    return rules.flat_top(s, rules.limit_path(stats.moments(s), []))


_YIELD = "mu_ust"


@query("c17_yield_mean", with_(sample_sql(end="2000-06")) + f" select {r('pow(1 + arg_max(dgs10, t) / 2, 2) - 1', 'y10')}, {r('pow(1 + arg_max(dgs10, t) / 2, 2) - 1 + 12 * var_samp(r_ust) / 2', 'mu_ust')} from smp")
def yield_mean(spark, d):
    return solvers.with_mu(stats.moments(smp(spark, d, end="2000-06")), "y10bond").select("y10", _YIELD)


@query("h6_default_custom", with_(sample_sql(), "one as (select 1 as g, * from smp)", _iso_in("one", "g"), *iso_sql(),
       "x as (select [round(w1 * 100, 9), round(w2 * 100, 9), round(w3 * 100, 9)] as v from iso)", "y as (select v, list_transform(v, lambda a : floor(a)) as f from x)",
       "z as (select *, 100 - list_sum(f) as miss, list_transform([1, 2, 3], lambda i : len(list_filter([1, 2, 3], lambda j : j <> i and (v[j] - f[j] > v[i] - f[i] or (v[j] - f[j] = v[i] - f[i] and j < i))))) as ahead from y)")
       + " select " + ", ".join(f"coalesce((f[{i}] + (ahead[{i}] < miss)::int) / 100.0, {1.0 if a == 'spx' else 0.0}) + 0.0 as w_{a}" for i, a in enumerate(S.ASSETS, 1)) + " from z")
def default_custom(spark, d):
    return rules.default_custom(solvers.iso_vol(_moments(spark, d), []))


# ---- bootstraps and walk-forwards by rule
_DRAWN = "rs as (select b, idx.m as t, r_ndx, r_spx, r_ust, rf, (select arg_max(dgs10, t) from smp) as dgs10 from idx join smp using (t))"
_BS = [*_DRAW, _DRAWN, moments_in("rs", "b"), *iso_sql(), *implied_ctes(), *line_ctes()]
_Q = lambda e, n: [r(f"quantile_cont({e}, {q})", f"{n}_p{round(100 * q)}") for q in (0.1, 0.5, 0.9)]
_SHARE = lambda n, c: r(f"avg(case when w1 is not null then ({c})::int end)", n)
ORACLE_SQL["m7_bootstrap_levered"] = (
    with_(*_BS) + " select count(w1) as n_feasible, " + ", ".join(x for i, a in enumerate(S.ASSETS, 1) for x in [*_Q(f"w{i}", f"w_{a}"), r(f"avg(w{i})", f"w_{a}_mean")])
    + ", " + ", ".join((_SHARE("p_ust_over_50", "w3 > 0.5"), _SHARE("p_spx_under_1", "w2 < 0.01"), _SHARE("p_corner", "greatest(w1, w2, w3) >= 0.99"), r("avg((w1 is null)::int)", "p_infeasible")))
    + ", " + ", ".join([*_Q("L", "L"), *(x for i, a in enumerate(S.ASSETS, 1) for x in _Q(f"L * w{i}", f"n_{a}"))]) + " from line"
)


@query("m7_bootstrap_path_rule")
def bootstrap_path_rule(spark, d):
    s = smp(spark, d)
    return resample.summarise_draws(resample.bootstrap_rule(s, s.count(), None, rules.Rule(kind="maxSharpeCagrFloor")))


_TAU = f"win as (select month as tau, t - {LOOKBACK} as lo, t - 1 as hi from smp where month like '%-01' and t > {LOOKBACK} and month > (select min(month) from smp)), est as (select tau, smp.* from win join smp on t between lo and hi)"
_WT = [sample_sql(), _TAU, moments_in("est", "tau"), *iso_sql(), *implied_ctes(), *line_ctes(), "wts as (select id as tau, coalesce(w1, 0.0) as w1, coalesce(w2, 1.0) as w2, coalesce(w3, 0.0) as w3, L, w1 is null as infeasible from line)"]
_HELD = "held as (select s.*, w1, w2, w3, coalesce(L, 1.0) as L from smp s asof join wts on s.month >= wts.tau)"
_OOS = "ser as (" + " union all ".join(f"select '{k}' as series, row_number() over (order by month) as t, month, {e} as r, rf from held" for k, e in {"rule": _LEV, **{k: f"{w[0]} * r_ndx + {w[1]} * r_spx + {w[2]} * r_ust" for k, w in solvers.REFERENCES.items()}}.items()) + ")"


@query("m8_tangency_weights", with_(*_WT) + f" select tau, {_W}, {r('L', 'L')}, infeasible from wts")
def tangency_weights(spark, d):
    return resample.walk_forward_weights(smp(spark, d), LOOKBACK, rule=TANGENCY)


@query("m8_walk_forward_tangency", with_(*_WT, _HELD, _OOS, path_sql()) + f" select {STAT_COLS}, case when n >= 36 then 'ok' else 'insufficient' end as status from stats")
def walk_tangency(spark, d):
    return resample.walk_forward(smp(spark, d), LOOKBACK, rule=TANGENCY)


@query("m8_walk_forward_notes", with_(*_WT, _HELD, _OOS, "yr as (select series, exp(sum(ln(1 + r))) - 1 as ret from ser where month like '2000-%' group by series having count(*) = 12)")
       + f" select count(*) as windows, count(*) filter (where infeasible) as infeasible_windows, count(*) filter (where w3 > 0.5) as ust_over_50_years, {r('min(L)', 'min_L')}, {r('max(L)', 'max_L')}, {r('arg_max(L, tau)', 'latest_L')}, min(tau) as first_oos, "
       + ", ".join(r(f"(select max(ret) from yr where series = '{k}')", f"{k}_year") for k in ("rule", "spx")) + " from wts")
def walk_notes(spark, d):
    s = smp(spark, d)
    w = resample.walk_forward_weights(s, LOOKBACK, rule=TANGENCY)
    return resample.walk_forward_notes(w, resample.walk_forward_returns(s, w), "2000")


@query("m8_walk_forward_static", with_(*_WT, "oos as (select 1 as g, smp.* from smp where month >= (select min(tau) from wts))", _iso_in("oos", "g", name="st_in"), *iso_sql("st_in", "q"), f"mx as (select {_LEV_MIX} as r, rf, w1, w2, w3 from oos, qiso)")
       + f" select 'static' as series, {r('any_value(w1)', 'w_ndx')}, {r('any_value(w2)', 'w_spx')}, {r('any_value(w3)', 'w_ust')}, null::double as L, 0.005::double as spread, count(*) as n, {r('exp(12 * avg(ln(1 + r))) - 1', 'cagr')}, {r('12 * avg(r)', 'mu')}, {r('sqrt(12) * stddev_samp(r)', 'vol')}, {r('sqrt(12) * avg(r - rf) / stddev_samp(r - rf)', 'sharpe')}, {r('exp(sum(ln(1 + r))) - 1', 'cum_return')} from mx")
def walk_static(spark, d):
    s = smp(spark, d)
    return resample.walk_forward_static(s, resample.walk_forward_weights(s, LOOKBACK))


# ---- head to head, periods, anchors
_AB = ORACLE_SQL["f9_alpha_beta_newey_west"]
_VAR = " union all ".join(f"select '{b}_{v}' as variant, exp(12 * avg(ln(1 + r_ndx))) - 1 as nc, sqrt(12) * avg(r_ndx - rf) / stddev_samp(r_ndx - rf) as ns, exp(12 * avg(ln(1 + r_spx))) - 1 as sc, sqrt(12) * avg(r_spx - rf) / stddev_samp(r_spx - rf) as ss from s{i}" for i, (b, v) in enumerate(compare.VARIANTS))
_F9 = _AB[_AB.index("ex as (select t, r_ndx - rf as y") : _AB.rindex(" select n, ")].replace("sums as", "nwsums as").replace("from sums", "from nwsums")


def _h2h_sql() -> str:
    three = lambda m, a, b, c: f"select '{m}' as measure, ({a})::double as ndx, ({b})::double as spx, ({c})::double as diff"
    pair = " , (select * from stats where series = 'ndx') n, (select * from stats where series = 'spx') s"
    rows = [three(m, f"n.{m}", f"s.{m}", f"n.{m} - s.{m}") + " from (select 1) x" + pair for m in compare.MEASURES]
    v = "(select * from vstats)"
    rows += [three("vol_matched_cagr", "v.cagr", "s.cagr", "v.cagr - s.cagr") + f" from {v} v" + pair, three("vol_matched_mdd", "v.mdd", "null", "null") + f" from {v} v", three("vol_matched_share", "a", "null", "null") + " from va"]
    rows += [three(m, e, "null", "null") + " from vv" for m, e in (("alpha_ann", "12 * alpha"), ("beta", "beta"), ("t_alpha", "alpha / sqrt(i00 * i00 * s00 + 2 * i00 * i01 * s01 + i01 * i01 * s11)"), ("r2", "r2"))]
    rows += [three(f"sharpe_difference_{k}", "null", "null", f"quantile_cont(d, {q})") + " from dd1" for k, q in (("low", 0.025), ("high", 0.975))]
    at = lambda variant, c: f"(select {c} from vr where variant = '{variant}')"
    rows += [three(f"price_{m}", at("pr_default", f"n{k}"), at("pr_default", f"s{k}"), f"{at('pr_default', f'n{k}')} - {at('pr_default', f's{k}')}") for m, k in (("cagr", "c"), ("sharpe", "s"))]
    add = {a: f"({at('tr_default', a + 'c')} - {at('pr_default', a + 'c')})" for a in "ns"}
    rows.append(three("dividends_add", add["n"], add["s"], f"{add['n']} - {add['s']}"))
    for b in ("low", "high"):
        rows += [three(f"band_{b}_cagr", at(f"tr_{b}", "nc"), "null", "null"), three(f"band_{b}_sharpe", at(f"tr_{b}", "ns"), "null", f"{at(f'tr_{b}', 'ns')} - {at(f'tr_{b}', 'ss')}")]
    sharpe = lambda c: f"sqrt(12) * avg({c} - rf) / stddev_samp({c} - rf)"
    return with_(
        *_DRAW, long_sql(assets=("ndx", "spx")), path_sql(), "va as (select stddev_samp(r_spx - rf) / stddev_samp(r_ndx - rf) as a from smp)",
        "vser as (select 'vm' as series, t, month, a * r_ndx + (1 - a) * rf as r, rf from smp, va)", path_sql("vser", "v"), _F9,
        f"dd1 as (select b, {sharpe('r_ndx')} - {sharpe('r_spx')} as d from idx join smp using (t) group by b)",
        *(sample_sql(f"s{i}", basis=b, band=v) for i, (b, v) in enumerate(compare.VARIANTS)), f"vr as ({_VAR})", "al as (" + " union all ".join(rows) + ")",
    ) + f" select measure, {rr('ndx spx diff', 7)} from al"


@query("n1_full_head_to_head", _h2h_sql(), 7)
def full_head_to_head(spark, d):
    return compare.full_head_to_head(panel(spark, d), draws=DRAWS)


def _named_sql(name: str, bounds) -> str:
    rows = ", ".join(f"('{i}', '{a}', {'null' if b is None else repr(b)})" for i, a, b in bounds)
    clipped = f"(select id, greatest(a, lo) as from_month, least(coalesce(b, hi), hi) as to_month from (values {rows}) v(id, a, b), (select min(month) as lo, max(month) as hi from hist))"
    side = lambda s, c: f"max({c}) filter (where asset = '{s}')"
    return with_(
        sample_sql(), f"per as (select * from {clipped} where from_month < to_month)",
        "ser as (select id || '|ndx' as series, row_number() over (partition by id order by t) as t, month, r_ndx as r, rf from smp join per on month > from_month and month <= to_month union all select id || '|spx', row_number() over (partition by id order by t), month, r_spx, rf from smp join per on month > from_month and month <= to_month)",
        path_sql(), "pv as (select *, split_part(series, '|', 1) as period, split_part(series, '|', 2) as asset from stats)",
    ) + " select period, max(n) as n, " + ", ".join(r(side(a, c), f"{a}_{k}", 7) for a in ("ndx", "spx") for k, c in (("cagr", "cagr"), ("cum", "cum_return"), ("mdd", "mdd"))) + ", " + ", ".join(r(f"case when max(n) >= 36 then {side(a, 'sharpe')} end", f"{a}_sharpe", 7) for a in ("ndx", "spx")) + f", max(n) < 36 as short, {r(side('ndx', 'cagr') + ' - ' + side('spx', 'cagr'), 'spread', 7)} from pv group by period"


@query("n2_regimes", _named_sql("regimes", compare.REGIMES), 7)
def regimes(spark, d):
    p = panel(spark, d)
    return compare.named_period_table(p, compare.regimes(p.agg(F.max("month")).first()[0]))


@query("n2_decades", _named_sql("decades", compare.chained([m or "9999-12" for m in compare.DECADES])), 7)
def decades(spark, d):
    p = panel(spark, d)
    return compare.named_period_table(p, compare.decades(p.agg(F.max("month")).first()[0]))


def _named_cells(sql: str) -> str:
    gap = "round(case when short then ndx_cum else ndx_cagr end - case when short then spx_cum else spx_cagr end, 6) + 0.0 as gap"
    return f"select period, n, short, {r('case when short then ndx_cum else ndx_cagr end', 'ndx', 6)}, {r('case when short then spx_cum else spx_cagr end', 'spx', 6)}, {gap}, {rr('ndx_sharpe spx_sharpe ndx_mdd spx_mdd', 6)} from ({sql})"


@query("p13_period_cells", _named_cells(_named_sql("regimes", compare.REGIMES).replace(", 7) + 0.0", ", 13) + 0.0")), 6)
def period_cells(spark, d):
    return portfolios.period_cells(regimes(spark, d))


_SEG = [("d1995", "1995-01", "1997-12", "bridge", "bridge"), ("d1998", "1997-12", "2000-12", "chart", "chart"), ("d2001", "2000-12", "2001-06", "chart", "label")]
_M0 = (0.8, 1.0, 1.3)
_TIERS = "anc as (select month, 'bridge' as tier, ndx_pe / spx_pe as M from hist union all select month, 'chart', ndx_pe / spx_pe * 1.04 from hist), lat as (select month, 'label' as tier, ndx_pe / spx_pe * 1.1 as M from hist where month = '2001-06')"
_SHOWN = "(part = 'full' and abs(ln_r) >= 0.1 and abs(100 * ln_r / years) >= 1)"
_ANCHORED = with_(
    sample_sql(), _TIERS, "seg as (select * from (values " + ", ".join(map(str, _SEG)) + ") v(id, from_month, to_month, from_tier, to_tier))",
    "cum as (select h.month, sum(coalesce((ln(1 + s.r_ndx) - ln(1 + h.ndx_pr)) - (ln(1 + s.r_spx) - ln(1 + h.spx_pr)), 0)) over (order by h.t rows unbounded preceding) as D, h.NDX / h.SPX as R, h.mi from hist h left join smp s using (month))",
    "allm as (select month, tier, M from anc union all select month, tier, M from lat where (month, tier) not in (select (month, tier) from anc))",
    """sg as (select 'segment' as part, seg.id, seg.from_month, seg.to_month, seg.from_tier, seg.to_tier, seg.from_tier <> seg.to_tier as splice, a.M as m_start, b.M as m_end, x.R as Ra, y.R as Rb, y.D - x.D as ln_d, (y.mi - x.mi) / 12.0 as years
  from seg join allm a on a.month = from_month and a.tier = from_tier join allm b on b.month = to_month and b.tier = to_tier join cum x on x.month = from_month join cum y on y.month = to_month)""",
    f"""fl as (select 'full' as part, 'full' as id, min(from_month) as from_month, max(to_month) as to_month, arg_min(from_tier, from_month) as from_tier, (select tier from lat) as to_tier, false as splice, {_M0[1]}::double as m_start, (select M from lat) as m_end,
  arg_min(Ra, from_month) as Ra, arg_max(Rb, to_month) as Rb, sum(ln_d) as ln_d, sum(years) as years from sg)""",
    "tw as (select *, ln(Rb / Ra) as ln_r, ln(m_end / m_start) as ln_m from (select * from sg union all select * from fl))",
    "gap as (select sum(case when part = 'full' then ln_m else -ln_m end) as g, max(years) filter (where part = 'full') as y from tw)",
)
_BAND = [f"(ln_r - ln(m_end / {m})) / ln_r" for m in (_M0[0], _M0[2])]
_MAT = "abs(ln_r) >= 0.1 and abs(100 * ln_r / years) >= 1"
_ANCHORED += (
    " select part, id, from_month, to_month, from_tier, to_tier, splice, " + rr("m_start m_end years") + ", " + ", ".join(r(f"100 * {e} / years", f"{n}_lp_yr") for n, e in (("price", "ln_r"), ("pe", "ln_m"), ("eps", "(ln_r - ln_m)"), ("div", "ln_d"), ("tr", "(ln_r + ln_d)")))
    + f", {r(f'case when {_MAT} then ln_m / ln_r end', 'pe_share')}, {r(f'case when {_MAT} then (ln_r - ln_m) / ln_r end', 'eps_share')}, {r('case when abs(ln_r + ln_d) >= 0.1 and abs(100 * (ln_r + ln_d) / years) >= 1 then ln_d / (ln_r + ln_d) end', 'div_share_tr')}"
    + f", {r(f'case when {_SHOWN} then least({_BAND[0]}, {_BAND[1]}) end', 'eps_share_low')}, {r(f'case when {_SHOWN} then greatest({_BAND[0]}, {_BAND[1]}) end', 'eps_share_high')} from tw"
    + f" union all select 'splice', 'splice', null, null, null, null, null, null, null, {r('y', 'years')}, null, {r('100 * g / y', 'a')}, {r('-100 * g / y', 'b')}, null, null, null, null, null, null, null from gap"
)


@query("n4_anchored_decomposition", _ANCHORED)
def anchored(spark, d):
    p = panel(spark, d)
    m = F.col("ndx_pe") / F.col("spx_pe")
    anchors = p.select("month", F.lit("bridge").alias("tier"), m.alias("M")).unionByName(p.select("month", F.lit("chart").alias("tier"), (m * 1.04).alias("M")))
    latest = p.filter("month = '2001-06'").select("month", F.lit("label").alias("tier"), (m * 1.1).alias("M"))
    segments = spark.createDataFrame(_SEG, "id string, from_month string, to_month string, from_tier string, to_tier string")
    return compare.anchored_decomposition(p, anchors, latest, segments, _M0)


_GAPS = [("a", "1995-01", "1997-06"), ("b", "1998-02", "2000-12")]
ORACLE_SQL["f22_chain_gap"] = (
    with_("pts as (select month, ndx_pe / spx_pe as M, NDX / SPX as R from hist)", "pr as (select * from (values " + ", ".join(map(str, [*_GAPS, ("full", "1995-01", "2000-12")])) + ") v(id, a, b))",
          "x as (select id, ln(q.R / p.R) as ln_r, ln(q.M / p.M) as ln_m from pr join pts p on p.month = pr.a join pts q on q.month = pr.b)")
    + f" select {r('100 * sum(case when id = ' + chr(39) + 'full' + chr(39) + ' then ln_r else -ln_r end)', 'price')}, {r('100 * sum(case when id = ' + chr(39) + 'full' + chr(39) + ' then ln_m else -ln_m end)', 'pe')} from x"
)


@query("f22_chain_gap", ORACLE_SQL["f22_chain_gap"])
def chain_gap(spark, d):
    """Segments that leave months out between them: the gap is what those months moved."""
    p = panel(spark, d)
    parts = compare.decomposition(p, compare.periods(spark, _GAPS))
    return compare.chain_gap(parts, compare.decomposition(p, compare.periods(spark, [("full", "1995-01", "2000-12")])))


@query("k3_date_adjusted_anchor", with_("x as (select h.NDX as n, h.SPX as s, g.NDX as n0, g.SPX as s0 from hist h, hist g where h.month = '2000-12' and g.month = '2000-10')") + f" select {r('1.2 * (n / s) / (n0 / s0)', 'M')}, true as verified from x")
def date_adjusted(spark, d):
    p = panel(spark, d)
    closes = p.select(F.last_day(F.concat("month", F.lit("-01")).cast("date")).alias("date"), (F.col("NDX") + 0.001).alias("ndx"), F.col("SPX").alias("spx"))
    closes = closes.withColumn("ndx", F.when(F.month("date") == 10, F.col("ndx") - 0.001).otherwise(F.col("ndx")))
    end = p.filter("month = '2000-12'").select("NDX", "SPX").first()
    return compare.date_adjusted_anchor(1.2, (end[0], end[1]), closes, "2000-12-31", "2000-10-31")


# ---- backfills
_YIELDS = {1995: None, 1996: 1.9, 1997: 1.7, 1998: None, 1999: 1.2}
_C13 = with_(
    "y as (select * from (values " + ", ".join(f"({k}, {'null' if v is None else v}::double)" for k, v in _YIELDS.items()) + ") v(year, dy))",
    "x as (select month, NDX, n0, cast(substr(month, 1, 4) as int) as year from lagged where month between '1995-02' and '1999-03')",
    "z as (select x.*, coalesce(dy, 1.9) as base, dy is null as assumed, (select NDX from lagged l where l.month = x.year || '-12') as dec from x left join y using (year))",
)


@query("c13_dividend_spread", _C13 + f" select month, {r('NDX', 'NDX')}, {r('NDX / n0 - 1', 'ndx_pr')}, " + ", ".join(r(f"base * {k} / 100 * dec / 12 / n0", f"ndx_div_{b}") for b, k in backfill.BANDS.items()) + f", {r('base / 1200', 'flat')}, assumed from z")
def dividend_spread(spark, d):
    yields = spark.createDataFrame(list(_YIELDS.items()), "year int, dividend_yield_pct double")
    return backfill.dividend_spread(panel(spark, d).select("month", "NDX"), yields, "1995-02", "1999-03", 1996)


@query("c14_constructed_returns", with_("lvl as (select month, SPX * (1 + 0.001 * t) as level, case when month = '1998-01' then SPX * (1 + 0.001 * t) * 1.01 end as observed from hist)", "q as (select month, coalesce(observed, level) / lag(level) over (order by month) - 1 as x from lvl)") + f" select month, {r('x', 'spx_tr_con')} from q where month between '1995-02' and '1998-01'")
def constructed(spark, d):
    levels = panel(spark, d).select("month", (F.col("SPX") * (1 + 0.001 * F.col("t"))).alias("level"))
    observed = levels.filter("month = '1998-01'").select("month", (F.col("level") * 1.01).alias("observed"))
    return backfill.constructed_returns(levels, observed, "1995-02", "1998-01")


@query("e2_attached_backfills", _C13 + f", lvl as (select month, SPX * (1 + 0.001 * t) as level from hist), q as (select month, level / lag(level) over (order by month) - 1 as x from lvl) select h.month, {r('base / 100 * dec / 12 / z.n0', 'ndx_div_default')}, {r('case when h.month between ' + chr(39) + '1995-02' + chr(39) + ' and ' + chr(39) + '1998-01' + chr(39) + ' then x end', 'spx_tr_con')} from hist h left join z using (month) left join q using (month)")
def attached(spark, d):
    p = panel(spark, d)
    con = backfill.constructed_returns(p.select("month", (F.col("SPX") * (1 + 0.001 * F.col("t"))).alias("level")), p.limit(0).select("month", F.col("SPX").alias("observed")), "1995-02", "1998-01")
    return backfill.attach(p, dividend_spread(spark, d), con).select("month", "ndx_div_default", "spx_tr_con")


_RULES = {
    "overlap_ndx": "d.ndx_div_default is not null and ndx_tr is not null", "overlap_spx": "d.spx_tr_con is not null and spx_tr is not null", "constructed_under_price": "d.spx_tr_con is not null and d.spx_tr_con < spx_pr",
    "missing": "t > 0 and (coalesce(ndx_tr, ndx_pr + d.ndx_div_default) is null or coalesce(spx_tr, d.spx_tr_con) is null or bond_tr is null or RF is null)",
}


@query("d9_problems", ORACLE_SQL["e2_attached_backfills"].replace(" select h.month, round", " , d as (select h.month, round", 1) + ") " + " union all ".join(f"select month, '{k}' as rule from hist join d using (month) where {w}" for k, w in _RULES.items()))
def data_problems(spark, d):
    p = panel(spark, d)
    con = backfill.constructed_returns(p.select("month", (F.col("SPX") * (1 + 0.001 * F.col("t"))).alias("level")), p.limit(0).select("month", F.col("SPX").alias("observed")), "1995-02", "1998-01")
    return backfill.problems(backfill.attach(p, dividend_spread(spark, d), con))


# ---- tables behind displays
_STACK = "(values ('low', -0.06::double), ('a', -0.0123), ('b', 0.0), ('mid', 0.01234), ('high', 0.09)) v(label, x)"


@query("p4_stacked_table", ORACLE_SQL["l5_tangency_path"].rsplit(" select k, ", 1)[0]
       + ", pts as (select c as x, w1, w2, w3 from o where w1 is not null), nx as (select *, lead(x) over (order by x) as x1, " + ", ".join(f"lead(w{i}) over (order by x) as v{i}" for i in (1, 2, 3)) + " from pts)"
       + f", want as (select * from {_STACK}), met as (select want.label, want.x as pt, nx.* from want asof left join nx on want.x >= nx.x)"
       + f", fin as (select label, pt, coalesce(x, (select min(x) from pts)) as x0, x1, " + ", ".join(f"coalesce(w{i}, (select arg_min(w{i}, x) from pts)) as w{i}, v{i}" for i in (1, 2, 3)) + " from met)"
       + f" select label, {r('pt', 'x')}, " + ", ".join(r(f"case when x1 is null or pt <= x0 then w{i} else w{i} + (pt - x0) / (x1 - x0) * (v{i} - w{i}) end", f"w_{a}") for i, a in enumerate(S.ASSETS, 1)) + " from fin")
def stacked(spark, d):
    path = solvers.tangency_path(_moments(spark, d), -0.05, 0.08, 0.0005).filter("w_ndx is not null").withColumnRenamed("c", "x")
    wanted = spark.createDataFrame([("low", -0.06), ("a", -0.0123), ("b", 0.0), ("mid", 0.01234), ("high", 0.09)], "label string, x double")
    return portfolios.stacked_table(path, wanted)


_GUIDES = [("one", 0.3137), ("two", 0.9999)]
_P8 = ", ".join([*(f"('guide', '{n}', {x}::double)" for n, x in _GUIDES), *(f"('tenth', '{10 * k}', {k / 10}::double)" for k in range(11))])


@query("p8_two_asset_table", f"with cur as ({ORACLE_SQL['l19_two_asset_curve']}), want as (select * from (values {_P8}) v(part, label, pt)), best as (select part, label, arg_min(k, (round(abs(x - pt), 12), k)) as k from want, cur group by part, label) select part, label, cur.* from best join cur using (k)", 7)
def two_asset_table(spark, d):
    return portfolios.two_asset_table(solvers.two_asset_curve(smp(spark, d)), spark.createDataFrame(_GUIDES, "label string, x double"))


@query("p10_weight_table", with_(*_DRAW, "rs as (select b, r_ndx, r_spx, r_ust from idx join smp using (t))", _iso_in("rs", "b"), *iso_sql(), "one as (select 1 as g, * from smp)", _iso_in("one", "g", name="o_in"), *iso_sql("o_in", "o"),
       "x as (select [w1, w2, w3] as w, [round(w1 * 100, 9), round(w2 * 100, 9), round(w3 * 100, 9)] as v from oiso)", "y as (select *, list_transform(v, lambda a : floor(a)) as f from x)",
       "z as (select *, 100 - list_sum(f) as miss, list_transform([1, 2, 3], lambda i : len(list_filter([1, 2, 3], lambda j : j <> i and (v[j] - f[j] > v[i] - f[i] or (v[j] - f[j] = v[i] - f[i] and j < i))))) as ahead from y)")
       + " " + " union all ".join(f"select '{a}' as asset, {r(f'w[{i}]', 'weight')}, (f[{i}] + (ahead[{i}] < miss)::int)::bigint as percent, " + ", ".join(r(f"(select quantile_cont(w{i}, {q}) from iso)", f"p{round(100 * q)}") for q in (0.1, 0.5, 0.9)) + " from z" for i, a in enumerate(S.ASSETS, 1)))
def weight_table(spark, d):
    s = smp(spark, d)
    return portfolios.weight_table(solvers.iso_vol(stats.moments(s), []), resample.summarise_draws(resample.bootstrap_rule(s, s.count(), DRAWS)))


_BARS = ("price_lp_yr", "pe_lp_yr", "eps_lp_yr", "div_lp_yr", "tr_lp_yr")
_BARCOL = {"price_lp_yr": "ln_r", "pe_lp_yr": "ln_m", "eps_lp_yr": "ln_e", "div_lp_yr": "ln_d", "tr_lp_yr": "ln_t"}


@query("p14_bar_table", _DEC + ", cells as (" + " union all ".join(f"select id, '{c}' as col, 100 * {e} / years as value from dec" for c, e in _BARCOL.items()) + "), m as (select col, greatest(1e-9, max(abs(value))) as m, min(value) as a, max(value) as b from cells group by col), e as (select col, least(0, a, -0.05 * m) as lo, greatest(0, b, 0.05 * m) as hi from m)"
       + f" select id, col as \"column\", {rr('value lo hi')}, {r('100 * (least(value, 0) - lo) / (hi - lo)', 'left')}, {r('100 * abs(value) / (hi - lo)', 'width')} from cells join e using (col)")
def bar_table(spark, d):
    return portfolios.bar_table(compare.decomposition(panel(spark, d), compare.periods(spark, compare.chained(ENDS))), _BARS)


def _asked(spark, d):
    s = smp(spark, d)
    m = stats.moments(s)
    return s, portfolios.asked(s, rules.iso_vol_items(m, []), rules.tangency_items(m, []), solvers.optimise_path(s, ("maxSharpeAtLeastSpxCagr",)))


@query("l21_asked_portfolios", places=5)
def asked_portfolios(spark, d):
    return _asked(spark, d)[1]


@query("l19_two_asset_points")
def two_asset_points(spark, d):
    return portfolios.two_asset_points(smp(spark, d))


@query("p15_out_of_sample", places=5)
def out_of_sample(spark, d):
    s, table = _asked(spark, d)
    walks = {}
    for kind in ("isoVolTe", "tangency", "maxSharpeCagrFloor"):
        rule = rules.Rule(kind=kind)
        walks[kind] = (resample.walk_forward(s, 24, rule=rule), resample.walk_forward_weights(s, 24, rule=rule))
    return portfolios.out_of_sample(table, walks).select("place", "id", "group", "oos_cagr", "infeasible_windows")


@query("p16_active_result", with_(*_ONE, "tg as (select id, 'unlevered' as k, c_low as c from imp)", *tangency_ctes("tg"), f"ser as (select 'active' as series, t, month, {_LEV_MIX} as r, rf from smp, tan where w1 is not null)", path_sql())
       + f" select s.series, {_W}, {', '.join(r('s.' + c, c) for c in ('cagr', 'vol', 'sharpe', 'mdd'))}, s.n from stats s, tan")
def active_result(spark, d):
    s = smp(spark, d)
    w = rules.weights(s.withColumn("g", F.lit(1)), ["g"], rules.Rule(kind="tangency", levered=False))
    return portfolios.held(s, w).select("series", "w_ndx", "w_spx", "w_ust", "cagr", "vol", "sharpe", "mdd", "n")


@query("p3_frontier_table")
def frontier_table(spark, d):
    m = _moments(spark, d)
    markers = solvers.iso_vol(m, []).select(F.lit("iso").alias("label"), "w_ndx", "w_spx", "w_ust", "mu", "vol")
    assets = m.select(F.explode(F.array(*(F.struct(F.lit(a).alias("label"), F.col(f"mu_{a}").alias("mu"), F.sqrt(f"cov_{a}_{a}").alias("vol")) for a in S.ASSETS))).alias("x")).select("x.*")
    return portfolios.frontier_table(solvers.frontier(m, [], 121), markers, assets)


_POINTS = "pts as (select row_number() over (order by round(r_spx, 6), month) as n, month as id, round(r_spx, 6) as x from smp)"
ORACLE_SQL["i6_merge_near"] = with_(sample_sql(), _POINTS).replace("with ", "with recursive ", 1) + """, walk as (select n, id, x, x as lead_x from pts where n = 1 union all
  select p.n, p.id, p.x, case when p.x - w.lead_x <= 2e-3 then w.lead_x else p.x end from walk w join pts p on p.n = w.n + 1)
  select string_agg(id, '+' order by n) as id, round(lead_x, 10) + 0.0 as x from walk group by lead_x"""

