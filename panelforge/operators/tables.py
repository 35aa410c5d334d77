"""Tables behind displays: picked rows, snapped points, roundings that still add up, contour segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def add_up(df: DataFrame, total: str, terms: list[str], places: int = 2) -> DataFrame:
    """Rounds a total and its terms so that the terms still add up: the term that moves least takes the miss. Columns ``s_<name>``."""
    unit = 10**places
    scaled = {c: F.col(c) * unit for c in [total, *terms]}
    whole = {c: F.round(v).cast("long") for c, v in scaled.items()}
    miss = whole[total] - sum((whole[c] for c in terms[1:]), whole[terms[0]])
    direction = F.signum(miss)
    cost = {c: F.abs(whole[c] + direction - scaled[c]) for c in terms}
    order = {c: sum(((cost[d] < cost[c]) | ((cost[d] == cost[c]) & F.lit(terms.index(d) < terms.index(c)))).cast("int") for d in terms if d != c) for c in terms}
    out = {f"s_{total}": whole[total] / unit}
    for c in terms:
        out[f"s_{c}"] = (whole[c] + F.when(order[c] == 0, miss).otherwise(0)) / unit
    return df.withColumns(out)


def to_xy(w: list[Column]) -> tuple[Column, Column]:
    """Barycentric weights to a plane with unit sides: first asset at the right, second on top, third at the left."""
    return w[0] + w[1] / 2, w[1] * (3**0.5 / 2)


def to_weights(x: Column, y: Column) -> tuple[Column, Column, Column]:
    spx = y / (3**0.5 / 2)
    ndx = x - spx / 2
    return ndx, spx, 1 - ndx - spx


def ternary_table(points: DataFrame, steps: int, every: int) -> DataFrame:
    """Lattice points on a coarser grid."""
    return points.filter((F.col("i") % every == 0) & (F.col("j") % every == 0))


def lookup(points: DataFrame, markers: DataFrame, steps: int) -> DataFrame:
    """Lattice values at markers (``id`` and weights), snapped by largest remainder."""
    from .solvers import apportion

    snapped = apportion(markers, ["w_ndx", "w_spx", "w_ust"], steps)
    return snapped.join(points, (F.col("p_w_ndx") == F.col("i")) & (F.col("p_w_spx") == F.col("j"))).drop("p_w_ndx", "p_w_spx", "p_w_ust")


def contour_segments(points: DataFrame, steps: int, column: str, level: float) -> DataFrame:
    """Pieces of a contour: in each small triangle of the lattice, the line between the two sides that it crosses.

    A triangle is its three corners, joined to the lattice by (i, j): three equi-joins, no neighbour search.
    """
    v = points.select("i", "j", F.col(column).cast("double").alias("v")).filter("v is not null")
    up = F.array(F.struct(F.lit(0).alias("di"), F.lit(0).alias("dj")), F.struct(F.lit(1).alias("di"), F.lit(0).alias("dj")), F.struct(F.lit(0).alias("di"), F.lit(1).alias("dj")))
    down = F.array(F.struct(F.lit(1).alias("di"), F.lit(0).alias("dj")), F.struct(F.lit(0).alias("di"), F.lit(1).alias("dj")), F.struct(F.lit(1).alias("di"), F.lit(1).alias("dj")))
    cells = v.select(F.col("i").alias("ci"), F.col("j").alias("cj"), F.explode(F.array(F.struct(F.lit("u").alias("k"), up.alias("c")), F.struct(F.lit("d").alias("k"), down.alias("c")))).alias("x"))
    corners = cells.select("ci", "cj", "x.k", F.posexplode("x.c").alias("n", "o")).select("ci", "cj", "k", "n", (F.col("ci") + F.col("o.di")).alias("i"), (F.col("cj") + F.col("o.dj")).alias("j"))
    tri = corners.join(v, ["i", "j"]).groupBy("ci", "cj", "k").agg(F.sort_array(F.collect_list(F.struct("n", "i", "j", "v"))).alias("p")).filter(F.size("p") == 3)
    side = lambda a, b: F.when((F.col("p")[a]["v"] - level) * (F.col("p")[b]["v"] - level) < 0, F.struct(*((F.col("p")[a][c] + (F.col("p")[b][c] - F.col("p")[a][c]) * (level - F.col("p")[a]["v"]) / (F.col("p")[b]["v"] - F.col("p")[a]["v"])).alias(c) for c in ("i", "j"))))
    hits = tri.select("ci", "cj", "k", F.filter(F.array(side(0, 1), side(1, 2), side(0, 2)), lambda s: s.isNotNull()).alias("s")).filter(F.size("s") == 2)
    return hits.select("ci", "cj", "k", (F.col("s")[0]["i"] / steps).alias("x0"), (F.col("s")[0]["j"] / steps).alias("y0"), (F.col("s")[1]["i"] / steps).alias("x1"), (F.col("s")[1]["j"] / steps).alias("y1"))


def polylines(segments: DataFrame) -> DataFrame:
    """Segments chained end to end: (``line``, ``n``, ``x``, ``y``). A contour of a lattice is short and is chained in one task."""
    import pandas as pd

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        key = lambda x, y: (round(x, 9), round(y, 9))
        ends: dict[tuple, list[int]] = {}
        parts = [(key(r.x0, r.y0), key(r.x1, r.y1)) for r in pdf.sort_values(["ci", "cj", "k"]).itertuples()]
        for n, (a, b) in enumerate(parts):
            ends.setdefault(a, []).append(n)
            ends.setdefault(b, []).append(n)
        used, rows, line = set(), [], 0
        starts = sorted(range(len(parts)), key=lambda n: min(len(ends[p]) for p in parts[n]))
        for first in starts:
            if first in used:
                continue
            a, b = parts[first]
            at = [b, a] if len(ends[b]) < len(ends[a]) else [a, b]
            used.add(first)
            while nxt := [n for n in ends[at[-1]] if n not in used]:
                used.add(nxt[0])
                p, q = parts[nxt[0]]
                at.append(q if p == at[-1] else p)
            rows += [(line, n, x, y) for n, (x, y) in enumerate(at)]
            line += 1
        return pd.DataFrame(rows, columns=["line", "n", "x", "y"])

    return segments.groupBy(F.lit(1).alias("one")).applyInPandas(lambda pdf: chain(pdf), "line int, n int, x double, y double")


def bar_geometry(value: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    """(left, width) of a bar from 0, in percent of the domain."""
    whole = F.nullif(hi - lo, F.lit(0.0))
    return 100 * (F.least(value, F.lit(0.0)) - lo) / whole, 100 * F.abs(value) / whole


def clip_periods(periods: DataFrame, start: str, end: str) -> DataFrame:
    """Periods cut to a range; what lies outside is gone."""
    cut = periods.withColumn("from_month", F.greatest("from_month", F.lit(start))).withColumn("to_month", F.least("to_month", F.lit(end)))
    return cut.filter("from_month < to_month")


def step_after(points: DataFrame, wanted: DataFrame) -> DataFrame:
    """The value that holds at each wanted month: the last one at or before it."""
    from .windows import as_of

    return as_of(wanted, points, "month", ["value"])


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    return df.withColumn("row", F.row_number().over(W.partitionBy().orderBy(*order)))
