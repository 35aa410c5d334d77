"""Rolling windows, islands and as-of joins over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.months import month_index


def rolling_excess(sample: DataFrame, years: int, start_month: str | None = None) -> DataFrame:
    """For every window of 12 * years rows: ``k``, ``start_month``, ``end_month``, ``excess`` of compound growth, ``matched`` with the first asset at the second one's volatility.

    The plain gap is running sums over one window frame. The matched one needs each window's own
    ratio of volatilities before the logs are summed, so windows meet their rows in a range join: n times length rows.
    """
    size = 12 * years
    frame = W.partitionBy().orderBy("t").rowsBetween(0, size - 1)  # a sample has a row a month
    n = F.count("*").over(frame)
    ex, es = F.col("r_ndx") - F.col("rf"), F.col("r_spx") - F.col("rf")
    starts = sample.select(
        F.col("t").alias("k"), F.col("month").alias("first"), n.alias("n"), F.last("month").over(frame).alias("end_month"),
        F.sum(F.log1p("r_ndx")).over(frame).alias("g_ndx"), F.sum(F.log1p("r_spx")).over(frame).alias("g_spx"),
        (F.stddev_samp(es).over(frame) / F.stddev_samp(ex).over(frame)).alias("a"),
        F.lag("month").over(W.partitionBy().orderBy("t")).alias("before"),
    ).filter(F.col("n") == size)
    rows = sample.select("t", "r_ndx", "rf")
    each = starts.select("k", "a").join(rows, F.col("t").between(F.col("k"), F.col("k") + size - 1))
    matched = each.groupBy("k").agg(F.sum(F.log1p(F.col("a") * F.col("r_ndx") + (1 - F.col("a")) * F.col("rf"))).alias("g_vm"))
    growth = lambda g: F.expm1(12 * F.col(g) / size)
    out = starts.join(matched, "k")
    start = F.coalesce("before", F.lit(start_month) if start_month else F.lit(None).cast("string"))
    return out.select(F.col("k").cast("int").alias("k"), start.alias("start_month"), "end_month", (growth("g_ndx") - growth("g_spx")).alias("excess"), (growth("g_vm") - growth("g_spx")).alias("matched"))


def rolling_summary(points: DataFrame, column: str = "excess") -> DataFrame:
    """One row: windows, wins (over 0), quantiles, the worst window (the first of equals)."""
    return points.agg(
        F.count("*").alias("n_windows"), F.count_if(F.col(column) > 0).alias("n_win"), F.avg((F.col(column) > 0).cast("double")).alias("win_rate"),
        F.percentile(column, F.lit(0.5)).alias("median"), F.percentile(column, F.lit(0.1)).alias("p10"), F.percentile(column, F.lit(0.9)).alias("p90"),
        F.min(column).alias("worst"), F.min_by("start_month", F.struct(column, "k")).alias("worst_start"), F.count_if(F.col(column) <= 0).alias("n_lose"),
        F.avg((F.col("matched") > 0).cast("double")).alias("vm_win_rate"),
    )


def losing_runs(points: DataFrame, max_gap: int = 12, column: str = "excess") -> DataFrame:
    """Start months that lose (0 included), as runs; runs at most ``max_gap`` months apart are one. Longest first."""
    lose = points.filter(F.col(column) <= 0).select("start_month", month_index(F.col("start_month")).alias("mi"))
    order = W.partitionBy().orderBy("mi")
    opens = F.coalesce((F.col("mi") - F.lag("mi").over(order) - 1 > max_gap).cast("int"), F.lit(1))
    runs = lose.withColumn("opens", opens).withColumn("run", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    out = runs.groupBy("run").agg(F.min("start_month").alias("from_month"), F.max("start_month").alias("to_month"), F.count("*").alias("n"))
    return out.drop("run").orderBy(F.desc("n"), "from_month")


def relative_wealth(sample: DataFrame) -> DataFrame:
    """Ratio of the first two assets' wealth at each month."""
    upto = W.partitionBy().orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    return sample.select("t", "month", F.exp(F.sum(F.log1p("r_ndx") - F.log1p("r_spx")).over(upto)).alias("ratio"))


def islands(rows: DataFrame, order: str, values: list[str], label: str = "month", by: list[str] | None = None) -> DataFrame:
    """Runs of equal ``values`` in consecutive positions of ``order``: ``from``, ``to``, ``n``."""
    keys = by or []
    w = W.partitionBy(*keys).orderBy(order)
    same = F.col(order) == F.lag(order).over(w) + 1
    for v in values:
        same = same & F.col(v).eqNullSafe(F.lag(v).over(w))
    marked = rows.withColumn("__new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    marked = marked.withColumn("__run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = marked.groupBy(*keys, "__run", *values).agg(F.min(label).alias("from_month"), F.max(label).alias("to_month"), F.count("*").alias("n"))
    return out.drop("__run")


def coverage(panel: DataFrame) -> DataFrame:
    """Each series' months by status: (``id``, ``status``, ``from_month``, ``to_month``, ``n``)."""
    told = {
        "NDX": F.when(F.col("NDX").isNotNull(), "observed"),
        "SPX": F.when(F.col("SPX").isNotNull(), "observed"),
        "NDX_TR": F.when(F.col("ndx_tr").isNotNull(), "observed").when(F.col("ndx_div_default").isNotNull(), "estimated"),
        "SPX_TR": F.when(F.col("spx_tr").isNotNull(), "observed").when((F.col("t") > 0) & F.col("spx_tr_con").isNotNull(), "constructed"),
        "UST": F.when(F.col("bond_tr").isNotNull(), "model"),
    }
    each = panel.select("t", "month", F.explode(F.array(*(F.struct(F.lit(k).alias("id"), v.alias("status")) for k, v in told.items()))).alias("x")).select("t", "month", "x.*")
    return islands(each.filter("status is not null"), "t", ["status"], by=["id"])


def by_status(segments: DataFrame) -> DataFrame:
    """Segments as lists of ranges for each status."""
    text = F.concat_ws("～", "from_month", "to_month")
    return segments.groupBy("id", "status").agg(F.concat_ws(", ", F.sort_array(F.collect_list(text))).alias("ranges"))


def repeats_run(rows: DataFrame, order: str, value: str, price: str, moved: float = 0.02, fires: int = 3, by: list[str] | None = None) -> DataFrame:
    """Rows where a value has stayed equal for exactly ``fires`` steps while its price moved by over ``moved`` in logs each time."""
    keys = by or []
    w = W.partitionBy(*keys).orderBy(order)
    before, price0 = F.lag(value).over(w), F.lag(price).over(w)
    on = (before > 0) & (before == F.col(value)) & (F.col(price) > 0) & (price0 > 0) & (F.abs(F.ln(F.when(F.col(price) > 0, F.col(price))) - F.ln(F.when(price0 > 0, price0))) > moved)
    rows = rows.withColumn("__on", F.coalesce(on, F.lit(False)).cast("int"))
    rows = rows.withColumn("__block", F.sum(1 - F.col("__on")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    run = F.sum("__on").over(W.partitionBy(*keys, "__block").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("run", run).filter(F.col("run") == fires).drop("__on", "__block")


def as_of(rows: DataFrame, events: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each row with the values of the last event at or before it: a union and one running window, no range join."""
    left = rows.select(*rows.columns, *(F.lit(None).cast(events.schema[c].dataType).alias(f"__{c}") for c in columns), F.lit(1).alias("__side"))
    right = events.select(*(F.col(key).alias(c) if c == key else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns), *(F.col(c).alias(f"__{c}") for c in columns), F.lit(0).alias("__side"))
    upto = W.partitionBy().orderBy(key, "__side").rowsBetween(W.unboundedPreceding, 0)
    both = left.unionByName(right)
    held = both.withColumns({c: F.last(f"__{c}", ignorenulls=True).over(upto) for c in columns})
    return held.filter("__side = 1").drop("__side", *(f"__{c}" for c in columns))


def nearest(wanted: DataFrame, usable: DataFrame, tolerance: int) -> DataFrame:
    """Each wanted month with the nearest usable one within ``tolerance`` months, the earlier of two equally near.

    The candidates of a month are its few neighbours, so this is an equi-join on the month, not a range join.
    """
    near = wanted.select(F.col("month").alias("wanted"), F.explode(F.sequence(F.lit(-tolerance), F.lit(tolerance))).alias("gap"), month_index(F.col("month")).alias("mi0"))
    near = near.withColumn("mi", F.col("mi0") + F.col("gap"))
    hit = near.join(usable.select(F.col("month").alias("found"), month_index(F.col("month")).alias("mi")), "mi")
    best = hit.groupBy("wanted").agg(F.min(F.struct(F.abs("gap").alias("d"), "gap", "found")).alias("b"))
    return wanted.select(F.col("month").alias("wanted")).join(best, "wanted", "left").select("wanted", F.col("b.found").alias("month"), F.col("b.gap").alias("gap"))


def in_periods(sample: DataFrame, periods: DataFrame) -> DataFrame:
    """Rows in each period's (from, to]: ``period`` and the sample's columns. Periods are a short list and are broadcast."""
    p = F.broadcast(periods.select(F.col("id").alias("period"), "from_month", "to_month"))
    return sample.join(p, (F.col("month") > F.col("from_month")) & (F.col("month") <= F.col("to_month")))


def january(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("month").endswith("-01"))


def year_ends(rows: DataFrame) -> DataFrame:
    """The first row, every December, and the last row."""
    ends = rows.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    return rows.join(F.broadcast(ends), F.lit(True)).filter(F.col("month").endswith("-12") | (F.col("month") == F.col("lo")) | (F.col("month") == F.col("hi"))).drop("lo", "hi")


def spaced(rows: DataFrame, position: str, most: int) -> DataFrame:
    """Evenly spaced rows, the last one included: about ``most`` of them."""
    n = rows.agg((F.max(position) + 1).alias("__n"))
    step = F.greatest(F.lit(1), F.ceil(F.col("__n") / most))
    return rows.join(F.broadcast(n), F.lit(True)).filter((F.col(position) % step == 0) | (F.col(position) == F.col("__n") - 1)).drop("__n")


def merge_near(points: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Points whose x lies within ``tolerance`` of the first one of their group, ids joined; (``id``, ``x``), a short list.

    The group is measured from its first point, so it is a fold over the sorted list, not a gap test.
    """
    state = F.expr("named_struct('x', cast(null as double), 'out', cast(array() as array<struct<x:double,ids:array<string>>>))")
    items = F.sort_array(F.collect_list(F.struct("x", "id")))

    def step(acc: Column, p: Column) -> Column:
        joined = F.struct(acc["x"].alias("x"), F.concat(F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(F.struct(acc["x"].alias("x"), F.concat(F.element_at(acc["out"], -1)["ids"], F.array(p["id"])).alias("ids")))).alias("out"))
        opened = F.struct(p["x"].alias("x"), F.concat(acc["out"], F.array(F.struct(p["x"].alias("x"), F.array(p["id"]).alias("ids")))).alias("out"))
        return F.when(acc["x"].isNotNull() & (p["x"] - acc["x"] <= tolerance), joined).otherwise(opened)

    folded = points.agg(F.aggregate(items, state, step, lambda s: s["out"]).alias("p"))
    return folded.select(F.explode("p").alias("q")).select(F.concat_ws("+", "q.ids").alias("id"), F.col("q.x").alias("x"))


def last_in_month(observations: DataFrame, key: str = "key", at: str = "at", value: str = "value") -> DataFrame:
    """The last observation of each key and month; of equal times the one that comes later (``seq``) wins."""
    order = F.struct(at, "seq") if "seq" in observations.columns else F.col(at)
    return observations.groupBy(F.date_format(at, "yyyy-MM").alias("month"), key).agg(F.max_by(value, order).alias(value))


def nearest_index(grid: DataFrame, wanted: DataFrame) -> DataFrame:
    """Index of the grid value nearest to each wanted one, the lower of two: ``grid`` (i, x) is short and is broadcast."""
    pairs = wanted.join(F.broadcast(grid), F.lit(True))
    return pairs.groupBy("id", "v").agg(F.min_by("i", F.struct(F.abs(F.col("x") - F.col("v")), F.col("i"))).alias("i"))


def interpolate(points: DataFrame, wanted: DataFrame) -> DataFrame:
    """Linear value at each wanted x, null outside: the neighbours come from ``lead``, the match from a range join on short lists."""
    w = W.partitionBy().orderBy("x")
    parts = points.select("x", "y", F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"))
    hit = wanted.join(F.broadcast(parts), (F.col("v") >= F.col("x")) & ((F.col("v") < F.col("x1")) | ((F.col("x1").isNull()) & (F.col("v") == F.col("x")))), "left")
    value = F.when(F.col("x1").isNull(), F.col("y")).otherwise(F.col("y") + (F.col("y1") - F.col("y")) * (F.col("v") - F.col("x")) / (F.col("x1") - F.col("x")))
    return hit.select("v", value.alias("y"))
