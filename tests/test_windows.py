import pytest
from pyspark.sql import functions as F

from panelforge.functions import months, numbers
from panelforge.operators import compare, tables, windows
from panelforge.sources import files
from panelforge.errors import PanelError


def points(spark, values):
    rows = [(i + 1, months.text_of(24000 + i), float(v), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k int, start_month string, excess double, matched double")


def test_losing_runs_merge_over_short_gaps(spark):
    got = [tuple(r) for r in windows.losing_runs(points(spark, [-1, 1, 1, 0, 1, 1, 1, 1, -1, -2]), max_gap=2).collect()]
    assert got == [("2000-01", "2000-04", 2), ("2000-09", "2000-10", 2)]
    assert windows.losing_runs(points(spark, [1, 2])).count() == 0


def test_zero_is_a_loss(spark):
    row = windows.rolling_summary(points(spark, [0, 1, -1, 1])).first()
    assert (row.n_windows, row.n_win, row.n_lose, row.worst, row.worst_start) == (4, 2, 2, -1.0, "2000-03")


def test_islands(spark):
    df = spark.createDataFrame([(i, f"m{i}", s) for i, s in ((1, "a"), (2, "a"), (3, None), (4, None), (6, None), (7, "a"))], "t int, month string, s string")
    got = sorted((r.from_month, r.to_month, r.s, r.n) for r in windows.islands(df, "t", ["s"]).collect())
    assert got == [("m1", "m2", "a", 2), ("m3", "m4", None, 2), ("m6", "m6", None, 1), ("m7", "m7", "a", 1)]


def test_as_of_and_nearest(spark):
    rows = spark.createDataFrame([(f"2000-{m:02d}",) for m in range(1, 7)], "month string")
    events = spark.createDataFrame([("2000-02", 1.0), ("2000-05", 2.0)], "month string, v double")
    assert [r.v for r in windows.as_of(rows, events, "month", ["v"]).orderBy("month").collect()] == [None, 1, 1, 1, 2, 2]
    got = {r.wanted: (r.month, r.gap) for r in windows.nearest(rows, events, 1).collect()}
    assert got["2000-01"] == ("2000-02", 1) and got["2000-03"] == ("2000-02", -1) and got["2000-02"] == ("2000-02", 0)
    both = windows.nearest(spark.createDataFrame([("2000-03",)], "month string"), spark.createDataFrame([("2000-02",), ("2000-04",)], "month string"), 1)
    assert both.first().month == "2000-02"


def test_stale_values_fire_once(spark):
    rows = [(i, 20.0, 100.0 * 1.05**i) for i in range(7)]
    df = spark.createDataFrame(rows, "t int, pe double, px double")
    assert [r.t for r in windows.repeats_run(df, "t", "pe", "px").collect()] == [3]


def test_merge_near_measures_from_the_first(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 0.00009), ("c", 0.00018), ("d", 0.5)], "id string, x double")
    assert sorted(tuple(r) for r in windows.merge_near(df).collect()) == [("a+b", 0.0), ("c", 0.00018), ("d", 0.5)]


def test_months(spark):
    row = spark.createDataFrame([("1985-01", "2026-08")], "a string, b string").select(months.add_months(F.col("a"), 13).alias("x"), months.month_diff(F.col("a"), F.col("b")).alias("d"), months.month_end(F.lit("2024-02")).cast("string").alias("e")).first()
    assert tuple(row) == ("1986-02", 499, "2024-02-29")


def test_number_texts(spark):
    df = spark.createDataFrame([(0.1244,), (-0.0004,), (None,), (-0.5,)], "x double")
    assert [r.s for r in df.select(numbers.fmt_pct(F.col("x")).alias("s")).collect()] == ["12.4%", "0.0%", "—", "−50.0%"]
    assert df.limit(1).select(numbers.fixed(F.lit(12.45), 1).alias("s")).first().s == "12.5"
    cells = spark.createDataFrame([("1,234.5",), ("#N/A N/A",), ("--",), ("",), ("−",)], "c string")
    assert [r.v for r in cells.select(numbers.parse_number(F.col("c")).alias("v")).collect()] == [1234.5, None, None, None, None]
    assert cells.limit(1).select(numbers.parse_number(F.lit("1.234,5"), ",").alias("v")).first().v == 1234.5


def test_identity_telescopes(spark):
    df = spark.createDataFrame([(2.0, 0.3, 0.1, 0.05), (3.0, 0.02, -0.1, None)], "years double, ln_r double, ln_m double, ln_d double")
    a, b = compare.identity(df).orderBy("years").collect()
    assert a.price_lp_yr == pytest.approx(a.pe_lp_yr + a.eps_lp_yr) and a.f_price == pytest.approx(a.f_pe * a.f_eps)
    assert b.pe_share is None and b.tr_lp_yr is None
    total = compare.totals(compare.identity(df)).first()
    assert total.years == 5 and total.ln_d is None


def test_rounded_terms_add_up(spark):
    df = spark.createDataFrame([(2.546, -0.854, 3.395, 0.005)], "t double, a double, b double, c double")
    r = tables.add_up(df, "t", ["a", "b", "c"], 2).first()
    assert r.s_t == 2.55 and r.s_a + r.s_b + r.s_c == pytest.approx(r.s_t)


def test_appends(spark):
    old = spark.createDataFrame([("2000-01", 1.0), ("2000-02", 2.0)], "month string, v double")
    new = spark.createDataFrame([("2000-02", 2.0), ("2000-03", 3.0)], "month string, v double")
    once = files.append_months(old, new, ["v"])
    assert files.append_months(once, new, ["v"]).count() == once.count() == 3
    with pytest.raises(PanelError) as e:
        files.append_months(old, new.withColumn("v", F.col("v") + 1), ["v"])
    assert e.value.code == "E_NULL_DATA"


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('month,v,note\n2000-01,1.5,"a, b"\n2000-02,,x\n2000-01,2.5,last\n')
    got = {r.month: r for r in files.read_csv(spark, str(tmp_path / "a.csv"), numbers=("v",)).collect()}
    assert got["2000-01"].v == 2.5 and got["2000-02"].v is None
    m = files.manifest(spark, str(tmp_path), "*.csv").first()
    assert m.bytes == len((tmp_path / "a.csv").read_bytes()) and len(m.sha256) == 64
    df = spark.createDataFrame([("x", float("nan")), ('q"t', 1.0)], "a string, v double")
    files.write_json(df, str(tmp_path / "j"))
    assert sorted(r.line for r in files.csv_lines(df, ["a", "v"]).collect()) == ['"q""t",1.0', "x,"]
    files.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).count() == 2
