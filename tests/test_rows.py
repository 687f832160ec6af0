"""Row numbers, positions, group and level codes, ranges: empty tables, ties, missing values."""

import pytest
from pyspark.sql import functions as F

from slate.frame import Frame
from slate.operators import rows as N
from slate.operators import sets as U
from slate.operators import window as W


def test_numbers(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (None, "n"), (2, "b"), (1, "a")], "k int, v string")
    got = sorted((r.row, r.k) for r in N.number_rows(df, ["k", "v"]).collect())
    assert got == [(1, None), (2, 1), (3, 1), (4, 2), (5, 3)]
    assert N.number_rows(df.limit(0), ["k"]).count() == 0


def test_positions_and_codes(spark):
    x = spark.createDataFrame([("b",), (None,), ("z",)], "v string")
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "b")], "o int, v string")
    found = {r.v: r.position for r in N.match_position(x, "v", table, "v", ["o"]).collect()}
    assert found == {"b": 2, None: 3, "z": None}
    codes = {r.v: r.code for r in N.level_codes(table, "v").collect()}
    assert codes == {"a": 1, "b": 2, None: None}
    groups = {r.v: r.group for r in N.group_index(table, ["v"], ["o"]).collect()}
    assert groups == {"a": 1, "b": 2, None: 3}


def test_ranges(spark):
    x = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (11.0,), (None,)], "v double")
    ranges = spark.createDataFrame([(5.0, 10.0), (4.0, 6.0), (9.0, 1.0), (None, 99.0)], "lo double, hi double")
    assert sorted(r.v for r in N.in_ranges(x, "v", ranges, "lo", "hi", 3.0).collect()) == [5.0, 10.0]
    assert N.in_ranges(x, "v", ranges.limit(0), "lo", "hi", 3.0).count() == 0


def test_constant_fill_limit(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 1.0), (4, None), (5, None)], "o int, v double")
    got = df.select("o", W.nafill("v", W.window([F.lit(1)], ["o"]), "const", 0.0, limit=1).alias("f")).orderBy("o").collect()
    assert [r.f for r in got] == [0.0, None, 1.0, 0.0, None]


def test_columns_move_and_take_names(spark):
    f = Frame(spark.createDataFrame([(1, 2, 3)], "a int, b int, c int"), ("a",), ("a",))
    assert f.reorder("c").df.columns == ["c", "a", "b"]
    assert f.reorder("a", after="b").df.columns == ["b", "a", "c"]
    assert f.reorder("c", before="b").df.columns == ["a", "c", "b"]
    assert f.rename(str.upper).order == ("A",)
    assert f.rename({"b": "x", "z": "y"}, skip_absent=True).df.columns == ["a", "x", "c"]
    with pytest.raises(ValueError):
        f.rename({"z": "y"})


def test_fill_of_an_open_end_keeps_its_limit(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([None, None, 1.0, None, None, None])], "k int, v double").withColumn("g", F.lit(1))
    w = W.window(["g"], ["k"])
    rows = df.select("k", W.nafill("v", w, fill=0.0, limit=1).alias("l"), W.nafill("v", w, "nocb", fill=9.0, limit=2).alias("n"), W.nafill("v", w, fill=0.0, limit=0).alias("z")).orderBy("k").collect()
    assert [r["l"] for r in rows] == [0.0, None, 1.0, 1.0, None, None]
    assert [r["n"] for r in rows] == [1.0, 1.0, 1.0, None, 9.0, 9.0]
    assert [r["z"] for r in rows] == [None, None, 1.0, None, None, None]


def test_adaptive_windows_of_no_rows_and_odd_lengths(spark):
    df = spark.createDataFrame([(1, 1, 5.0, 0), (1, 2, 7.0, None), (1, 3, None, 1), (1, 4, 2.0, 9)], "g int, k int, v double, n int")
    got = {f: [r[f] for r in W.froll_adaptive(df, f, "v", "n", ["g"], ["k"], f, 3).orderBy("k").collect()] for f in ("sum", "max", "median", "var")}
    assert got == {"sum": [0.0, None, None, None], "max": [float("-inf"), None, None, None], "median": [None] * 4, "var": [None] * 4}


def test_tables_that_differ(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None)], "k int, v double")
    assert U.all_equal(a, a.orderBy(F.desc("k"))) is None
    assert U.all_equal(a, a.select("v", "k"), ignore_col_order=True) is None
    assert "columns" in U.all_equal(a, a.select("v", "k"))
    assert "rows" in U.all_equal(a, a.limit(1))
    assert "type of k" in U.all_equal(a, a.withColumn("k", F.col("k").cast("long")))
    assert "values of v" in U.all_equal(a, a.fillna(0.0))
