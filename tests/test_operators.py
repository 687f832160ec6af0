import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from slate.frame import Frame, rowwise
from slate.functions import dates as D
from slate.functions import scalar as S
from slate.operators import aggregate as A
from slate.operators import joins as J
from slate.operators import reshape as R
from slate.operators import sets as U
from slate.operators import window as W
from slate.plans import catalogue, extras  # noqa: F401  (extras adds its queries)
from slate.sources import csv

NAN, INF = float("nan"), float("inf")


def values(df, name="v"):
    return [None if r[name] is None else "nan" if isinstance(r[name], float) and math.isnan(r[name]) else r[name] for r in df.collect()]


def test_order_of_missing_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (NAN,), (None,), (-INF,)], "v double")
    assert values(df.orderBy(*S.sort_key("v", floating=True))) == [None, "nan", -INF, 1.0]
    assert values(df.orderBy(*S.sort_key("v", na_last=True, floating=True)))[-1] is None


def test_scalars(spark):
    df = spark.createDataFrame([(-7, 3), (7, 0), (None, 2)], "a int, b int")
    assert [r[0] for r in df.select(S.floor_mod(F.col("a"), F.col("b"))).collect()] == [2, None, None]
    assert [r[0] for r in df.select(S.divide(F.col("a"), F.col("b"))).collect()] == [-7 / 3, INF, None]
    assert [r[0] for r in df.select(S.fifelse(F.col("a") > 0, "y", "n", "?")).collect()] == ["n", "y", "?"]
    assert [r[0] for r in df.select(S.isin(F.col("a"), [7, None])).collect()] == [False, True, True]
    assert [r[0] for r in df.select(S.between(F.col("a"), None, 0)).collect()] == [True, False, None]


def test_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None), ("c", NAN), ("c", 2.0)], "g string, v double")
    got = {r.g: r for r in A.summarise(df, ["g"], {"s": A.total("v"), "s_rm": A.total("v", True), "m_rm": A.mean("v", True), "lo": A.least("v", True, True), "hi": A.greatest("v", floating=True), "n": A.unique_n("v"), "sd": A.sd("v", True)}, keyed=True).collect()}
    assert got["a"].s is None and got["a"].s_rm == 1.0 and got["a"].n == 2 and got["a"].sd is None
    assert got["b"].s_rm == 0 and math.isnan(got["b"].m_rm) and got["b"].lo is None
    assert got["c"].lo == 2.0 and math.isnan(got["c"].hi)


def test_first_keeps_missing(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "o int, v int")
    assert df.agg(A.first("v", ["o"]).alias("f"), A.last("v", ["o"]).alias("l")).first() == (None, 5)


def test_rolling_edges(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([1.0, None, 3.0, 4.0])], "o int, v double")
    w = W.window([F.lit(1)], ["o"])
    assert values(df.select(W.froll("sum", "v", 2, w).alias("v"))) == [None, None, None, 7.0]
    assert values(df.select(W.froll("sum", "v", 2, w, na_rm=True, partial=True).alias("v"))) == [1.0, 1.0, 3.0, 7.0]
    assert values(df.select(W.froll("max", "v", 0, w).alias("v"))) == [-INF] * 4
    assert values(df.select(W.froll("mean", "v", 9, w, fill=-1.0).alias("v"))) == [-1.0] * 4


def test_join_semantics(spark):
    x = spark.createDataFrame([(1, "a"), (None, "b"), (1, "c")], "k int, v string")
    i = spark.createDataFrame([(1, "x"), (None, "y"), (9, "z")], "k int, v string")
    out = J.join(x, i, ["k"])
    assert out.columns == ["k", "v", "i.v"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "a", "x"), (1, "c", "x"), (None, "b", "y"), (9, None, "z")], key=str)
    assert sorted(J.join(x, i, ["k"], None, "first", ["v"]).toPandas()["v"]) == ["a", "b"]
    assert [r.v for r in J.anti(x, i.where("k = 1"), ["k"]).collect()] == ["b"]
    assert {r["i.v"] if "i.v" in r else r.v: r.N for r in J.each_i(x, i, ["k"], {}).collect()} == {"x": 2, "y": 1, "z": 0}
    with pytest.raises(TypeError):
        J.join(x, i.select(F.col("v").alias("k")), ["k"])
    with pytest.raises(ValueError):
        J.parse_on(["k!=k"], x, i)
    with pytest.raises(Exception, match="several rows"):
        J.join(x, i, ["k"], mult="error").collect()



def test_several_matches(spark):
    x = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    i = spark.createDataFrame([(2,), (2,), (9,)], "k int")
    assert sorted(map(tuple, J.join(x, i, ["k"], mult="error").collect()), key=str) == [(2, "c"), (2, "c"), (9, None)]  # key 1 repeats, but nothing matches it
    with pytest.raises(Exception, match="several rows"):
        J.join(x, i.withColumn("k", F.lit(1)), ["k<=k"], mult="error").collect()
    with pytest.raises(ValueError, match="order"):
        J.join(x, i, ["k"], mult="first")
    with pytest.raises(ValueError, match="cartesian"):
        J.join(x.union(x), i.union(i).withColumn("k", F.lit(1)), ["k"], cartesian=False)
    with pytest.raises(ValueError, match="both tables"):
        J.join(x, i.withColumn("k", F.lit(1)), ["k"], many=False)
    assert J.merge_list([i, x], ["k"]).count() == 3
    with pytest.raises(Exception, match="a key repeats"):
        J.merge_list([i.withColumn("k", F.lit(1)), x], ["k"]).collect()
    with pytest.raises(ValueError):
        J.merge_list([x, i, i], ["k"], how=["left"])
    many = spark.range(250_001).select(F.lit(2).alias("k"))
    assert J.join(x, many, ["k<=k"], mult="last", order=["v"]).where("v = 'c'").count() == 250_001


@pytest.mark.parametrize(("mult", "best"), [("first", min), ("last", max)])
def test_best_match_by_one_unequal_condition(spark, mult, best):
    """Against plain loops, and without the pairs that a join would make."""
    odd = [None, NAN, -0.0, 0.0, INF]
    xs = [(g, v, o, n) for n, (g, v, o) in enumerate((g, v, o) for g in (None, 1, 2) for v in [*odd, 1.5, 1.5, 7.0] for o in (3, None, 1))]
    ys = [(g, v) for g in (None, 1, 3) for v in [*odd, 1.5, 2.0, 7.0, 7.0]]
    x, i = spark.createDataFrame(xs, "g bigint, v double, o int, n int"), spark.createDataFrame(ys, "g int, w double")

    def place(v):  # NaN is the largest number and equals itself
        return (1, 0.0) if math.isnan(v) else (0, v)

    tests = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}
    cases = [(op, ["g"], False) for op in tests] + [(">", ["g"], True), ("<=", ["g"], True), ("<", [], None), (">=", [], None)]
    for k, (op, equal, spread) in enumerate(cases):
        expected = []
        for g, w in ys:
            met = [r for r in xs if (r[0] == g or not equal) and None not in (w, r[1]) and tests[op](place(r[1]), place(w))]
            expected.append((g, w, best(((r[2] is not None, r[2] or 0, r[3]) for r in met), default=(0, 0, None))[2]))
        nomatch = "NA" if k % 2 else None
        out = J.join(x, i, [*equal, f"v{op}w"], nomatch, mult, ["o", "n"], spread=spread)
        assert out.columns == (["g", "v", "o", "n"] if equal else ["g", "v", "o", "n", "i.g"])
        got = [(r["g" if equal else "i.g"], r.v, r.n) for r in out.collect()]
        assert sorted(map(str, got)) == sorted(str(r) for r in expected if nomatch or r[2] is not None), (op, equal, spread)
    assert J.join(x, i, ["g", "v>w"], "NA", mult, [F.abs(F.col("v") - F.col("w")), "n"]).count() == len(ys)  # an order that looks at i


@pytest.mark.parametrize("name", ["non_equi_first", "non_equi_last"])
def test_unequal_matches_make_no_pairs(spark, name):
    out = catalogue.queries()[name](spark, "/root/testdata/sf0.001")
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_intervals_are_checked(spark):
    x = spark.createDataFrame([(1, 3)], "a int, b int")
    for bad in ((5, 2), (None, 2), (1, None)):
        y = spark.createDataFrame([bad], "a int, d int")
        with pytest.raises(Exception, match="no interval"):
            J.overlaps(x, y, [], ("a", "b"), ("a", "d")).collect()
    y = spark.createDataFrame([(2, 9, "y")], "a int, d int, n string")
    assert J.overlaps(x, y, [], ("a", "b"), ("a", "d")).columns == ["a", "d", "n", "i.a", "b"]
    with pytest.raises(ValueError, match="order"):
        J.overlaps(x, y, [], ("a", "b"), ("a", "d"), mult="first")


def test_spread_equals_windows(spark):
    rows = [(g, t, (t * 7 + (g or 0)) % 5 or None) for g in (None, 1, 2) for t in range(400 if g == 1 else 15)]
    df = spark.createDataFrame(rows, "g int, t int, v int")
    for kind in ("locf", "nocb"):
        plain = df.select("g", "t", W.nafill("v", W.window(["g"], ["t"]), kind).alias("f"))
        assert sorted(map(str, W.nafill_spread(df, "v", ["g"], ["t"], "f", kind).select("g", "t", "f").collect())) == sorted(map(str, plain.collect()))
    x, i = df.where("t % 3 = 0"), df.where("t % 3 = 1").drop("v")
    for roll in (True, float("-inf"), "nearest", 1):
        both = [sorted(map(str, J.rolling(x, i, ["g"], "t", roll, spread=s).collect())) for s in (False, True)]
        assert both[0] == both[1] and len(both[0]) == i.count()
    with pytest.raises(TypeError):
        J.rolling(x.withColumn("t", F.col("t").cast("string")), i.withColumn("t", F.col("t").cast("string")), ["g"], "t", "nearest")
    assert W.nafill_spread(df.limit(0), "v", ["g"], ["t"], "f").count() == 0


def test_running_sums_equal_gathering(spark, monkeypatch):
    odd = {3: None, 11: NAN, 17: INF, 23: -INF, 29: None}
    rows = [(g, k, odd.get(k, k * 1.25), None if k == 8 else (k * 5) % 13 - 1) for g in (None, 1) for k in range(40)]
    df = spark.createDataFrame(rows, "g int, k int, v double, n int")
    for f in ("sum", "mean"):
        for kw in ({}, {"align": "left"}, {"na_rm": True}, {"align": "left", "na_rm": True, "partial": True}, {"partial": True}, {"fill": -1.0}):
            found = []
            for gathered in (64, 0):
                monkeypatch.setattr(W, "GATHERED", gathered)
                out = W.froll_adaptive(df, f, "v", "n", ["g"], ["k"], "r", 9, **kw)
                assert out.columns == ["g", "k", "v", "n", "r"]
                found.append(sorted((str(r.g), r.k, "none" if r.r is None else "nan" if math.isnan(r.r) else round(r.r, 9)) for r in out.collect()))
            assert found[0] == found[1], (f, kw)


def test_small_table_operators(spark):
    f = Frame(spark.createDataFrame([(1, 1.0), (2, NAN), (3, None)], "k int, v double"), ("k",))
    assert [tuple(r) for r in f.is_na().df.collect()] == [(False, False), (False, True), (False, True)]
    assert values(f.na_omit().df) == [1.0] and values(f.rows([None]).df) == [None] and f.n() == 3
    assert [r.k for r in f.tail(2).df.collect()] == [2, 3] and [r.k for r in f.head(-1).df.collect()] == [1, 2] and f.tail(-3).df.count() == 0
    assert [r.k for r in f.ops(lambda a, b: a * b, 2).df.collect()] == [2, 4, 6]
    assert [tuple(r) for r in f.q(None, ["v"], by=["k"]).df.collect()][0] == (1, 1.0)
    with pytest.raises(ValueError):
        U.bind_columns(f.df, f.df.limit(1).withColumnsRenamed({"k": "a", "v": "b"}), ["k"], ["a"])
    with pytest.raises(TypeError):
        A.summarise(f.df.withColumn("l", F.array("k")), ["l"], {"n": F.count(F.lit(1))})
    with pytest.raises(ValueError):
        rowwise(spark, ["a", "b"], 1, 2, 3)
    parts = S.split_columns(spark.createDataFrame([("a-1",), ("b",), (None,)], "x string"), "x", "-", fill="?", rev=True)
    assert [tuple(r) for r in parts.collect()] == [("a-1", "1", "a"), ("b", "b", "?"), (None, None, None)]
    keys = spark.createDataFrame([(0.1 + 0.2,), (0.3,), (0.0,), (NAN,)], "x double").select(S.numeric_key(F.col("x")).alias("v"))
    assert values(keys)[0] == values(keys)[1] and values(keys)[2:] == [0.0, "nan"]


def test_rolling_join(spark):
    x = spark.createDataFrame([("a", 10, 1), ("a", 10, 2), ("a", 20, 3)], "g string, t int, n int")
    i = spark.createDataFrame([("a", 5), ("a", 10), ("a", 15), ("a", 25)], "g string, t int")
    none = {5: [None], 10: [1, 2], 15: [2], 25: [3]}

    def as_dict(**kw):
        out = {}
        for r in J.rolling(x, i, ["g"], "t", order=["n"], **kw).collect():
            out.setdefault(r.t, []).append(r.n)
        return {t: sorted(v, key=str) for t, v in out.items()}

    assert as_dict() == none
    assert as_dict(rollends=(True, True)) | {5: 0} == none | {5: 0}
    assert as_dict(rollends=(False, False)) == none | {25: [None]}
    assert as_dict(roll=4) == none | {15: [None], 25: [None]}
    assert as_dict(roll=5) == none
    assert as_dict(roll=float("-inf")) == {5: [1], 10: [1, 2], 15: [3], 25: [None]}
    assert as_dict(roll="nearest")[25] == [3] and as_dict(roll="nearest")[15] == [2] and as_dict(roll="nearest")[5] == [1]
    assert 5 not in as_dict(nomatch=None)


def test_overlaps(spark):
    x = spark.createDataFrame([(1, 3, "p"), (5, 5, "q"), (8, 9, "r")], "a int, b int, x string")
    y = spark.createDataFrame([(3, 5, "u"), (0, 9, "v")], "c int, d int, y string")

    def pairs(**kw):
        return {(r.x, r.y) for r in J.overlaps(x, y, [], ("a", "b"), ("c", "d"), **kw).collect()}

    every = {("p", "u"), ("p", "v"), ("q", "u"), ("q", "v"), ("r", "v")}
    assert pairs() == pairs(width=2) == pairs(width=4) == every
    assert pairs(kind="end") == {("q", "u"), ("r", "v"), ("p", None)}
    far = spark.createDataFrame([(70, 71, "s")], "a int, b int, x string")
    assert {(r.x, r.y) for r in J.overlaps(far, y, [], ("a", "b"), ("c", "d"), width=3).collect()} == {("s", None)}


def test_merge_and_sets(spark):
    a = spark.createDataFrame([(1, 1), (2, 2), (2, 2)], "k int, v int")
    b = spark.createDataFrame([(2, 2), (3, 3)], "k int, v int")
    assert J.merge(a, b, ["k"], all_x=True, all_y=True).columns == ["k", "v.x", "v.y"]
    assert J.merge_list([a, b], ["k"], "anti").count() == 1
    with pytest.raises(Exception, match="a key repeats"):
        J.merge_list([b, a], ["k"]).collect()
    assert U.intersect(a, b, True).count() == 1 and U.setdiff(a, b, True).count() == 2
    assert U.equal(a, a) and not U.equal(a, a.distinct())
    assert U.bind_rows([a, b.drop("v")], fill=True).count() == 5
    assert set(U.split(a, "k")) == {1, 2}


def test_reshape(spark):
    df = spark.createDataFrame([(1, 2, None, "x")], "id int, a_1 int, a_2 int, b_1 string")
    assert R.columns(df, "/^a_/") == ["a_1", "a_2"] and R.columns(df, "a_1:b_1", negate=True) == ["id"]
    assert R.melt(df, ["id"], ["a_1", "a_2"], na_rm=True).count() == 1
    long_form = R.melt(df, ["id"], [["a_1", "a_2"], ["b_1", None]], "step", ["a", "b"]).collect()
    assert [tuple(r) for r in long_form] == [(1, 1, 2, "x"), (1, 2, None, None)]
    found = R.measure(df.select("id", "a_1", "a_2"), r"a_(\d)", ["n"], {"n": int})
    assert [r.n for r in R.melt_measure(df, ["id"], found).collect()] == [1, 2]
    wide = R.dcast(spark.createDataFrame([("r", "u", 1), ("s", "w", 2)], "r string, c string, v int"), ["r"], ["c"], {"v": lambda here: F.sum(F.when(here, F.col("v")))}, fill=0)
    assert {tuple(r) for r in wide.collect()} == {("r", 1, 0), ("s", 0, 2)}


def test_dates(spark):
    df = spark.createDataFrame([(dt.date(2023, 1, 7),), (dt.date(2023, 1, 8),), (dt.date(2024, 12, 30),)], "d date")
    d = F.col("d")
    assert [tuple(r) for r in df.select(D.week(d), D.week(d, True), D.isoweek(d), D.isoyear(d), D.yearmon(d, True)).collect()] == [(2, 1, 1, 2023, "2023M01"), (2, 2, 1, 2023, "2023M01"), (53, 53, 1, 2025, "2024M12")]
    assert df.select(D.format_itime(F.lit(-3661)).alias("v")).first().v == "-01:01:01"


def test_frame(spark):
    f = Frame(spark.createDataFrame([("b", 1), ("a", 2), ("b", 3)], "g string, v int"), ("v",))
    assert values(f.rows([3, 1, 9, 0]).df) == [3, 1, None]
    assert values(f.rows([-2]).df) == [1, 3]
    assert values(f.update({"v": F.lit(0)}, where=F.col("g") == "a").df) == [1, 0, 3]
    assert values(f.q(F.col("v") > 1, {"v": F.sum("v")}, keyby=["g"]).df) == [2, 3]
    assert values(f.delete(F.col("v") == 2).df) == [1, 3]
    assert W.with_rleid(f.df, ["g"], [], ["v"]).agg(F.max("rleid")).first()[0] == 3


def test_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id;name;zip;x;d\n1;"a;b";007;1.5;2024-01-02\n2;NA;010;Inf;2024-02-03\n')
    df = csv.read_csv(spark, str(path), keep_zeros=True)
    assert df.dtypes == [("id", "int"), ("name", "string"), ("zip", "string"), ("x", "double"), ("d", "date")]
    assert [tuple(r) for r in df.collect()] == [(1, "a;b", "007", 1.5, dt.date(2024, 1, 2)), (2, None, "010", INF, dt.date(2024, 2, 3))]
    out = str(tmp_path / "out")
    csv.write_csv(df.withColumn("l", F.array(F.lit(1), F.lit(2))), out)
    assert csv.read_csv(spark, out).columns == ["id", "name", "zip", "x", "d", "l"]
    head = tmp_path / "h.csvy"
    head.write_text("---\nschema:\n  fields:\n  - name: a\n    type: string\n  - name: b\n    type: integer\n---\na,b\n1,2\n")
    assert csv.read_csv(spark, str(head), csvy=True, header=True).dtypes == [("a", "string"), ("b", "int")]
    assert [tuple(r) for r in csv.read_csv(spark, str(head), csvy=True, header=True).collect()] == [("1", 2)]


def test_csv_types_hold_every_row(spark, tmp_path):
    path = tmp_path / "late.csv"
    head = [f"{k},{k},{k},2024-01-01,true,,{k},{k % 2},{k}" for k in range(300)]
    late = ['5000000000,1.5,"word, two",2024-13-45,no,7,#NUM!,1,3,extra', "1,2,3,2024-01-02,false,,4,0,2,,last"]
    path.write_text("\n".join(["id,x,t,d,b,e,n,f,g", *head, *late]) + "\n")
    df = csv.read_csv(spark, str(path), logical01=True)
    kinds = ["bigint", "double", "string", "string", "string", "int", "double", "boolean", "int", "string", "string"]
    assert df.dtypes == list(zip(["id", "x", "t", "d", "b", "e", "n", "f", "g", "V10", "V11"], kinds, strict=True))
    got = {tuple(map(str, r)) for r in df.where("id = 5000000000 or V11 = 'last'").collect()}
    assert got == {("5000000000", "1.5", "word, two", "2024-13-45", "no", "7", "nan", "True", "3", "extra", "None"), ("1", "2.0", "3", "2024-01-02", "false", "None", "4.0", "False", "2", "None", "last")}
    assert df.count() == 302 and df.where("t is null or d is null or b is null").count() == 0
    headed = tmp_path / "headed.csv"
    headed.write_text("a note\na,b\n" + "1,2\n" * 200 + '1.5,"x,y",z\n')
    df = csv.read_csv(spark, str(headed), skip=1, header=True)
    assert df.dtypes == [("a", "double"), ("b", "string"), ("V3", "string")] and [tuple(r) for r in df.where("V3 is not null").collect()] == [(1.5, "x,y", "z")]
    with pytest.warns(UserWarning, match="values of id"):  # a type that would lose a value is left aside
        assert csv.read_csv(spark, str(path), types={"id": "int"}).dtypes[0] == ("id", "bigint")
