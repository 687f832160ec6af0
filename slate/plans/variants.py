"""The options of the catalogue's operators, each as a query beside its SQL. They are added to the catalogue's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slate.frame import Frame
from slate.functions import dates as D
from slate.functions import scalar as S
from slate.operators import aggregate as A
from slate.operators import joins as J
from slate.operators import reshape as R
from slate.operators import rows as N
from slate.operators import sets as U
from slate.operators import window as W
from slate.plans.catalogue import _A, _B, _BY_USER, _GAPS, _LINE, _P, _QTY, _SPANS, _V, LINE, _asof, _pair, long, qty, query, r4, users
from slate.sources.csv import read_csv, write_csv
from slate.sources.staged import fresh_path
from slate.streaming import windows as Z

c = F.col


# --- sources, rows and columns ---


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(t):
    path = fresh_path(t("customer").sparkSession)
    write_csv(t("customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path)
    return read_csv(t("customer").sparkSession, path, types={"c_custkey": "bigint", "c_acctbal": "double"})


@query("SELECT r.a, s.b FROM (VALUES (3), (1), (2)) r(a) CROSS JOIN (VALUES ('x'), ('y')) s(b)")
def cross_vectors(t):
    names, rows = J.cross(a=[3, 1, 2], b=["x", "y"])
    return t("region").sparkSession.createDataFrame(rows, "a int, b string").select(*names)


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE {_QTY} IS NOT NULL")
def na_omit(t):
    return Frame(t("lineitem").select(*LINE[:4], qty().alias("q"))).na_omit(["q"]).df.drop("q")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE {_QTY} IS NULL")
def na_omit_inverted(t):
    return Frame(t("lineitem").select(*LINE[:4], qty().alias("q"))).na_omit(["q"], invert=True).df.drop("q")


@query("(SELECT event_id, 'head' AS part FROM events ORDER BY ts LIMIT 6) UNION ALL (SELECT event_id, 'tail' FROM events ORDER BY ts DESC LIMIT 4)")
def head_tail(t):
    f = Frame(t("events"), ("ts",))
    return f.head().df.select("event_id", F.lit("head").alias("part")).union(f.tail(4).df.select("event_id", F.lit("tail")))


@query("SELECT n_nationkey FROM nation QUALIFY row_number() OVER (ORDER BY n_name) NOT IN (1, 3)")
def rows_excluded(t):
    return Frame(t("nation"), ("n_name",)).rows([-1, -3]).df.select("n_nationkey")


@query("SELECT event_id, row_number() OVER (ORDER BY user_id, ts) AS i FROM events")
def row_numbers(t):
    return N.number_rows(t("events").select("event_id", "user_id", "ts"), ["user_id", "ts"], "i").select("event_id", "i")


@query("SELECT s_suppkey, k.p AS position FROM supplier LEFT JOIN (SELECT n_regionkey, min(rn) AS p FROM (SELECT n_regionkey, row_number() OVER (ORDER BY n_name) AS rn FROM nation) GROUP BY 1) k ON s_nationkey % 9 = n_regionkey")
def match_position(t):
    x = t("supplier").select("s_suppkey", (c("s_nationkey") % 9).alias("k"))
    return N.match_position(x, "k", t("nation"), "n_regionkey", ["n_name"]).drop("k")


@query("SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM part p WHERE o.o_totalprice BETWEEN p.p_retailprice * 100 AND p.p_retailprice * 100 + 20)")
def in_ranges(t):
    ranges = t("part").select((c("p_retailprice") * 100).alias("lo"), (c("p_retailprice") * 100 + 20).alias("hi"))
    return N.in_ranges(t("orders"), "o_totalprice", ranges, "lo", "hi", 100.0).select("o_orderkey")


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, q > 5 AND q < 30 AS strict, CASE WHEN q IS NOT NULL THEN q >= coalesce(lo, q) AND q <= 40 END AS open, q >= lo AND q <= 40 AS known
FROM (SELECT *, {_QTY} AS q, nullif(l_linenumber, 2) AS lo FROM lineitem)""")
def between_missing(t):
    x = t("lineitem").select(*LINE[:4], qty().alias("q"), F.when(c("l_linenumber") != 2, c("l_linenumber")).alias("lo"))
    return x.select(*LINE[:4], S.between(c("q"), 5, 30, inclusive=False).alias("strict"), S.between(c("q"), c("lo"), 40).alias("open"), S.between(c("q"), c("lo"), 40, na_bounds=False).alias("known"))


@query("SELECT p_partkey, ((p_size - 20) % 7 + 7) % 7 AS m, CAST(floor((p_size - 20) / 7.0) AS BIGINT) AS d, CASE WHEN p_size % 5 = 0 THEN 'inf'::DOUBLE ELSE round(p_retailprice / (p_size % 5), 6) END AS q FROM part")
def floor_arithmetic(t):
    a = c("p_size") - 20
    return t("part").select("p_partkey", S.floor_mod(a, 7).cast("int").alias("m"), long(S.floor_div(a, 7)).alias("d"), F.round(S.divide(c("p_retailprice"), c("p_size") % 5), 6).alias("q"))


@query("SELECT c_custkey, c_acctbal, upper(c_mktsegment) AS segment FROM customer")
def select_renamed(t):
    names = R.columns(t("customer"), "c_acctbal:c_mktsegment", "/custkey$/")
    f = Frame(t("customer").select(*names)).rename({"c_mktsegment": "segment"}).update({"segment": F.upper("segment")})
    return f.df.select("c_custkey", "c_acctbal", "segment")


@query("SELECT o_orderkey, o_totalprice, dense_rank() OVER (ORDER BY o_orderpriority) AS code FROM orders")
def level_codes(t):
    return N.level_codes(t("orders"), "o_orderpriority").select("o_orderkey", "o_totalprice", "code")


# --- dates and times ---


@query("""SELECT o_orderkey, CAST(date_trunc('year', o_orderdate) AS DATE) + CAST(floor(dayofyear(o_orderdate) / 7) * 7 AS INTEGER) AS wk, CAST(date_trunc('month', o_orderdate) AS DATE) AS mo, CAST(date_trunc('year', o_orderdate) AS DATE) AS yr,
CAST(o_orderdate AS DATE) + 10 AS later, CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS BIGINT) AS days, year(o_orderdate) || 'M' || lpad(month(o_orderdate)::VARCHAR, 2, '0') AS ym, year(o_orderdate) + (quarter(o_orderdate) - 1) / 4.0 AS yq FROM orders""")
def date_rounding(t):
    d = F.to_date("o_orderdate")
    start = F.lit("1995-01-01").cast("date")
    return t("orders").select("o_orderkey", D.round_date(d, "weeks").alias("wk"), D.round_date(d, "months").alias("mo"), D.round_date(d, "years").alias("yr"), F.date_add(d, 10).alias("later"), long(F.datediff(d, start)).alias("days"), D.yearmon(d, True).alias("ym"), D.yearqtr(d).alias("yq"))


@query("""SELECT event_id, CAST(floor(s / 3600) * 3600 AS BIGINT) AS h, CAST(floor(s / 60 + 0.5) * 60 AS BIGINT) AS m, date_trunc('second', ts) AS back
FROM (SELECT *, CAST(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS BIGINT) AS s FROM events)""")
def time_rounding(t):
    s = D.itime(c("ts"))
    return t("events").select("event_id", long(D.round_itime(s, "hours", truncate=True)).alias("h"), long(D.round_itime(s, "minutes")).alias("m"), D.date_time(F.to_date("ts"), s).alias("back"))


# --- aggregates ---


@query(f"SELECT l_suppkey, count(DISTINCT q) + max(CASE WHEN q IS NULL THEN 1 ELSE 0 END) AS with_missing, count(DISTINCT q) AS known, count(DISTINCT (l_returnflag, l_linestatus)) AS pairs FROM (SELECT *, {_QTY} AS q FROM lineitem) GROUP BY 1")
def unique_counts(t):
    x = t("lineitem").withColumn("q", qty())
    return A.summarise(x, ["l_suppkey"], {"with_missing": A.unique_n("q"), "known": A.unique_n("q", na_rm=True), "pairs": A.unique_n("l_returnflag", "l_linestatus")})


@query(f"""SELECT l_orderkey, CASE WHEN coalesce(sum(CASE WHEN q IS NOT NULL THEN l_tax END), 0) = 0 THEN 'nan'::DOUBLE ELSE round(sum(CASE WHEN q IS NOT NULL THEN q * l_tax END) / sum(CASE WHEN q IS NOT NULL THEN l_tax END), 6) END AS wm, CASE WHEN count(q) = count(*) THEN round(var_samp(q), 4) END AS v,
CASE WHEN count(q) = count(*) THEN round(median(q), 4) END AS med, CASE WHEN count(q) = count(*) THEN max(q) END AS hi FROM (SELECT l_orderkey, l_tax, {_QTY} AS q FROM lineitem) GROUP BY 1""")
def aggregates_strict(t):
    x = t("lineitem").select("l_orderkey", "l_tax", qty().alias("q"))
    return A.summarise(x, ["l_orderkey"], {"wm": F.round(A.weighted_mean("q", "l_tax", True), 6), "v": r4(A.var("q")), "med": r4(A.median("q")), "hi": A.greatest("q")})


@query("SELECT o_orderstatus, min(o_orderpriority) AS lo, max(o_orderpriority) AS hi, round(max(o_totalprice) / min(o_totalprice) - avg(o_totalprice) % 7, 4) AS mixed FROM orders GROUP BY 1")
def aggregate_arithmetic(t):
    mixed = A.greatest("o_totalprice") / A.least("o_totalprice") - A.mean("o_totalprice") % 7
    return A.summarise(t("orders"), ["o_orderstatus"], {"lo": A.least("o_orderpriority"), "hi": A.greatest("o_orderpriority"), "mixed": r4(mixed)})


@query("SELECT o_totalprice > 150000 AS big, year(o_orderdate)::BIGINT AS y, count(*) AS n FROM orders GROUP BY 1, 2")
def by_expressions(t):
    return A.summarise(t("orders"), [(c("o_totalprice") > 150000).alias("big"), long(F.year("o_orderdate")).alias("y")], {"n": F.count(F.lit(1))})


@query("SELECT event_type, row_number() OVER (ORDER BY f) AS grp, count(*) OVER () AS groups FROM (SELECT event_type, min(ts) AS f FROM events GROUP BY 1)")
def group_numbers(t):
    groups = N.group_index(t("events"), ["event_type"], ["ts"], "grp")
    return groups.crossJoin(groups.agg(F.max("grp").alias("groups"))).select("event_type", "grp", "groups")


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts) = 1")
def row_of_greatest(t):
    return A.unique_rows(t("events"), ["user_id"], [F.desc("value"), F.asc("ts")]).select("user_id", "event_id", "value")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) <= 2")
def tail_per_group(t):
    return A.top_n(t("events"), ["user_id"], [F.desc("ts")], 2).select("user_id", "event_id")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def unique_from_last(t):
    return A.unique_rows(t("orders"), ["o_custkey"], [F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT o_orderstatus, n FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) CROSS JOIN (VALUES (1), (2)) v(k)")
def repeated_sets(t):
    return A.grouping_sets(t("orders"), ["o_orderstatus"], [["o_orderstatus"], ["o_orderstatus"]], {"n": F.count(F.lit(1))}, ident=None)


@query("SELECT coalesce(min(rn), 0) AS position FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS rn, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k > 1")
def first_duplicate(t):
    return A.first_duplicate(t("orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


@query("SELECT l_returnflag, round(avg(l_quantity), 4) AS mean_l_quantity, round(avg(l_extendedprice), 4) AS mean_l_extendedprice, round(avg(l_discount), 4) AS mean_l_discount, round(avg(l_tax), 4) AS mean_l_tax FROM lineitem GROUP BY 1")
def each_column(t):
    x = t("lineitem")
    return A.summarise(x, ["l_returnflag"], A.each(R.columns(x, "l_quantity:l_tax"), lambda v: r4(A.mean(v)), "mean_{}".format))


# --- windows ---


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS first,
rank() OVER w + count(*) OVER (w RANGE UNBOUNDED PRECEDING) - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS last
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity DESC)""")
def frank_ties(t):
    order, total = [F.desc("l_quantity")], [F.asc(n) for n in LINE[1:]]
    ranks = {k: long(W.frank(order, ["l_orderkey"], k, total)).alias(k) for k in ("first", "last")}
    return t("lineitem").select(*LINE[:4], *ranks.values())


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rank() OVER (PARTITION BY l_orderkey ORDER BY q ASC NULLS LAST) AS at_end, CASE WHEN q IS NOT NULL THEN rank() OVER (PARTITION BY l_orderkey ORDER BY q ASC NULLS LAST) END AS keep FROM (SELECT *, {_QTY} AS q FROM lineitem)")
def frank_missing(t):
    x = t("lineitem").select(*LINE[:4], qty().alias("q"))
    rank = long(W.frank(S.sort_key("q", na_last=True), ["l_orderkey"], "min"))
    return x.select(*LINE[:4], rank.alias("at_end"), F.when(c("q").isNotNull(), rank).alias("keep"))


@query(f"SELECT event_id, lead(value, 1) {_BY_USER} AS turned, coalesce(lead(event_type, 2) {_BY_USER}, 'none') AS later FROM events")
def shift_turned(t):
    return t("events").select("event_id", W.shift("value", -1, users()).alias("turned"), W.shift("event_type", 2, users(), "lead", "none").alias("later"))


_GAP_ROWS = f"(SELECT *, row_number() {_BY_USER} AS rn, max(CASE WHEN v IS NOT NULL THEN row_number_ END) {_BY_USER[:-1]} ROWS UNBOUNDED PRECEDING) AS seen FROM (SELECT *, row_number() {_BY_USER} AS row_number_ FROM {_GAPS}))"


@query(f"""SELECT event_id, coalesce(v, CASE WHEN rn - coalesce(seen, 0) <= 1 THEN 0.0 END) AS const, coalesce(last_value(v IGNORE NULLS) {_BY_USER[:-1]} ROWS UNBOUNDED PRECEDING), -1) AS locf,
first_value(v IGNORE NULLS) {_BY_USER[:-1]} ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS nocb FROM {_GAP_ROWS}""")
def nafill_limits(t):
    gaps = t("events").select("event_id", "user_id", "ts", F.when(c("event_id") % 3 == 0, c("value")).alias("v"))
    w = users()
    return gaps.select("event_id", W.nafill("v", w, "const", 0.0, limit=1).alias("const"), W.nafill("v", w, fill=-1.0).alias("locf"), W.nafill("v", w, "nocb", limit=1).alias("nocb"))


@query(f"""SELECT event_id, coalesce(v, CASE WHEN seen IS NULL THEN CASE WHEN rn <= 2 THEN -1.0 END WHEN rn - seen <= 2 THEN last_value(v IGNORE NULLS) {_BY_USER[:-1]} ROWS UNBOUNDED PRECEDING) END) AS locf FROM {_GAP_ROWS}""")
def nafill_limit_opening(t):
    gaps = t("events").select("event_id", "user_id", "ts", F.when(c("event_id") % 3 == 0, c("value")).alias("v"))
    return gaps.select("event_id", W.nafill("v", users(), fill=-1.0, limit=2).alias("locf"))


_SIZED = f"e AS (SELECT event_id, user_id, value, row_number() {_BY_USER} AS rn, event_id % 4 + 1 AS n, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events)"


def _sized(t) -> DataFrame:
    return t("events").select("event_id", "user_id", "ts", "value", (c("event_id") % 4 + 1).alias("n"), F.when(c("event_id") % 3 == 0, c("value")).alias("v"))


@query(f"""WITH {_SIZED} SELECT e.event_id, CASE WHEN e.rn >= e.n THEN round(median(b.value), 4) END AS median, CASE WHEN e.rn >= e.n THEN round(stddev_samp(b.value), 4) END AS sd, round(coalesce(sum(b.v), 0), 4) AS part
FROM e JOIN e b ON b.user_id = e.user_id AND b.rn > e.rn - e.n AND b.rn <= e.rn GROUP BY e.event_id, e.rn, e.n""")
def froll_adaptive_kinds(t):
    out = W.froll_adaptive(_sized(t), "median", "value", "n", ["user_id"], ["ts"], "median", 4)
    out = W.froll_adaptive(out, "sd", "value", "n", ["user_id"], ["ts"], "sd", 4)
    out = W.froll_adaptive(out, "sum", "v", "n", ["user_id"], ["ts"], "part", 4, na_rm=True, partial=True)
    return out.select("event_id", *[r4(c(k)).alias(k) for k in ("median", "sd", "part")])


@query(f"""WITH {_SIZED} SELECT e.event_id, CASE WHEN count(*) = e.n THEN max(b.value) ELSE -1 END AS hi, CASE WHEN count(*) = e.n AND count(b.v) = e.n THEN round(avg(b.v), 4) END AS strict
FROM e JOIN e b ON b.user_id = e.user_id AND b.rn >= e.rn AND b.rn < e.rn + e.n GROUP BY e.event_id, e.rn, e.n""")
def froll_adaptive_left(t):
    out = W.froll_adaptive(_sized(t), "max", "value", "n", ["user_id"], ["ts"], "hi", 4, "left", -1.0)
    return W.froll_adaptive(out, "mean", "v", "n", ["user_id"], ["ts"], "strict", 4, "left").select("event_id", "hi", r4(c("strict")).alias("strict"))


@query(f"WITH {_SIZED} SELECT e.event_id, round(max(b.value) - min(b.value), 4) AS span FROM e JOIN e b ON b.user_id = e.user_id AND b.rn > e.rn - e.n AND b.rn <= e.rn GROUP BY e.event_id")
def frollapply_sized(t):
    out = W.frollapply(_sized(t).drop("v"), lambda m: m.max() - m.min(), ["value"], "n", ["user_id"], ["ts"], "span", partial=True)
    return out.select("event_id", r4(c("span")).alias("span"))


_LEFT = f"{_BY_USER[:-1]} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)"


@query(f"SELECT event_id, CASE WHEN count(*) {_LEFT} = 3 THEN round(var_samp(value) {_LEFT}, 4) ELSE -1 END AS var, round(sum(value) {_LEFT}, 4) AS part, 'nan'::DOUBLE AS none FROM events")
def froll_left(t):
    return t("events").select("event_id", r4(W.froll("var", "value", 3, users(), "left", -1.0)).alias("var"), r4(W.froll("sum", "value", 3, users(), "left", partial=True)).alias("part"), W.froll("mean", "value", 0, users()).alias("none"))


_BACK = f"{_BY_USER[:-1]} ROWS 2 PRECEDING)"


@query(f"""SELECT event_id, CASE WHEN n = 3 THEN round(coalesce(s, 0), 4) END AS sum, CASE WHEN n = 3 THEN coalesce(round(m, 4), 'nan'::DOUBLE) END AS mean, CASE WHEN n = 3 THEN coalesce(hi, '-inf'::DOUBLE) END AS max,
CASE WHEN n = 3 AND k = 3 THEN round(s, 4) END AS strict, CASE WHEN n = 3 THEN round(coalesce(p, 1), 6) END AS prod FROM (SELECT event_id, count(*) {_BACK} AS n, count(v) {_BACK} AS k, sum(v) {_BACK} AS s, avg(v) {_BACK} AS m, max(v) {_BACK} AS hi, product(v) {_BACK} AS p FROM {_GAPS})""")
def froll_missing(t):
    gaps = t("events").select("event_id", "user_id", "ts", F.when(c("event_id") % 3 == 0, c("value")).alias("v"))
    w = users()
    # Three values of two decimals make products of six: rounded there, the order of the factors doesn't show.
    places = {"sum": 4, "mean": 4, "max": 4, "prod": 6}
    loose = [F.round(W.froll(f, "v", 3, w, na_rm=True), k).alias(f) for f, k in places.items()]
    return gaps.select("event_id", *loose, r4(W.froll("sum", "v", 3, w)).alias("strict"))


# --- joins ---


@query("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) o ON o.o_custkey = c.c_custkey")
def join_mult_first(t):
    out = J.join(t("orders").select("o_custkey", "o_orderkey"), t("customer").select("c_custkey"), {"o_custkey": "c_custkey"}, mult="first", order=["o_orderkey"])
    return out.select(c("o_custkey").alias("c_custkey"), "o_orderkey")


@query("SELECT a.k, a.x, b.y FROM (SELECT nullif(n_nationkey % 5, 0) AS k, n_nationkey AS x FROM nation) a JOIN (SELECT nullif(r_regionkey, 0) AS k, r_name AS y FROM region) b ON a.k IS NOT DISTINCT FROM b.k")
def join_natural_missing(t):
    x = t("nation").select(F.nullif(c("n_nationkey") % 5, F.lit(0)).alias("k"), c("n_nationkey").alias("x"))
    i = t("region").select(F.nullif(c("r_regionkey"), F.lit(0)).alias("k"), c("r_name").alias("y"))
    return J.join(x, i, J.natural(x, i), nomatch=None)


@query("SELECT p_partkey, b.band FROM part JOIN (VALUES (0.0, 1200.0, 'low'), (1200.0, 1600.0, 'mid'), (1600.0, 1e9, 'high')) b(lo, hi, band) ON p_retailprice >= b.lo AND p_retailprice < b.hi")
def price_bands(t):
    bands = t("part").sparkSession.createDataFrame([(0.0, 1200.0, "low"), (1200.0, 1600.0, "mid"), (1600.0, 1e9, "high")], "lo double, hi double, band string")
    x = t("part").select("p_partkey", c("p_retailprice").alias("a"), c("p_retailprice").alias("b"))
    return J.join(x, bands, ["a>=lo", "b<hi"], nomatch=None).select("p_partkey", "band")


def _rolled(t, roll: float | str | bool, ends: tuple[bool, bool] | None = None) -> DataFrame:
    x, i = _asof(t)
    return J.rolling(x, i, ["user_id"], "ts", roll, ends).select("event_id", "view_id")


_BEFORE, _AFTER = (f"(SELECT p.event_id, p.ts, v.view_id, v.ts AS vts FROM {_P} p ASOF LEFT JOIN {_V} v ON p.user_id = v.user_id AND p.ts {op} v.ts)" for op in (">=", "<="))


@query(f"SELECT a.event_id, CASE WHEN epoch_us(a.vts) - epoch_us(a.ts) <= 36000000000 THEN a.view_id END AS view_id FROM {_AFTER} a")
def rolling_back_limit(t):
    return _rolled(t, -36000)


@query(f"SELECT b.event_id, coalesce(b.view_id, a.view_id) AS view_id FROM {_BEFORE} b JOIN {_AFTER} a USING (event_id)")
def rolling_both_ends(t):
    return _rolled(t, True, (True, True))


@query(f"SELECT b.event_id, CASE WHEN a.view_id IS NOT NULL THEN b.view_id END AS view_id FROM {_BEFORE} b JOIN {_AFTER} a USING (event_id)")
def rolling_no_ends(t):
    return _rolled(t, True, (False, False))


_X, _Y = _SPANS.format(k="event_id", n="xid", w="event_id % 40", e="view"), _SPANS.format(k="event_id - event_id % 50", n="yid", w=60, e="purchase").replace("SELECT event_id - event_id % 50 AS yid", "SELECT event_id AS yid")


def _overlap(t, kind: str, width: float) -> DataFrame:
    e, k = t("events"), c("event_id")
    x = e.where("event_type = 'view'").select(k.alias("xid"), k.alias("a"), (k + k % 40).alias("b"))
    start = k - k % 50
    y = e.where("event_type = 'purchase'").select(k.alias("yid"), start.alias("c"), (start + 60).alias("d"))
    return J.overlaps(x, y, [], ("a", "b"), ("c", "d"), kind, width=width).select("xid", "yid")


@query(f"WITH x AS ({_X}), y AS ({_Y}) SELECT x.xid, y.yid FROM x LEFT JOIN y ON x.a >= y.a AND x.b <= y.b")
def overlaps_within(t):
    return _overlap(t, "within", 80.0)


@query(f"WITH x AS ({_X}), y AS ({_Y}) SELECT x.xid, y.yid FROM x LEFT JOIN y ON x.a = y.a")
def overlaps_start(t):
    return _overlap(t, "start", 80.0)


@query(f"WITH x AS ({_X}), y AS ({_Y}) SELECT x.xid, y.yid FROM x LEFT JOIN y ON x.b = y.b")
def overlaps_end(t):
    return _overlap(t, "end", 80.0)


@query(f"WITH x AS ({_X}), y AS ({_Y}) SELECT x.xid, y.yid FROM x LEFT JOIN y ON x.a = y.a AND x.b = y.b")
def overlaps_equal(t):
    return _overlap(t, "equal", 80.0)


def _merged(t, how: str, mult: str = "all") -> DataFrame:
    n = t("nation")
    a = n.where("n_nationkey < 15").select((c("n_nationkey") % 12).alias("k"), c("n_name").alias("a"))
    b = n.where("n_nationkey > 5").select((c("n_nationkey") % 20).alias("k"), c("n_name").alias("b"))
    return J.merge_list([a, b], ["k"], how, mult, ["b"] if mult == "last" and how == "left" else [])


_MERGED = "WITH a AS (SELECT n_nationkey % 12 AS k, n_name AS a FROM nation WHERE n_nationkey < 15), b AS (SELECT n_nationkey % 20 AS k, n_name AS b FROM nation WHERE n_nationkey > 5) "


@query(_MERGED + "SELECT k, a, b FROM a JOIN b USING (k)")
def merge_inner(t):
    return _merged(t, "inner")


@query(_MERGED + "SELECT k, a, b FROM a RIGHT JOIN b USING (k)")
def merge_right(t):
    return _merged(t, "right")


@query(_MERGED + "SELECT k, a FROM a WHERE k IN (SELECT k FROM b)")
def merge_semi(t):
    return _merged(t, "semi")


@query(_MERGED + "SELECT k, a FROM a WHERE k NOT IN (SELECT k FROM b)")
def merge_anti(t):
    return _merged(t, "anti")


@query(_MERGED + "SELECT a.k, a.a, b.b FROM a LEFT JOIN (SELECT k, max(b) AS b FROM b GROUP BY 1) b USING (k)")
def merge_left_last(t):
    return _merged(t, "left", "last")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def merge_cross(t):
    return J.merge_list([t("region").select("r_name"), t("nation").select("n_name")], [], "cross")


@query("SELECT k, x, y FROM (SELECT n_regionkey AS k, min(n_name) AS x FROM nation WHERE n_regionkey < 4 GROUP BY 1) FULL JOIN (SELECT n_regionkey AS k, min(n_name) AS y FROM nation WHERE n_regionkey > 1 GROUP BY 1) USING (k)")
def merge_full_first(t):
    n = t("nation").withColumnsRenamed({"n_regionkey": "k", "n_name": "o"})
    a = n.where("k < 4").select("k", "o").withColumn("x", c("o"))
    b = n.where("k > 1").select("k", "o").withColumn("y", c("o"))
    return J.merge_list([a, b], ["k"], "full", "first", ["o"]).select("k", "x", "y")


@query("SELECT a.k, a.x, b.y FROM (SELECT nullif(n_nationkey % 5, 0) AS k, n_nationkey AS x FROM nation) a LEFT JOIN (SELECT nullif(r_regionkey, 0) AS k, r_name AS y FROM region) b ON a.k = b.k AND a.k <> 3")
def merge_incomparables(t):
    x = t("nation").select(F.nullif(c("n_nationkey") % 5, F.lit(0)).alias("k"), c("n_nationkey").alias("x"))
    y = t("region").select(F.nullif(c("r_regionkey"), F.lit(0)).alias("k"), c("r_name").alias("y"))
    return J.merge(x, y, ["k"], all_x=True, incomparables=[None, 3])


# --- sets and shapes ---


@query("SELECT true AS same, false AS other")
def all_equal(t):
    x = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    near = x.repartition(3).withColumn("o_totalprice", c("o_totalprice") * (1 + 1e-12))
    far = x.withColumn("o_totalprice", c("o_totalprice") + 1)
    found = [U.all_equal(x, y) is None for y in (near, far)]
    return x.sparkSession.createDataFrame([tuple(found)], "same boolean, other boolean")


@query(f"({_A}) UNION ALL ({_B})")
def set_union_all(t):
    return U.union(*_pair(t), True)


@query(f"({_A}) INTERSECT ({_B})")
def set_intersect(t):
    return U.intersect(*_pair(t))


@query(f"({_B}) EXCEPT ({_A} AND l_quantity > 10)")
def set_diff(t):
    a, b = _pair(t)
    return U.setdiff(b, a.where("q > 10"))


@query("SELECT true AS same, false AS other")
def set_equal(t):
    a, b = _pair(t)
    return a.sparkSession.createDataFrame([(U.equal(a, a.orderBy("q")), U.equal(a, b))], "same boolean, other boolean")


@query("SELECT o_orderstatus AS part, o_orderkey FROM orders")
def split_rows(t):
    parts = U.split(t("orders").select("o_orderstatus", "o_orderkey"), "o_orderstatus")
    return U.bind_rows({k: p.select("o_orderkey") for k, p in parts.items()}, idcol="part")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, variable, value FROM (SELECT *, {_QTY} AS q, nullif(l_tax, 0) AS tx FROM lineitem) UNPIVOT (value FOR variable IN (q, tx))")
def melt_without_missing(t):
    wide = t("lineitem").select(*LINE[:4], qty().alias("q"), F.nullif(c("l_tax"), F.lit(0.0)).alias("tx"))
    return R.melt(wide, LINE[:4], R.patterns(wide, "^(q|tx)$")[0], na_rm=True)


@query("SELECT p_partkey, 1 AS variable, p_size AS n, p_name AS s FROM part UNION ALL SELECT p_partkey, 2, p_size + 1, p_type FROM part")
def melt_several(t):
    wide = t("part").select("p_partkey", c("p_size").alias("n1"), (c("p_size") + 1).alias("n2"), c("p_name").alias("s1"), c("p_type").alias("s2"))
    return R.melt(wide, ["p_partkey"], R.patterns(wide, r"^n\d$", r"^s\d$"), value=["n", "s"])


_CAST = [(f, s) for f in "ANR" for s in "FO"]


@query("SELECT l_suppkey, " + ", ".join(f"round(sum({x}) FILTER (l_returnflag = '{f}' AND l_linestatus = '{s}'), 2) AS \"{n}_{f}_{s}\"" for n, x in (("qty", "l_quantity"), ("price", "l_extendedprice")) for f, s in _CAST) + " FROM lineitem GROUP BY 1")
def dcast_several(t):
    aggs = {n: lambda here, x=x: F.round(F.sum(F.when(here, c(x))), 2) for n, x in (("qty", "l_quantity"), ("price", "l_extendedprice"))}
    return R.dcast(t("lineitem"), ["l_suppkey"], ["l_returnflag", "l_linestatus"], aggs, levels=_CAST)


@query("""SELECT s.o_orderstatus, p.o_orderpriority, coalesce(count(o_orderkey) FILTER (o_custkey % 2 = 0), 0) AS even, coalesce(count(o_orderkey) FILTER (o_custkey % 2 = 1), 0) AS odd FROM (SELECT DISTINCT o_orderstatus FROM orders WHERE o_totalprice > 250000) s
CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders WHERE o_totalprice > 250000) p LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 250000) o ON s.o_orderstatus = o.o_orderstatus AND p.o_orderpriority = o.o_orderpriority GROUP BY 1, 2""")
def dcast_all_levels(t):
    x = t("orders").where("o_totalprice > 250000").withColumn("side", F.when(c("o_custkey") % 2 == 0, "even").otherwise("odd"))
    return R.dcast(x, ["o_orderstatus", "o_orderpriority"], ["side"], {"n": lambda here: F.count(F.when(here, 1))}, levels=[("even",), ("odd",)], fill=0, drop=False)


@query("SELECT 'n' AS key, " + ", ".join(f"count(*) FILTER (n_regionkey = {k}) AS \"{k}\"" for k in range(5)) + " FROM nation")
def transpose(t):
    return R.transpose(t("nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n")), "n_regionkey")


# --- time windows ---


@query("""SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '12 hours' AS "end", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s
FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '12 hours' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def sessions(t):
    e = t("events").withColumn("ts", c("ts").cast("timestamp"))
    out = Z.sessions(e, "ts", "12 hours", {"n": F.count(F.lit(1))}, ["user_id"])
    return out.withColumns({k: c(k).cast("timestamp_ntz") for k in ("start", "end")})


@query("SELECT DISTINCT user_id, event_type FROM events")
def distinct_within(t):
    e = t("events").withColumn("ts", c("ts").cast("timestamp"))
    return Z.distinct_within(e.select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "1 hour").select("user_id", "event_type")


@query(f"SELECT l_orderkey, round(sum(l_quantity), 2) AS q, arg_min(l_partkey, ({_LINE})) AS part FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 150")
def chained(t):
    f = Frame(t("lineitem")).q(None, {"q": F.round(F.sum("l_quantity"), 2), "part": A.first("l_partkey", LINE)}, by=["l_orderkey"])
    return f.q(c("q") > 150).df


@query("SELECT event_id, value, round(avg(value) OVER (PARTITION BY event_type), 4) AS of_type FROM events")
def group_mean_beside(t):
    return t("events").select("event_id", "value", r4(F.avg("value").over(Window.partitionBy("event_type"))).alias("of_type"))
