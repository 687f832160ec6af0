"""Every operator as a query over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slate.frame import Frame
from slate.functions import dates as D
from slate.functions import scalar as S
from slate.operators import aggregate as A
from slate.operators import joins as J
from slate.operators import reshape as R
from slate.operators import sets as U
from slate.operators import window as W
from slate.streaming import windows as Z

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def long(c: Column) -> Column:
    return c.cast("long")


def r4(c: Column) -> Column:
    return F.round(c, 4)


#: Orders lines uniquely at every scale.
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
_LINE = ", ".join(LINE)
#: The tables hold no missing values, so both sides make some alike.
_QTY = "nullif(l_quantity, 7)"


def qty() -> Column:
    return F.when(F.col("l_quantity") != 7, F.col("l_quantity"))


# --- rows and columns ---


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus IN ('F', 'O')")
def filter_select(t):
    return Frame(t("orders")).q((F.col("o_totalprice") > 100000) & S.isin(F.col("o_orderstatus"), ["F", "O"]), ["o_orderkey", "o_custkey", "o_totalprice"]).df


@query(f"SELECT l_orderkey, l_linenumber, {_QTY} AS q FROM lineitem WHERE NOT coalesce({_QTY} IN (1, 2, 3), false)")
def notin_keeps_missing(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", qty().alias("q")).where(S.notin(F.col("q"), [1, 2, 3]))


@query("SELECT p_partkey, coalesce(regexp_matches(p_name, 'a.*e'), false) AS re, contains(p_type, 'A') AS fixed, regexp_matches(p_brand, '(?i)BRAND') AS any_case, p_size >= 5 AND p_size <= 15 AS mid FROM part")
def like_between(t):
    c = F.col
    return t("part").select("p_partkey", S.like(c("p_name"), "a.*e").alias("re"), S.like(c("p_type"), "A", fixed=True).alias("fixed"), S.like(c("p_brand"), "BRAND", ignore_case=True).alias("any_case"), S.between(c("p_size"), 5, 15).alias("mid"))


@query("SELECT e.event_id, e.value FROM events e WHERE EXISTS (SELECT 1 FROM (VALUES (0.0, 5.0), (20.0, 25.0), (90.0, 91.0)) r(lo, hi) WHERE e.value >= r.lo AND e.value <= r.hi)")
def inrange(t):
    hit = S.between(F.col("value"), 0.0, 5.0) | S.between(F.col("value"), 20.0, 25.0) | S.between(F.col("value"), 90.0, 91.0)
    return t("events").where(hit).select("event_id", "value")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus IS NULL THEN 'none' WHEN o_totalprice > 200000 THEN 'high' ELSE 'low' END AS size,
CASE WHEN o_orderpriority LIKE '1%' THEN 1 WHEN o_orderpriority LIKE '2%' THEN 2 ELSE 9 END AS prio,
coalesce(nullif(o_orderpriority, '5-LOW'), o_orderstatus) AS filled FROM orders""")
def conditionals(t):
    c = F.col
    return t("orders").select(
        "o_orderkey",
        S.fifelse(F.when(c("o_orderstatus").isNotNull(), c("o_totalprice") > 200000), "high", "low", "none").alias("size"),
        S.fcase(c("o_orderpriority").startswith("1"), 1, c("o_orderpriority").startswith("2"), 2, default=9).alias("prio"),
        S.fcoalesce(F.nullif(c("o_orderpriority"), F.lit("5-LOW")), c("o_orderstatus")).alias("filled"),
    )


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS md,
CAST(dayofyear(o_orderdate) AS BIGINT) AS yd, CAST(quarter(o_orderdate) AS BIGINT) AS qu, CAST(dayofweek(o_orderdate) + 1 AS BIGINT) AS wd,
CAST(floor(dayofyear(o_orderdate) / 7) + 1 AS BIGINT) AS wk, CAST(floor((dayofyear(o_orderdate) - 1) / 7) + 1 AS BIGINT) AS wks, CAST(weekofyear(o_orderdate) AS BIGINT) AS iw, CAST(isoyear(o_orderdate) AS BIGINT) AS iy,
round(year(o_orderdate) + (month(o_orderdate) - 1) / 12.0, 6) AS ym, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS yq,
CAST(date_trunc('quarter', o_orderdate) AS DATE) AS rq FROM orders""")
def date_parts(t):
    d = F.to_date("o_orderdate")
    parts = {"y": D.year(d), "m": D.month(d), "md": D.mday(d), "yd": D.yday(d), "qu": D.quarter(d), "wd": D.wday(d), "wk": D.week(d), "wks": D.week(d, True), "iw": D.isoweek(d), "iy": D.isoyear(d)}
    return t("orders").select("o_orderkey", d.alias("d"), *[long(v).alias(k) for k, v in parts.items()], F.round(D.yearmon(d), 6).alias("ym"), D.yearqtr(d, True).alias("yq"), D.round_date(d, "quarters").alias("rq"))


@query("SELECT event_id, CAST(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS BIGINT) AS sec, strftime(ts, '%H:%M:%S') AS hms FROM events")
def time_parts(t):
    s = D.itime(F.col("ts"))
    return t("events").select("event_id", long(s).alias("sec"), D.format_itime(s).alias("hms"))


@query("SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_name) AS rn FROM nation QUALIFY rn IN (2, 5, 7)")
def row_positions(t):
    f = Frame(t("nation").select("n_nationkey", "n_name"), ("n_name",))
    return f.rows([2, 5, 7]).df.join(t("nation").select("n_nationkey", long(W.rowid([F.lit(1)], ["n_name"])).alias("rn")), "n_nationkey")


@query("SELECT event_id, split_part(event_type, '_', 1) AS a, nullif(split_part(event_type, '_', 2), '') AS b FROM events")
def tstrsplit(t):
    a, b = S.tstrsplit(F.col("event_type"), "_", 2)
    return t("events").select("event_id", a.alias("a"), F.nullif(b, F.lit("")).alias("b"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN l_tax * 2 ELSE l_tax END AS l_tax, round(sum(l_quantity) OVER (PARTITION BY l_orderkey), 4) AS order_qty FROM lineitem WHERE NOT (l_linestatus = 'F')")
def update_by_group(t):
    full = Frame(t("lineitem")).delete(F.col("l_linestatus") == "F").update({"order_qty": F.sum("l_quantity")}, by=["l_orderkey"])
    full = full.update({"l_tax": F.col("l_tax") * 2}, where=F.col("l_returnflag") == "R")
    return full.df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_tax", r4(F.col("order_qty")).alias("order_qty"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(t):
    return t("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


# --- aggregates ---


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(t):
    j = {"sum_qty": F.round(A.total("l_quantity"), 2), "sum_price": F.round(A.total("l_extendedprice"), 2), "sum_disc": F.round(A.total(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2), "avg_qty": r4(A.mean("l_quantity")), "n": F.count(F.lit(1))}
    return Frame(t("lineitem")).q(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"), j, keyby=["l_returnflag", "l_linestatus"]).df


@query(f"""SELECT l_orderkey, CASE WHEN count(q) = count(*) THEN round(sum(q), 4) END AS s, CASE WHEN count(q) = count(*) THEN round(avg(q), 4) END AS m, CASE WHEN count(q) = count(*) THEN min(q) END AS lo,
round(coalesce(sum(q), 0), 4) AS s_rm, CASE WHEN count(q) = 0 THEN 'NaN'::DOUBLE ELSE round(avg(q), 4) END AS m_rm, max(q) AS hi_rm, round(median(q), 4) AS med_rm, round(stddev_samp(q), 4) AS sd_rm, round(var_samp(q), 4) AS var_rm
FROM (SELECT l_orderkey, {_QTY} AS q FROM lineitem) GROUP BY 1""")
def aggregates_missing(t):
    j = {"s": r4(A.total("q")), "m": r4(A.mean("q")), "lo": A.least("q"), "s_rm": r4(A.total("q", True)), "m_rm": r4(A.mean("q", True)), "hi_rm": A.greatest("q", True), "med_rm": r4(A.median("q", True)), "sd_rm": r4(A.sd("q", True)), "var_rm": r4(A.var("q", True))}
    return A.summarise(t("lineitem").select("l_orderkey", qty().alias("q")), ["l_orderkey"], j)


@query(f"""SELECT l_suppkey, arg_min(l_quantity, ({_LINE})) AS first_q, arg_max(l_quantity, ({_LINE})) AS last_q, count(DISTINCT l_returnflag) AS flags,
round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS wm FROM lineitem GROUP BY 1""")
def first_last_weighted(t):
    j = {"first_q": A.first("l_quantity", LINE), "last_q": A.last("l_quantity", LINE), "flags": A.unique_n("l_returnflag"), "wm": r4(A.weighted_mean("l_extendedprice", "l_quantity"))}
    return A.summarise(t("lineitem"), ["l_suppkey"], j)


@query("SELECT l_orderkey, round(product(l_discount + 1), 6) AS p FROM lineitem GROUP BY 1")
def product(t):
    return A.summarise(t("lineitem"), ["l_orderkey"], {"p": F.round(A.prod(F.col("l_discount") + 1), 6)})


@query("SELECT event_type, min(event_id) AS first_id, count(*) AS n FROM events GROUP BY 1")
def by_first_appearance(t):
    return A.summarise(t("events"), ["event_type"], {"first_id": F.min("event_id"), "n": F.count(F.lit(1))}, order=["event_id"])


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3")
def top_n_per_group(t):
    return A.top_n(t("events"), ["user_id"], [F.desc("value"), F.asc("event_id")], 3).select("user_id", "event_id", "value")


@query("SELECT user_id, max(CASE WHEN rn = 2 THEN event_type END) AS event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events) GROUP BY 1")
def nth_value(t):
    return A.nth("event_type", 2, ["user_id"], [F.col("ts")], t("events"))


@query("SELECT o_custkey, o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) = 1")
def unique_by(t):
    return A.unique_rows(t("orders"), ["o_custkey", "o_orderstatus"], [F.col("o_orderkey")]).select("o_custkey", "o_orderstatus", "o_orderkey")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1 AS duplicated FROM orders")
def duplicated(t):
    return A.duplicated(t("orders"), ["o_custkey"], [F.col("o_orderkey")]).select("o_orderkey", "duplicated")


_CUBE = "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS grouping, round(sum(l_quantity), 2) AS q, count(*) AS n FROM lineitem GROUP BY "


@query(_CUBE + "GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())")
def grouping_sets(t):
    return A.grouping_sets(t("lineitem"), ["l_returnflag", "l_linestatus"], [["l_returnflag", "l_linestatus"], ["l_linestatus"], []], _sums())


@query(_CUBE + "CUBE (l_returnflag, l_linestatus)")
def cube(t):
    return A.cube(t("lineitem"), ["l_returnflag", "l_linestatus"], _sums())


@query(_CUBE.replace("l_returnflag, l_linestatus, CAST", "CASE WHEN grouping(l_returnflag) = 1 THEN 'all' ELSE l_returnflag END AS l_returnflag, l_linestatus, CAST") + "ROLLUP (l_returnflag, l_linestatus)")
def rollup_labels(t):
    return A.rollup(t("lineitem"), ["l_returnflag", "l_linestatus"], _sums(), labels={"l_returnflag": "all"})


def _sums() -> dict[str, Column]:
    return {"q": F.round(F.sum("l_quantity"), 2), "n": F.count(F.lit(1))}


@query("SELECT user_id, count(*) AS n, round(max(value) - min(value), 4) AS span FROM events GROUP BY 1")
def grouped_function(t):
    def run(pdf):
        import pandas as pd

        return pd.DataFrame({"user_id": [pdf.user_id.iloc[0]], "n": [len(pdf)], "span": [round(pdf.value.max() - pdf.value.min(), 4)]})

    return A.apply_groups(t("events").select("user_id", "value"), ["user_id"], run, "user_id long, n long, span double")


# --- windows ---

_BY_USER = "OVER (PARTITION BY user_id ORDER BY ts)"


def users():
    return W.window(["user_id"], ["ts"])


@query(f"SELECT event_id, lag(value, 1) {_BY_USER} AS lag1, lead(value, 2) {_BY_USER} AS lead2, coalesce(lag(value, 1) {_BY_USER}, -1) AS filled FROM events")
def shift(t):
    w = users()
    return t("events").select("event_id", W.shift("value", 1, w).alias("lag1"), W.shift("value", 2, w, "lead").alias("lead2"), W.shift("value", 1, w, fill=-1.0).alias("filled"))


@query(f"""WITH n AS (SELECT *, row_number() {_BY_USER} AS rn, count(*) OVER (PARTITION BY user_id) AS c FROM events)
SELECT a.event_id, b.value AS back FROM n a JOIN n b ON a.user_id = b.user_id AND a.rn = (b.rn - 1 + 2) % b.c + 1""")
def shift_cyclic(t):
    return W.cyclic(t("events"), "value", 2, ["user_id"], ["ts"], "back").select("event_id", "back")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rank() OVER w AS low, (rank() OVER w + count(*) OVER (PARTITION BY l_orderkey ORDER BY l_quantity RANGE UNBOUNDED PRECEDING)) / 2.0 AS average,
count(*) OVER (PARTITION BY l_orderkey ORDER BY l_quantity RANGE UNBOUNDED PRECEDING) AS high, dense_rank() OVER w AS dense FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity)""")
def frank(t):
    kinds = {"low": "min", "average": "average", "high": "max", "dense": "dense"}
    ranks = {k: W.frank([F.col("l_quantity")], ["l_orderkey"], v) for k, v in kinds.items()}
    return t("lineitem").select(*LINE[:4], *[(v if k == "average" else long(v)).alias(k) for k, v in ranks.items()])


@query(f"SELECT event_id, sum(new) {_BY_USER[:-1]} ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM (SELECT *, CASE WHEN lag(event_type) {_BY_USER} IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS new FROM events)")
def rleid(t):
    return W.with_rleid(t("events"), ["event_type"], ["user_id"], ["ts"], "run").select("event_id", long(F.col("run")).alias("run"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS id FROM events")
def rowid(t):
    return t("events").select("event_id", long(W.rowid(["user_id", "event_type"], ["ts"])).alias("id"))


_GAPS = "(SELECT event_id, user_id, ts, CASE WHEN event_id % 3 <> 0 THEN NULL ELSE value END AS v FROM events)"


@query(f"""SELECT event_id, last_value(v IGNORE NULLS) {_BY_USER[:-1]} ROWS UNBOUNDED PRECEDING) AS locf, first_value(v IGNORE NULLS) {_BY_USER[:-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nocb,
coalesce(v, 0) AS const, last_value(v IGNORE NULLS) {_BY_USER[:-1]} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS one FROM {_GAPS}""")
def nafill(t):
    gaps = t("events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"))
    w = users()
    return gaps.select("event_id", W.nafill("v", w).alias("locf"), W.nafill("v", w, "nocb").alias("nocb"), W.nafill("v", w, "const", 0.0).alias("const"), W.nafill("v", w, limit=1).alias("one"))


def _roll_sql(frame: str) -> str:
    w = f"{_BY_USER[:-1]} ROWS BETWEEN {frame})"
    names = {"mean": "avg(value)", "sum": "sum(value)", "max": "max(value)", "min": "min(value)", "sd": "stddev_samp(value)", "median": "median(value)"}
    return "SELECT event_id, " + ", ".join(f"CASE WHEN count(*) {w} = 4 THEN round({f} {w}, 4) END AS {n}" for n, f in names.items()) + " FROM events"


@query(_roll_sql("3 PRECEDING AND CURRENT ROW"))
def froll_right(t):
    return t("events").select("event_id", *[r4(W.froll(f, "value", 4, users())).alias(f) for f in ("mean", "sum", "max", "min", "sd", "median")])


@query(_roll_sql("1 PRECEDING AND 2 FOLLOWING"))
def froll_center(t):
    return t("events").select("event_id", *[r4(W.froll(f, "value", 4, users(), "center")).alias(f) for f in ("mean", "sum", "max", "min", "sd", "median")])


@query(f"""WITH e AS (SELECT *, row_number() {_BY_USER} AS rn, event_id % 4 + 1 AS n FROM events)
SELECT e.event_id, CASE WHEN e.rn >= e.n THEN round(sum(b.value), 4) END AS total FROM e JOIN e b ON b.user_id = e.user_id AND b.rn > e.rn - e.n AND b.rn <= e.rn GROUP BY e.event_id, e.rn, e.n""")
def froll_adaptive(t):
    sized = t("events").withColumn("n", F.col("event_id") % 4 + 1)
    return W.froll_adaptive(sized, "sum", "value", "n", ["user_id"], ["ts"], "total", 4).select("event_id", r4(F.col("total")).alias("total"))


@query("SELECT event_id, CASE WHEN event_id < min(event_id) OVER (PARTITION BY user_id) + 499 THEN 500 ELSE count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 499 PRECEDING AND CURRENT ROW) END AS n FROM events")
def frolladapt(t):
    return t("events").select("event_id", W.frolladapt("event_id", 500, ["user_id"]).alias("n"))


@query(f"SELECT event_id, CASE WHEN count(*) {_BY_USER[:-1]} ROWS 2 PRECEDING) = 3 THEN round(max(value) {_BY_USER[:-1]} ROWS 2 PRECEDING) - min(value) {_BY_USER[:-1]} ROWS 2 PRECEDING), 4) END AS span FROM events")
def frollapply(t):
    out = W.frollapply(t("events").select("event_id", "user_id", "ts", "value"), lambda m: m.max() - m.min(), ["value"], 3, ["user_id"], ["ts"], "span")
    return out.select("event_id", r4(F.when(~F.isnan("span"), F.col("span"))).alias("span"))


# --- joins ---


@query("SELECT c.c_custkey, c.c_name, o.o_orderkey, o.o_totalprice FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey")
def right_join(t):
    i = t("customer").select("c_custkey", "c_name")
    out = J.join(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), i, ["o_custkey==c_custkey"])
    return out.select(F.col("o_custkey").alias("c_custkey"), "c_name", "o_orderkey", "o_totalprice")


@query("SELECT c.c_custkey, o.o_orderkey FROM customer c JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) o ON o.o_custkey = c.c_custkey")
def join_mult_last(t):
    out = J.join(t("orders").select("o_custkey", "o_orderkey"), t("customer").select("c_custkey"), {"o_custkey": "c_custkey"}, nomatch=None, mult="last", order=["o_orderkey"])
    return out.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")


@query("SELECT a.s_suppkey AS i_key, b.s_suppkey AS x_key FROM supplier a LEFT JOIN supplier b ON a.s_nationkey = b.s_nationkey AND b.s_acctbal > a.s_acctbal")
def non_equi_join(t):
    x = t("supplier").select(F.col("s_nationkey"), F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("x_key"))
    i = t("supplier").select(F.col("s_nationkey"), F.col("s_acctbal").alias("ibal"), F.col("s_suppkey").alias("i_key"))
    return J.join(x, i, ["s_nationkey", "bal>ibal"]).select("i_key", "x_key")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join(t):
    return J.anti(t("customer"), t("orders"), ["c_custkey==o_custkey"]).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def semi_join(t):
    return J.semi(t("customer"), t("orders").where("o_totalprice > 150000"), ["c_custkey==o_custkey"]).select("c_custkey")


@query("SELECT c.c_custkey, count(o.o_orderkey) AS N, round(sum(o.o_totalprice), 2) AS spent FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1")
def each_i(t):
    return J.each_i(t("orders").select("o_custkey", "o_totalprice"), t("customer").select("c_custkey"), ["o_custkey==c_custkey"], {"spent": F.round(F.sum("x.o_totalprice"), 2)})


@query("SELECT s_suppkey, coalesce(n.n_name, 'x') AS tag FROM supplier s LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) n ON s.s_nationkey = n.n_nationkey")
def update_on_join(t):
    x = t("supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), F.lit("x").alias("tag"))
    i = t("nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("k"), "n_name")
    return J.update_on(x, i, ["k"], {"tag": "n_name"}, ["n_name"]).select("s_suppkey", "tag")


_P = "(SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase')"
_V = "(SELECT user_id, ts, event_id AS view_id FROM events WHERE event_type = 'view')"


def _asof(t) -> tuple[DataFrame, DataFrame]:
    e = t("events")
    return e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id")), e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")


@query(f"SELECT p.event_id, v.view_id FROM {_P} p ASOF LEFT JOIN {_V} v ON p.user_id = v.user_id AND p.ts >= v.ts")
def rolling_locf(t):
    x, i = _asof(t)
    return J.rolling(x, i, ["user_id"], "ts").select("event_id", "view_id")


@query(f"SELECT p.event_id, v.view_id FROM {_P} p ASOF LEFT JOIN {_V} v ON p.user_id = v.user_id AND p.ts <= v.ts")
def rolling_nocb(t):
    x, i = _asof(t)
    return J.rolling(x, i, ["user_id"], "ts", float("-inf")).select("event_id", "view_id")


@query(f"SELECT p.event_id, CASE WHEN epoch_us(p.ts) - epoch_us(v.ts) <= 36000000000 THEN v.view_id END AS view_id FROM {_P} p ASOF LEFT JOIN {_V} v ON p.user_id = v.user_id AND p.ts >= v.ts")
def rolling_limit(t):
    x, i = _asof(t)
    return J.rolling(x, i, ["user_id"], "ts", 36000).select("event_id", "view_id")


@query(f"""WITH b AS (SELECT p.event_id, p.ts, v.view_id, v.ts AS vts FROM {_P} p ASOF LEFT JOIN {_V} v ON p.user_id = v.user_id AND p.ts >= v.ts),
a AS (SELECT p.event_id, v.view_id, v.ts AS vts FROM {_P} p ASOF LEFT JOIN {_V} v ON p.user_id = v.user_id AND p.ts <= v.ts)
SELECT b.event_id, CASE WHEN b.vts IS NULL THEN a.view_id WHEN a.vts IS NULL THEN b.view_id WHEN b.ts - b.vts <= a.vts - b.ts THEN b.view_id ELSE a.view_id END AS view_id FROM b JOIN a USING (event_id)""")
def rolling_nearest(t):
    x, i = _asof(t)
    return J.rolling(x, i, ["user_id"], "ts", "nearest").select("event_id", "view_id")


_SPANS = "SELECT {k} AS {n}, user_id, {k} AS a, {k} + {w} AS b FROM events WHERE event_type = '{e}'"


@query(f"WITH x AS ({_SPANS.format(k='event_id', n='xid', w=40, e='view')}), y AS ({_SPANS.format(k='event_id', n='yid', w=90, e='purchase')}) SELECT x.xid, y.yid FROM x JOIN y ON x.a <= y.b AND x.b >= y.a")
def overlaps_binned(t):
    e, k = t("events"), F.col("event_id")
    x = e.where("event_type = 'view'").select(k.alias("xid"), k.alias("a"), (k + 40).alias("b"))
    y = e.where("event_type = 'purchase'").select(k.alias("yid"), k.alias("c"), (k + 90).alias("d"))
    return J.overlaps(x, y, [], ("a", "b"), ("c", "d"), width=100, nomatch=None).select("xid", "yid")


@query("SELECT coalesce(a.k, b.k) AS k, a.v AS \"v.x\", b.v AS \"v.y\" FROM (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT n_nationkey AS k, n_regionkey AS v FROM nation WHERE n_nationkey > 5) b ON a.k = b.k")
def merge_full(t):
    n = t("nation")
    a = n.where("n_nationkey < 15").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    b = n.where("n_nationkey > 5").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("v"))
    return J.merge(a, b, ["k"], True, True)


@query("SELECT o.o_custkey AS k, o_orderkey, c_name, n FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) s ON s.o_custkey = o.o_custkey")
def merge_list(t):
    o = t("orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return J.merge_list([o, t("customer").select(F.col("c_custkey").alias("k"), "c_name"), o.groupBy("k").agg(F.count(F.lit(1)).alias("n"))], ["k"])


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1""")
def star_join(t):
    f = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    f = f.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    f = f.join(t("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return f.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


# --- sets and shapes ---

_A, _B = "SELECT l_returnflag AS f, l_quantity AS q FROM lineitem WHERE l_orderkey % 2 = 0", "SELECT l_returnflag AS f, l_quantity AS q FROM lineitem WHERE l_orderkey % 3 = 0"


def _pair(t) -> tuple[DataFrame, DataFrame]:
    c = [F.col("l_returnflag").alias("f"), F.col("l_quantity").alias("q")]
    return t("lineitem").where("l_orderkey % 2 = 0").select(*c), t("lineitem").where("l_orderkey % 3 = 0").select(*c)


@query(f"({_A}) UNION ({_B})")
def set_union(t):
    return U.union(*_pair(t))


@query(f"({_A}) INTERSECT ALL ({_B})")
def set_intersect_all(t):
    return U.intersect(*_pair(t), True)


@query(f"({_A}) EXCEPT ALL ({_B})")
def set_diff_all(t):
    return U.setdiff(*_pair(t), True)


@query("SELECT 'n' AS src, n_nationkey AS k, n_name AS name, NULL::INTEGER AS extra FROM nation UNION ALL SELECT 'r', r_regionkey, r_name, r_regionkey FROM region")
def bind_rows(t):
    a = t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return U.bind_rows({"n": a, "r": t("region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("extra"))}, fill=True, idcol="src")


@query("SELECT a.n_name, b.c_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) AS rn FROM nation) a JOIN (SELECT c_name, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer) b USING (rn)")
def bind_columns(t):
    return U.bind_columns(t("nation").select("n_name"), t("customer").select("c_name", "c_custkey").orderBy("c_custkey").limit(25), ["n_name"], ["c_custkey"]).select("n_name", "c_name")


@query("SELECT p_partkey, variable, value FROM (SELECT p_partkey, p_size::DOUBLE AS size, p_retailprice AS price FROM part) UNPIVOT (value FOR variable IN (size, price))")
def melt(t):
    wide = t("part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return R.melt(wide, ["p_partkey"], ["size", "price"])


_W4 = "SELECT o_orderkey, o_custkey AS cust_1, o_custkey + 1 AS cust_2, o_totalprice AS price_1, o_totalprice * 2 AS price_2 FROM orders"


@query(f"WITH w AS ({_W4}) SELECT o_orderkey, 1 AS step, cust_1 AS cust, price_1 AS price FROM w UNION ALL SELECT o_orderkey, 2, cust_2, price_2 FROM w")
def melt_measure(t):
    c = F.col
    wide = t("orders").select("o_orderkey", c("o_custkey").alias("cust_1"), (c("o_custkey") + 1).alias("cust_2"), c("o_totalprice").alias("price_1"), (c("o_totalprice") * 2).alias("price_2"))
    return R.melt_measure(wide, ["o_orderkey"], R.measure(wide, r"(\w+)_(\d)", ["value.name", "step"], {"step": int}))


@query("SELECT l_suppkey, " + ", ".join(f"coalesce(round(sum(CASE WHEN l_returnflag = '{v}' THEN l_quantity END), 2), 0) AS \"{v}\"" for v in "ANR") + " FROM lineitem GROUP BY 1")
def dcast(t):
    return R.dcast(t("lineitem"), ["l_suppkey"], ["l_returnflag"], {"q": lambda here: F.round(F.sum(F.when(here, F.col("l_quantity"))), 2)}, fill=0.0)


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def time_windows(t):
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = Z.windowed(e, "ts", "1 day", {"n": F.count(F.lit(1)), "total": r4(F.sum("value"))}, ["event_type"])
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
