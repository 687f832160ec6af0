"""NaN, large groups, guards, positions, formulas and file options as queries beside their SQL. They are added to the catalogue's own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slate.frame import Frame, rowwise, tables
from slate.functions import dates as D
from slate.functions import scalar as S
from slate.operators import aggregate as A
from slate.operators import joins as J
from slate.operators import reshape as R
from slate.operators import rows as N
from slate.operators import sets as U
from slate.operators import window as W
from slate.plans.catalogue import _BY_USER, _P, _SPANS, _V, _asof, long, query, r4, users
from slate.sources.csv import read_csv, read_frame, write_csv
from slate.sources.staged import fresh_path

c = F.col
NAN = float("nan")

# --- missing values and NaN ---

_ODD = "(SELECT event_id, user_id, event_type, ts, value, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'nan'::DOUBLE ELSE value END AS v, CASE WHEN event_id % 7 = 0 THEN 'nan'::DOUBLE ELSE value END AS n, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN NULL ELSE value END AS k FROM events)"


def odd(t) -> DataFrame:
    """Events with a column of missing values and NaN, and one of NaN only."""
    n = F.when(c("event_id") % 7 == 0, NAN).otherwise(c("value"))
    return t("events").select("event_id", "user_id", "event_type", "ts", "value", F.when(c("event_id") % 5 != 0, n).alias("v"), n.alias("n"))


@query(f"""SELECT user_id, round(coalesce(sum(k), 0), 4) AS total, CASE WHEN count(k) = 0 THEN 'nan'::DOUBLE ELSE round(avg(k), 6) END AS mean, round(median(k), 4) AS median, round(var_samp(k), 4) AS var, min(k) AS lo, max(k) AS hi,
CASE WHEN bool_or(isnan(n)) THEN 'nan'::DOUBLE ELSE round(sum(n), 4) END AS total_n, CASE WHEN bool_or(isnan(n)) THEN 'nan'::DOUBLE ELSE round(median(n), 4) END AS median_n, CASE WHEN bool_or(isnan(n)) THEN 'nan'::DOUBLE ELSE max(n) END AS hi_n,
CASE WHEN bool_or(isnan(n)) THEN 'nan'::DOUBLE ELSE min(n) END AS lo_n FROM {_ODD} GROUP BY 1""")
def aggregates_nan(t):
    j = {"total": r4(A.total("v", True)), "mean": F.round(A.mean("v", True), 6), "median": r4(A.median("v", True)), "var": r4(A.var("v", True)), "lo": A.least("v", True, True), "hi": A.greatest("v", True, True)}
    j |= {"total_n": r4(A.total("n")), "median_n": r4(A.median("n")), "hi_n": A.greatest("n", floating=True), "lo_n": A.least("n", floating=True)}
    return A.summarise(odd(t), ["user_id"], j)


@query(f"""SELECT event_type, event_id % 50 AS part, CASE WHEN count(w) < count(*) OR count(value) < count(*) THEN NULL WHEN sum(w) = 0 THEN 'nan'::DOUBLE ELSE round(sum(value * w) / sum(w), 4) END AS plain,
CASE WHEN count(*) FILTER (k IS NOT NULL AND w IS NULL) > 0 THEN NULL WHEN coalesce(sum(w) FILTER (k IS NOT NULL), 0) = 0 THEN 'nan'::DOUBLE ELSE round(sum(k * w) / sum(w) FILTER (k IS NOT NULL), 4) END AS loose
FROM (SELECT *, nullif(event_id % 4, 3)::DOUBLE AS w FROM {_ODD}) GROUP BY 1, 2""")
def weighted_means(t):
    x = odd(t).withColumns({"part": c("event_id") % 50, "w": F.nullif(c("event_id") % 4, F.lit(3)).cast("double")})
    return A.summarise(x, ["event_type", "part"], {"plain": r4(A.weighted_mean("value", "w")), "loose": r4(A.weighted_mean("v", "w", True))})


_W3 = f"{_BY_USER[:-1]} ROWS 2 PRECEDING)"


@query(f"""SELECT event_id, CASE WHEN r = 3 THEN round(coalesce(s, 0), 4) END AS sum_rm, CASE WHEN r = 3 THEN coalesce(lo, 'inf'::DOUBLE) END AS min_rm, CASE WHEN r = 3 THEN round(med, 4) END AS median_rm,
CASE WHEN r = 3 THEN CASE WHEN bad THEN 'nan'::DOUBLE ELSE round(sn, 4) END END AS sum_n, CASE WHEN r = 3 THEN CASE WHEN bad THEN 'nan'::DOUBLE ELSE ln END END AS min_n
FROM (SELECT event_id, count(*) {_W3} AS r, sum(k) {_W3} AS s, min(k) {_W3} AS lo, median(k) {_W3} AS med, coalesce(bool_or(isnan(n)) {_W3}, false) AS bad, sum(n) {_W3} AS sn, min(n) {_W3} AS ln FROM {_ODD})""")
def froll_nan(t):
    w = users()
    rolled = {"sum_rm": W.froll("sum", "v", 3, w, na_rm=True), "min_rm": W.froll("min", "v", 3, w, na_rm=True), "median_rm": W.froll("median", "v", 3, w, na_rm=True), "sum_n": W.froll("sum", "n", 3, w), "min_n": W.froll("min", "n", 3, w)}
    return odd(t).select("event_id", *[r4(v).alias(k) for k, v in rolled.items()])


@query(f"""WITH e AS (SELECT *, row_number() {_BY_USER} AS rn, event_id % 4 + 1 AS m FROM {_ODD}) SELECT e.event_id, CASE WHEN e.rn >= e.m THEN round(coalesce(sum(b.k), 0), 4) END AS loose,
CASE WHEN e.rn >= e.m THEN CASE WHEN bool_or(isnan(b.n)) THEN 'nan'::DOUBLE ELSE max(b.n) END END AS strict FROM e JOIN e b ON b.user_id = e.user_id AND b.rn > e.rn - e.m AND b.rn <= e.rn GROUP BY e.event_id, e.rn, e.m""")
def froll_adaptive_nan(t):
    sized = odd(t).withColumn("m", c("event_id") % 4 + 1)
    out = W.froll_adaptive(sized, "sum", "v", "m", ["user_id"], ["ts"], "loose", 4, na_rm=True)
    return W.froll_adaptive(out, "max", "n", "m", ["user_id"], ["ts"], "strict", 4).select("event_id", r4(c("loose")).alias("loose"), "strict")


@query(f"SELECT event_id, last_value(k IGNORE NULLS) {_BY_USER[:-1]} ROWS UNBOUNDED PRECEDING) AS locf, first_value(k IGNORE NULLS) {_BY_USER[:-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nocb FROM {_ODD}")
def nafill_nan(t):
    w = users()
    return odd(t).select("event_id", W.nafill("v", w, nan_missing=True).alias("locf"), W.nafill("v", w, "nocb", nan_missing=True).alias("nocb"))


@query(f"SELECT event_id, v IS NULL OR isnan(v) AS v FROM {_ODD}")
def is_na(t):
    x = odd(t)
    return x.select("event_id", S.is_na("v", floating=True).alias("v"))


@query(f"SELECT event_id FROM {_ODD} WHERE k IS NOT NULL")
def na_omit_nan(t):
    return Frame(odd(t)).na_omit(["v"]).df.select("event_id")


# --- groups of any size ---


@query("SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS locf, first_value(v IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nocb FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events)")
def nafill_one_group(t):
    gaps = t("events").select("event_id", "ts", F.when(c("event_id") % 3 == 0, c("value")).alias("v"))
    out = W.nafill_spread(gaps, "v", [], ["ts"], "locf")
    return W.nafill_spread(out, "v", [], ["ts"], "nocb", "nocb").select("event_id", "locf", "nocb")


@query("SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING), -1) AS locf FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events)")
def nafill_large_groups(t):
    gaps = t("events").select("event_id", "event_type", "ts", F.when(c("event_id") % 3 == 0, c("value")).alias("v"))
    return W.nafill_spread(gaps, "v", ["event_type"], ["ts"], "locf", fill=-1.0).select("event_id", "locf")


@query(f"SELECT p.event_id, v.view_id FROM {_P} p ASOF LEFT JOIN {_V} v ON p.ts >= v.ts")
def rolling_one_group(t):
    x, i = _asof(t)
    return J.rolling(x.drop("user_id"), i.drop("user_id"), [], "ts").select("event_id", "view_id")


_NEAR = """WITH b AS (SELECT p.event_id, p.ts, v.view_id, v.ts AS vts FROM {p} p ASOF LEFT JOIN {v} v ON {on}p.ts >= v.ts),
a AS (SELECT p.event_id, v.view_id, v.ts AS vts FROM {p} p ASOF LEFT JOIN {v} v ON {on}p.ts <= v.ts)
SELECT b.event_id, CASE WHEN b.vts IS NULL THEN a.view_id WHEN a.vts IS NULL THEN b.view_id WHEN b.ts - b.vts <= a.vts - b.ts THEN b.view_id ELSE a.view_id END AS view_id FROM b JOIN a USING (event_id)"""


@query(_NEAR.format(p=_P, v=_V, on=""))
def rolling_nearest_one_group(t):
    x, i = _asof(t)
    return J.rolling(x.drop("user_id"), i.drop("user_id"), [], "ts", "nearest").select("event_id", "view_id")


@query(_NEAR.format(p=_P, v=_V, on="p.user_id = v.user_id AND "))
def rolling_nearest_spread(t):
    x, i = _asof(t)
    return J.rolling(x, i, ["user_id"], "ts", "nearest", spread=True).select("event_id", "view_id")


# --- joins ---


@query("SELECT o.o_orderkey, c.c_name FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey")
def join_mult_error(t):
    out = J.join(t("customer").select("c_custkey", "c_name"), t("orders").select("o_orderkey", "o_custkey"), {"c_custkey": "o_custkey"}, mult="error")
    return out.select("o_orderkey", "c_name")


@query("SELECT a.s_suppkey AS i_key, (SELECT arg_min(b.s_suppkey, (b.s_acctbal, b.s_suppkey)) FROM supplier b WHERE b.s_nationkey = a.s_nationkey AND b.s_acctbal > a.s_acctbal) AS x_key FROM supplier a")
def non_equi_first(t):
    x = t("supplier").select("s_nationkey", c("s_acctbal").alias("bal"), c("s_acctbal").alias("o"), c("s_suppkey").alias("x_key"))
    i = t("supplier").select("s_nationkey", c("s_acctbal").alias("ibal"), c("s_suppkey").alias("i_key"))
    return J.join(x, i, ["s_nationkey", "bal>ibal"], mult="first", order=["o", "x_key"]).select("i_key", "x_key")


@query("SELECT a.s_suppkey AS i_key, (SELECT arg_max(b.s_suppkey, (b.s_acctbal, b.s_suppkey)) FROM supplier b WHERE b.s_nationkey = a.s_nationkey AND b.s_acctbal < a.s_acctbal) AS x_key FROM supplier a")
def non_equi_last(t):
    x = t("supplier").select("s_nationkey", c("s_acctbal").alias("bal"), c("s_acctbal").alias("o"), c("s_suppkey").alias("x_key"))
    i = t("supplier").select("s_nationkey", c("s_acctbal").alias("ibal"), c("s_suppkey").alias("i_key"))
    return J.join(x, i, ["s_nationkey", "bal<ibal"], mult="last", order=["o", "x_key"]).select("i_key", "x_key")


@query("WITH x AS (SELECT n_regionkey, row_number() OVER (ORDER BY n_name) AS rn FROM nation) SELECT x.rn AS which FROM (SELECT s_suppkey % 7 AS k FROM supplier) s LEFT JOIN x ON x.n_regionkey = s.k")
def which_matches(t):
    return J.matches(t("nation"), t("supplier").select((c("s_suppkey") % 7).cast("int").alias("k")), ["n_regionkey==k"], ["n_name"])


@query("SELECT rn AS which FROM (SELECT s_suppkey % 7 AS k, row_number() OVER (ORDER BY s_suppkey) AS rn FROM supplier) WHERE k NOT IN (SELECT n_regionkey FROM nation)")
def which_unmatched(t):
    return J.unmatched(t("nation"), t("supplier").select((c("s_suppkey") % 7).cast("int").alias("k"), "s_suppkey"), ["n_regionkey==k"], ["s_suppkey"])


@query("SELECT rn AS which FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS rn, o_totalprice FROM orders) WHERE o_totalprice > 300000")
def which_rows(t):
    return Frame(t("orders").select("o_orderkey", "o_totalprice"), ("o_orderkey",)).which(c("o_totalprice") > 300000).df


@query("SELECT k, count(o.o_orderkey) AS N FROM (SELECT (s_suppkey % 5)::BIGINT AS k, row_number() OVER () AS r FROM supplier) s LEFT JOIN orders o ON o.o_custkey = s.k GROUP BY k, r")
def each_i_repeated(t):
    return J.each_i(t("orders").select("o_custkey"), t("supplier").select((c("s_suppkey") % 5).alias("k")), ["o_custkey==k"], {}).select("k", "N")


_X, _Y = _SPANS.format(k="event_id", n="xid", w=40, e="view"), _SPANS.format(k="event_id", n="yid", w=90, e="purchase")


def _intervals(t) -> tuple[DataFrame, DataFrame]:
    e, k = t("events"), c("event_id")
    return e.where("event_type = 'view'").select(k.alias("xid"), k.alias("a"), (k + 40).alias("b")), e.where("event_type = 'purchase'").select(k.alias("yid"), k.alias("c"), (k + 90).alias("d"))


@query(f"WITH x AS ({_X}), y AS ({_Y}) SELECT x.xid, max(y.yid) AS yid FROM x LEFT JOIN y ON x.a <= y.b AND x.b >= y.a GROUP BY 1")
def overlaps_last(t):
    return J.overlaps(*_intervals(t), [], ("a", "b"), ("c", "d"), width=100, mult="last", order=["yid"]).select("xid", "yid")


@query(f"WITH x AS (SELECT *, row_number() OVER (ORDER BY xid) AS xn FROM ({_X})), y AS (SELECT *, row_number() OVER (ORDER BY yid) AS yn FROM ({_Y})) SELECT xn AS xid, yn AS yid FROM x JOIN y ON x.a <= y.b AND x.b >= y.a")
def overlap_positions(t):
    x, y = _intervals(t)
    x, y = x.withColumnRenamed("xid", "x0"), y.withColumnRenamed("yid", "y0")
    return J.overlap_rows(x, y, [], ("a", "b"), ("c", "d"), ["x0"], ["y0"], width=100, nomatch=None)


@query("SELECT s_suppkey, s_nationkey AS nation, n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON s_nationkey = n_nationkey")
def merge_by_names(t):
    x = t("supplier").select("s_suppkey", c("s_nationkey").alias("nation"))
    return J.merge(x, t("nation").where("n_nationkey < 20").select("n_nationkey", "n_name"), all_x=True, by_x=["nation"], by_y=["n_nationkey"])


@query("SELECT s_suppkey, nation, n_name, region, r_name FROM (SELECT s_suppkey, s_nationkey AS nation FROM supplier) LEFT JOIN (SELECT n_nationkey AS nation, n_name, n_regionkey AS region FROM nation) USING (nation) JOIN (SELECT r_regionkey AS region, r_name FROM region WHERE r_name <> 'ASIA') USING (region)")
def merge_list_star(t):
    s = t("supplier").select("s_suppkey", c("s_nationkey").alias("nation"))
    n = t("nation").select(c("n_nationkey").alias("nation"), "n_name", c("n_regionkey").alias("region"))
    r = t("region").where("r_name <> 'ASIA'").select(c("r_regionkey").alias("region"), "r_name")
    return J.merge_list([s, n, r], [["nation"], ["region"]], ["left", "inner"], ["error", "all"])


@query("SELECT n_name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def join_guarded(t):
    out = J.join(t("customer").select("c_nationkey", "c_custkey"), t("nation").select("n_nationkey", "n_name"), ["c_nationkey==n_nationkey"], None, cartesian=False, many=False)
    return out.groupBy("n_name").agg(F.count("*").alias("n"))


# --- rows, columns and tables ---


@query("""WITH x AS (SELECT s_suppkey, s_nationkey % 9 AS k, row_number() OVER (PARTITION BY s_nationkey % 9 ORDER BY s_suppkey) AS r FROM supplier),
n AS (SELECT n_regionkey, rn, row_number() OVER (PARTITION BY n_regionkey ORDER BY rn) AS r FROM (SELECT n_regionkey, row_number() OVER (ORDER BY n_name) AS rn FROM nation)) SELECT s_suppkey, n.rn AS position FROM x LEFT JOIN n ON x.k = n.n_regionkey AND x.r = n.r""")
def match_each(t):
    x = t("supplier").select("s_suppkey", (c("s_nationkey") % 9).alias("k"))
    return N.match_position_each(x, "k", ["s_suppkey"], t("nation"), "n_regionkey", ["n_name"]).select("s_suppkey", "position")


@query("SELECT true AS by_key, false AS by_price, false AS strictly")
def sortedness(t):
    o = t("orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    found = (N.is_sorted(o, ["o_orderkey"], ["o_orderkey"]), N.is_sorted(o, ["o_totalprice"], ["o_orderkey"]), N.is_sorted(o, ["o_orderstatus"], ["o_orderstatus", "o_orderkey"], strictly=True))
    return o.sparkSession.createDataFrame([found], "by_key boolean, by_price boolean, strictly boolean")


@query(f"SELECT event_id, 'u' || row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS id, 'r' || sum(new) {_BY_USER[:-1]} ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM (SELECT *, CASE WHEN lag(event_type) {_BY_USER} IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS new FROM events)")
def prefixed_ids(t):
    out = W.with_rleid(t("events"), ["event_type"], ["user_id"], ["ts"], "run", "r")
    return out.select("event_id", W.rowid(["user_id", "event_type"], ["ts"], "u").alias("id"), "run")


@query("SELECT n_nationkey, CASE WHEN rn IN (2, 4) THEN 'x' ELSE n_name END AS n_name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS rn FROM nation)")
def set_values(t):
    return Frame(t("nation").select("n_nationkey", "n_name"), ("n_nationkey",)).set([2, 4], ["n_name"], "x").df


@query("SELECT (n_nationkey * 2)::INTEGER AS a, (n_regionkey * 2)::INTEGER AS b FROM nation")
def table_arithmetic(t):
    f = Frame(t("nation").select(c("n_nationkey").alias("a"), c("n_regionkey").alias("b")), ("a",))
    return f.ops(lambda x, y: x + y, f).df


@query("SELECT p_partkey, p_size + 1 AS p_size, (p_size + 1) * 2 AS twice, p_size * 3 AS thrice FROM part")
def transform_within(t):
    f = Frame(t("part").select("p_partkey", "p_size")).transform(thrice=c("p_size") * 3, p_size=c("p_size") + 1)
    return f.within(("twice", c("p_size") * 2), ("gone", F.lit(1)), ("gone", None)).df.select("p_partkey", "p_size", "twice", "thrice")


@query("SELECT o_orderstatus, round(sum(o_totalprice * 2), 2) AS t FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1")
def substituted(t):
    env = {"v": "o_totalprice", "f": S.I(2), "p": "o_orderpriority", "wanted": S.I("1-URGENT")}
    return t("orders").where(S.substitute("p = wanted", env)).groupBy("o_orderstatus").agg(F.round(S.substitute("sum(v * f)", env), 2).alias("t"))


@query("SELECT r.a, r.b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) r(a, b)")
def row_by_row(t):
    return rowwise(t("region").sparkSession, ["a", "b"], 1, "x", 2, "y", 3, None, schema="a int, b string")


@query("SELECT 'n' AS name, 25::BIGINT AS rows, 'n_nationkey,n_name' AS columns, 'n_name' AS key, 'n_nationkey' AS indexes UNION ALL SELECT 'r', 5, 'r_regionkey,r_name', '', ''")
def table_list(t):
    n = Frame(t("nation").select("n_nationkey", "n_name")).set_key("n_name").set_index("n_nationkey")
    return tables(t("region").sparkSession, {"n": n, "r": Frame(t("region"))})


@query("SELECT event_id, part FROM (SELECT event_id, 'head' AS part, row_number() OVER (ORDER BY ts DESC) AS r FROM events UNION ALL SELECT event_id, 'tail', row_number() OVER (ORDER BY ts) FROM events) WHERE r > 5")
def head_tail_negative(t):
    f = Frame(t("events").select("event_id", "ts"), ("ts",))
    return f.head(-5).df.select("event_id", F.lit("head").alias("part")).union(f.tail(-5).df.select("event_id", F.lit("tail")))


@query("SELECT o_orderkey, split_part(o_orderpriority, '-', 2) AS word, split_part(o_orderpriority, '-', 1)::INTEGER AS number FROM orders")
def split_columns(t):
    out = S.split_columns(t("orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "-", ["number", "word"], types={1: "int"})
    return out.select("o_orderkey", "word", "number")


@query("SELECT o_orderstatus || '/' || o_orderpriority AS part, count(*) AS n FROM orders GROUP BY 1")
def split_nested(t):
    parts = U.split(t("orders").select("o_orderstatus", "o_orderpriority", "o_orderkey"), ["o_orderstatus", "o_orderpriority"], flatten=False, keep_by=False)
    return U.bind_rows({f"{a}/{b}": p for a, inner in parts.items() for b, p in inner.items()}, idcol="part").groupBy("part").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def rounded_keys(t):
    key = S.numeric_key(c("event_id") / 3 * (1 + (c("user_id") % 2) * F.lit(1e-15)), 2)
    near = S.numeric_key(c("event_id") / 3, 2)
    return t("events").where(key == near).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, DATE '1970-01-01' + CAST(floor(avg(CAST(o_orderdate AS DATE) - DATE '1970-01-01')) AS INTEGER) AS mean, min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders GROUP BY 1")
def date_summaries(t):
    d = F.to_date("o_orderdate")
    return t("orders").groupBy("o_orderstatus").agg(D.mean_date(d).alias("mean"), F.min(d).alias("lo"), F.max(d).alias("hi"))


@query("SELECT n_nationkey, CAST(d AS DATE) AS d, CAST(date_trunc('week', d) AS DATE) AS w FROM nation, LATERAL (SELECT unnest(generate_series(TIMESTAMP '2024-01-30', TIMESTAMP '2024-01-30' + to_days(n_nationkey), INTERVAL 7 DAY)) AS d)")
def date_sequences(t):
    start = F.lit("2024-01-30").cast("date")
    days = t("nation").select("n_nationkey", F.explode(D.date_seq(start, F.date_add(start, c("n_nationkey")), "7 days")).alias("d"))
    return days.select("n_nationkey", "d", D.date_cut(c("d"), "weeks").alias("w"))


# --- windows and shapes ---


@query(f"SELECT event_id, lag(value, 1) {_BY_USER} AS value_lag_1, lag(value, 2) {_BY_USER} AS value_lag_2, lag(event_type, 1) {_BY_USER} AS event_type_lag_1, lag(event_type, 2) {_BY_USER} AS event_type_lag_2 FROM events")
def shift_several(t):
    shifted = W.shift_columns(["value", "event_type"], [1, 2], users())
    return t("events").select("event_id", *[v.alias(k) for k, v in shifted.items()])


@query("SELECT event_id, " + ", ".join(f"CASE WHEN count(*) OVER w{n} = {n} THEN round(avg({x}) OVER w{n}, 4) END AS {x}_rollmean{n}" for x in ("value", "twice") for n in (2, 3)) + " FROM (SELECT *, value * 2 AS twice FROM events) WINDOW w2 AS (PARTITION BY user_id ORDER BY ts ROWS 1 PRECEDING), w3 AS (PARTITION BY user_id ORDER BY ts ROWS 2 PRECEDING)")
def froll_several(t):
    rolled = W.froll_columns("mean", ["value", "twice"], [2, 3], users())
    return t("events").withColumn("twice", c("value") * 2).select("event_id", *[r4(v).alias(k) for k, v in rolled.items()])


@query("SELECT event_id, CASE WHEN v IS NOT NULL THEN rank() OVER (PARTITION BY user_id ORDER BY v ASC NULLS LAST) END AS keep, rank() OVER (PARTITION BY user_id ORDER BY v DESC NULLS FIRST) AS first FROM (SELECT *, CASE WHEN event_id % 5 <> 0 THEN value END AS v FROM events)")
def frank_kept(t):
    x = t("events").select("event_id", "user_id", F.when(c("event_id") % 5 != 0, c("value")).alias("v"))
    return x.select("event_id", long(W.frank_missing("v", ["user_id"], "keep", ties="min")).alias("keep"), long(W.frank_missing("v", ["user_id"], False, True, "min")).alias("first"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 499 PRECEDING AND CURRENT ROW) AS n FROM events")
def frolladapt_partial(t):
    return t("events").select("event_id", W.frolladapt("event_id", 500, ["user_id"], partial=True).alias("n"))


@query("SELECT l_suppkey, l_returnflag, count(*) FILTER (l_linestatus = 'F') AS \"F\", count(*) FILTER (l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY 1, 2")
def dcast_counted(t):
    return R.dcast_formula(t("lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", "l_quantity"), "... ~ l_linestatus", ["l_quantity"], fill=0)


@query("SELECT year(l_shipdate)::INTEGER AS y, " + ", ".join(f"round({f}(l_quantity) FILTER (l_linestatus = '{s}'), 4) AS \"{n}_{s}\"" for n, f in (("mean", "avg"), ("top", "max")) for s in "FO") + " FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1")
def dcast_expression(t):
    aggs = {"mean": lambda x: r4(F.avg(x)), "top": lambda x: r4(F.max(x))}
    out = R.dcast_formula(t("lineitem"), "year(l_shipdate) ~ l_linestatus", ["l_quantity"], aggs, subset=c("l_returnflag") != "A", levels=[("F",), ("O",)])
    return out.withColumnRenamed("year(l_shipdate)", "y")


@query("SELECT l_returnflag, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1")
def dcast_no_columns(t):
    out = R.dcast_formula(t("lineitem"), "l_returnflag ~ .", ["l_quantity"], {"sum": lambda x: F.round(F.sum(x), 2)})
    return out.withColumnRenamed(".", "total")


@query("SELECT o_orderkey, 1 AS step, o_custkey AS cust, o_totalprice AS price FROM orders UNION ALL SELECT o_orderkey, 2, o_custkey + 1, o_totalprice * 2 FROM orders")
def melt_separated(t):
    wide = t("orders").select("o_orderkey", c("o_custkey").alias("cust.1"), (c("o_custkey") + 1).alias("cust.2"), c("o_totalprice").alias("price.1"), (c("o_totalprice") * 2).alias("price.2"))
    return R.melt_measure(wide, ["o_orderkey"], R.measure(wide.drop("o_orderkey"), groups=["value.name", "step"], convert={"step": int}, sep="."))


# --- files ---


@query("SELECT c_custkey, c_name, c_acctbal, DATE '2024-02-29' AS d, c_custkey % 2 = 0 AS even FROM customer")
def csv_found_types(t):
    path, x = fresh_path(t("customer").sparkSession), t("customer")
    write_csv(x.select("c_custkey", "c_name", "c_acctbal", F.lit("2024-02-29").cast("date").alias("d"), (c("c_custkey") % 2 == 0).alias("even")), path, sep=";", dec=",", quote=True)
    return read_csv(x.sparkSession, path).withColumn("c_custkey", c("c_custkey").cast("long"))


@query("SELECT c_custkey::VARCHAR AS id, c_acctbal AS bal FROM customer UNION ALL SELECT 'last, of all', 0.5")
def csv_late_value(t):
    spark, path = t("customer").sparkSession, fresh_path(t("customer").sparkSession)
    write_csv(t("customer").select(c("c_custkey").cast("string").alias("id"), c("c_acctbal").alias("bal")), path)
    write_csv(spark.createDataFrame([("last, of all", 0.5)], "id string, bal double"), path, mode="append")
    return read_csv(spark, path)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_yaml(t):
    spark, path = t("nation").sparkSession, fresh_path(t("nation").sparkSession)
    write_csv(t("nation"), path, sep="|", yaml=True, bom=True)
    return read_csv(spark, path, csvy=True)


@query("SELECT n_name AS name, n_nationkey AS k FROM nation")
def csv_skipped_head(t):
    spark, path = t("nation").sparkSession, fresh_path(t("nation").sparkSession)
    lines = ["some note", "by hand, of no use", "name\tk", *[f'"{r.n_name}"\t{r.n_nationkey}' for r in t("nation").collect()]]
    spark.createDataFrame([(k, v) for k, v in enumerate(lines)], "at int, value string").coalesce(1).sortWithinPartitions("at").select("value").write.text(path)
    return read_frame(spark, path, key=["name"], skip="name\t").df.select("name", "k")
