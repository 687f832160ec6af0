"""Aggregates that say what they do with missing values, first and last by an explicit order, grouping sets."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slate.functions.scalar import col, divide, lit, not_nan, sort_key
from slate.operators.rows import number_rows


def _gate(x: Column, out: Column) -> Column:
    """Missing as soon as one value is."""
    return F.when(F.count(x) == F.count(F.lit(1)), out)


def total(x: Column | str, na_rm: bool = False) -> Column:
    """Sum; ``na_rm`` leaves out missing values and NaN, here and in the aggregates below."""
    x = col(x)
    if na_rm:
        x = not_nan(x)
        return F.coalesce(F.sum(x), F.sum(x * 0), F.lit(0))
    return F.when(F.count(F.lit(1)) == 0, F.lit(0)).otherwise(_gate(x, F.sum(x)))


def mean(x: Column | str, na_rm: bool = False) -> Column:
    x = col(x).cast("double")
    return F.coalesce(F.avg(not_nan(x)), F.lit(float("nan"))) if na_rm else _gate(x, F.avg(x))


def least(x: Column | str, na_rm: bool = False, floating: bool = False) -> Column:
    return _extreme(F.min, col(x), na_rm, floating)


def greatest(x: Column | str, na_rm: bool = False, floating: bool = False) -> Column:
    return _extreme(F.max, col(x), na_rm, floating)


def _extreme(f: Callable, x: Column, na_rm: bool, floating: bool) -> Column:
    if na_rm:
        return f(F.when(~F.isnan(x), x) if floating else x)
    out = _gate(x, f(x))
    return F.when(F.bool_or(F.isnan(x)), F.lit(float("nan"))).otherwise(out) if floating else out


def median(x: Column | str, na_rm: bool = False) -> Column:
    x = col(x)
    return F.median(not_nan(x)) if na_rm else _gate(x, F.when(F.bool_or(F.isnan(x)), F.lit(float("nan"))).otherwise(F.median(x)))


def var(x: Column | str, na_rm: bool = False) -> Column:
    x = col(x)
    return F.var_samp(not_nan(x)) if na_rm else _gate(x, F.var_samp(x))


def sd(x: Column | str, na_rm: bool = False) -> Column:
    return F.sqrt(var(x, na_rm))


def prod(x: Column | str, na_rm: bool = False) -> Column:
    x = col(x)
    return F.coalesce(F.product(not_nan(x)), F.lit(1.0)) if na_rm else _gate(x, F.product(x))


def weighted_mean(x: Column | str, w: Column | str, na_rm: bool = False) -> Column:
    """Missing with a missing value or weight; ``na_rm`` leaves out rows by their value only. NaN where weights add up to 0."""
    x, w = col(x), col(w)
    known = not_nan(x).isNotNull() if na_rm else F.lit(True)
    both = F.when(known, (w != 0).cast("double") * x * w)
    bad = F.count_if(known & (x.isNull() | w.isNull()))
    return F.when(bad == 0, divide(F.coalesce(F.sum(both), F.lit(0.0)), F.coalesce(F.sum(F.when(known, w)), F.lit(0.0))))


def first(x: Column | str, order: Sequence[Column | str]) -> Column:
    """By order, missing values included."""
    return F.min_by(F.struct(col(x).alias("v")), F.struct(*map(col, order)))["v"]


def last(x: Column | str, order: Sequence[Column | str]) -> Column:
    return F.max_by(F.struct(col(x).alias("v")), F.struct(*map(col, order)))["v"]


def unique_n(*xs: Column | str, na_rm: bool = False) -> Column:
    """Distinct values or combinations; missing counts as a value unless ``na_rm``."""
    cols = [col(x) for x in xs]
    if na_rm:
        return F.count_distinct(*cols)
    return F.count_distinct(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)]))


#: Native forms by name; anything else goes through ``apply_groups``.
NATIVE: dict[str, Callable[..., Column]] = {f.__name__: f for f in (total, mean, least, greatest, median, var, sd, prod, weighted_mean, first, last, unique_n)}


def summarise(df: DataFrame, by: Sequence[str | Column], aggs: dict[str, Column], keyed: bool = False, order: Sequence[Column | str] | None = None) -> DataFrame:
    """Group and aggregate. ``keyed`` sorts by the keys, missing first; ``order`` sorts groups by first appearance."""
    keys = [F.col(b) if isinstance(b, str) else b for b in by]
    if nested := [n for n, t in df.select(*keys).dtypes if t.startswith(("array", "map", "struct"))]:
        raise TypeError(f"can't group by {nested[0]}: it holds several values a row")
    named = [c.alias(n) for n, c in aggs.items()]
    if order is not None:
        named.append(F.min(F.struct(*map(col, order))).alias("__first"))
    out = df.groupBy(*keys).agg(*named)
    if keyed:
        names = out.columns[: len(keys)]
        return out.orderBy(*[k for n in names for k in sort_key(n)])
    return out.orderBy("__first").drop("__first") if order is not None else out


def apply_groups(df: DataFrame, by: Sequence[str], f: Callable, schema: str) -> DataFrame:
    """Any function of a group's pandas frame; a group must fit one task's memory."""
    return df.groupBy(*by).applyInPandas(f, schema)


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 6, tail: bool = False) -> DataFrame:
    """First n rows of each group; cut on the map side before the shuffle. ``tail`` needs reversed ``order``."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__rn", rank).where(F.col("__rn") <= n).drop("__rn")


def nth(x: str, n: int, by: Sequence[str], order: Sequence[Column], df: DataFrame) -> DataFrame:
    """The n-th value of each group, missing where the group is shorter."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__rn", rank).groupBy(*by).agg(F.max(F.when(F.col("__rn") == n, F.col(x))).alias(x))


def unique_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by order (reverse the order for the last)."""
    return top_n(df, by, order, 1)


def duplicated(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "duplicated") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) > 1)


def first_duplicate(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str = "position") -> DataFrame:
    """One row: the position of the first row whose ``by`` columns came before (0 if none), in a total order."""
    numbered = number_rows(df, order, "__place")
    again = duplicated(numbered, by, [F.col("__place")], "__again").where("__again")
    return again.agg(F.coalesce(F.min("__place"), F.lit(0)).cast("long").alias(name))


def each(columns: Sequence[str], f: Callable[[Column], Column], name: Callable[[str], str] = str) -> dict[str, Column]:
    """The same function of several columns, named after them."""
    return {name(c): f(F.col(c)) for c in columns}


def grouping_sets(df: DataFrame, by: Sequence[str], sets: Sequence[Sequence[str]], aggs: dict[str, Column], ident: str | None = "grouping", labels: dict[str, object] | None = None) -> DataFrame:
    """One aggregate over several sets of keys, in one pass; repeated sets give repeated rows.

    ``ident`` holds a bit for each key, the first the highest, set where the key is aggregated away; ``labels``
    replaces those keys' missing values.
    """
    if bad := [c for s in sets for c in s if c not in by]:
        raise ValueError(f"sets name columns outside by: {bad}")
    labels = labels or {}
    level = [F.grouping_id(*by).cast("long").alias(ident)] if ident else []
    mid = [F.grouping(k).alias(f"__g_{k}") for k in labels]
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(b) for b in by]).agg(*level, *mid, *[c.alias(n) for n, c in aggs.items()])
    keys = [F.when(F.col(f"__g_{k}") == 1, lit(labels[k])).otherwise(F.col(k)).alias(k) if k in labels else F.col(k) for k in by]
    return out.select(*keys, *[F.col(c) for c in out.columns if c not in by and not c.startswith("__g_")])


def rollup(df: DataFrame, by: Sequence[str], aggs: dict[str, Column], **kw) -> DataFrame:
    return grouping_sets(df, by, [by[:n] for n in range(len(by), -1, -1)], aggs, **kw)


def cube(df: DataFrame, by: Sequence[str], aggs: dict[str, Column], **kw) -> DataFrame:
    return grouping_sets(df, by, [s for n in range(len(by), -1, -1) for s in combinations(by, n)], aggs, **kw)
