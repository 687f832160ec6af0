"""Set operations on whole rows (missing equals missing), stacking and side-by-side binding."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slate.operators.rows import number_rows


def _check(a: DataFrame, b: DataFrame) -> None:
    if a.columns != b.columns:
        raise ValueError("both tables need the same columns in the same order")


def union(a: DataFrame, b: DataFrame, every: bool = False) -> DataFrame:
    _check(a, b)
    return a.union(b) if every else a.union(b).distinct()


def intersect(a: DataFrame, b: DataFrame, every: bool = False) -> DataFrame:
    _check(a, b)
    return a.intersectAll(b) if every else a.intersect(b)


def setdiff(a: DataFrame, b: DataFrame, every: bool = False) -> DataFrame:
    _check(a, b)
    return a.exceptAll(b) if every else a.subtract(b)


def equal(a: DataFrame, b: DataFrame) -> bool:
    """The same rows, each as often: one grouped pass over both."""
    _check(a, b)
    tagged = a.withColumn("__n", F.lit(1)).union(b.withColumn("__n", F.lit(-1)))
    return tagged.groupBy(*a.columns).agg(F.sum("__n").alias("n")).where("n <> 0").isEmpty()


def all_equal(a: DataFrame, b: DataFrame, order: Sequence[Column | str] = (), tolerance: float = 1.5e-8, ignore_col_order: bool = False) -> str | None:
    """None if two tables are alike, else what differs first: names, types, row counts or values.

    Floating columns may differ by ``tolerance``, relative to the second table's value. Rows meet in ``order``, or
    without it in the order of all columns, floating ones last, so that row order doesn't matter.
    """
    names = a.columns
    if (sorted(names) != sorted(b.columns)) if ignore_col_order else (names != b.columns):
        return f"columns {names} and {b.columns}"
    types, others = dict(a.dtypes), dict(b.dtypes)
    for n in names:
        if types[n] != others[n]:
            return f"type of {n}: {types[n]} and {others[n]}"
    sizes = a.count(), b.count()
    if sizes[0] != sizes[1]:
        return f"{sizes[0]} and {sizes[1]} rows"
    floats = [n for n in names if types[n] in ("float", "double")]
    by = list(order) or sorted((n for n in names if n not in floats), key=names.index) + floats
    left, right = (number_rows(t.select(*names), by, "__place") for t in (a, b))
    pairs = left.join(right.withColumnsRenamed({n: f"__b_{n}" for n in names}), "__place")
    for n in names:
        x, y = F.col(n), F.col(f"__b_{n}")
        same = x.eqNullSafe(y)
        if n in floats:
            same = same | F.coalesce(F.abs(x - y) <= F.lit(tolerance) * F.greatest(F.abs(y), F.lit(tolerance)), F.lit(False))
        worst = pairs.where(~same).agg(F.min("__place").alias("at")).first()["at"]
        if worst is not None:
            return f"values of {n} from row {worst} on"
    return None


def bind_rows(tables: Sequence[DataFrame] | dict[str, DataFrame], use_names: bool = True, fill: bool = False, idcol: str | None = None) -> DataFrame:
    """Stack tables by name (``fill`` adds missing columns) or by position; ``idcol`` says which table a row is from."""
    named = list(tables.items()) if isinstance(tables, dict) else list(enumerate(tables, 1))
    parts = [t.select(F.lit(k).alias(idcol), "*") if idcol else t for k, t in named]
    if use_names or fill:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=fill), parts)
    return reduce(DataFrame.union, parts)


def bind_columns(a: DataFrame, b: DataFrame, order_a: Sequence[Column | str], order_b: Sequence[Column | str]) -> DataFrame:
    """Side by side, by position in each table's order; runs at once. Tables of different length are an error."""
    sizes = a.count(), b.count()
    if sizes[0] != sizes[1]:
        raise ValueError(f"tables of {sizes[0]} and {sizes[1]} rows can't stand side by side")
    return number_rows(a, order_a, "__rn").join(number_rows(b, order_b, "__rn"), "__rn").drop("__rn")


def split(df: DataFrame, by: str | Sequence[str], values: Sequence | None = None, most: int = 1000, keep_by: bool = True, flatten: bool = True) -> dict[object, DataFrame]:
    """A lazy table for each value; values are looked up (at most ``most``) unless given, and sorted, missing first.

    Several columns make a table for each combination, under a tuple, or with ``flatten=False`` dictionaries within dictionaries.
    """
    if not isinstance(by, str):
        if values is None:
            found = df.select(*by).distinct().limit(most + 1).collect()
            if len(found) > most:
                raise ValueError(f"more than {most} combinations")
            values = sorted((tuple(r) for r in found), key=lambda t: [(v is not None, v) for v in t])
        out: dict[object, object] = {}
        for v in values:
            part = df.where(reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(x)) for c, x in zip(by, v, strict=True)]))
            part, at = part if keep_by else part.drop(*by), out
            for x in v[:-1] if not flatten else ():
                at = at.setdefault(x, {})
            at[v if flatten else v[-1]] = part
        return out
    if values is None:
        found = df.select(by).distinct().limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"{by} has more than {most} values")
        values = sorted((r[0] for r in found), key=lambda v: (v is not None, v))
    parts = {v: df.where(F.col(by).eqNullSafe(F.lit(v))) for v in values}
    return parts if keep_by else {v: p.drop(by) for v, p in parts.items()}
