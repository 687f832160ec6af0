"""Ordered functions: shift, ranks, run ids, fills and rolling windows. Every one takes its order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from slate.functions.scalar import col, lit, not_nan, sort_key
from slate.operators.spread import carry_last


def window(by: Sequence[str | Column], order: Sequence[str | Column]) -> WindowSpec:
    """Rows of each group in ascending order. ``back`` of the result is the same window from its end."""
    w = Window.partitionBy(*by).orderBy(*order)
    w.back = Window.partitionBy(*by).orderBy(*[F.desc(o) if isinstance(o, str) else o.desc() for o in order])
    return w


def shift(x: Column | str, n: int, w: WindowSpec, kind: str = "lag", fill=None) -> Column:
    """Lag, lead or cyclic shift; a negative n turns the direction."""
    x = col(x)
    if kind == "lead":
        kind, n = "lag", -n
    if kind in ("lag", "shift"):
        out = F.lag(x, n) if n >= 0 else F.lead(x, -n)
        inside = (F.lag(F.lit(1), n) if n >= 0 else F.lead(F.lit(1), -n)).over(w)
        return out.over(w) if fill is None else F.when(inside.isNull(), lit(fill)).otherwise(out.over(w))
    raise ValueError("use cyclic() for cyclic shifts")


def cyclic(df: DataFrame, x: str, n: int, by: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """The value n rows before, beyond the first row from the end: by a join on row numbers, not a collected list."""
    w = window(by, order)
    rows = df.withColumn("__rn", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    source = rows.select(*[F.col(b).alias(f"__{b}") for b in by], (F.pmod(F.col("__rn") - 1 + n, F.col("__n")) + 1).alias("__to"), F.col(x).alias(name))
    on = [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by] + [F.col("__rn") == F.col("__to")]
    return rows.join(source, on).drop("__rn", "__n", "__to", *[f"__{b}" for b in by])


def shift_columns(columns: Sequence[str], ns: Sequence[int], w: WindowSpec, kind: str = "lag", fill=None) -> dict[str, Column]:
    """Every column shifted by every n, under names like ``x_lag_1``."""
    return {f"{c}_{kind}_{n}": shift(c, n, w, kind, fill) for c in columns for n in ns}


def froll_columns(f: str, columns: Sequence[str], ns: Sequence[int], w: WindowSpec, **kw) -> dict[str, Column]:
    """Every column rolled over every n, under names like ``x_rollmean3``."""
    return {f"{c}_roll{f}{n}": froll(f, c, n, w, **kw) for c in columns for n in ns}


def frank_missing(x: str, by: Sequence[str], na_last: bool | str = True, descending: bool = False, ties: str = "average", tie_order: Sequence[Column] = ()) -> Column:
    """Rank by one column; missing values rank last (True), first (False), not at all (``keep``)."""
    rank = frank(sort_key(x, descending, na_last is not False), by, ties, tie_order)
    return F.when(F.col(x).isNotNull(), rank) if na_last == "keep" else rank


def frank(order: Sequence[Column], by: Sequence[str], ties: str = "average", tie_order: Sequence[Column] = (), seed: int = 1) -> Column:
    """Rank within groups. ``first`` and ``last`` need a total ``tie_order``; ``random`` breaks ties by seeded chance."""
    w = Window.partitionBy(*by).orderBy(*order)
    low = F.rank().over(w)
    high = F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, 0))
    number = F.row_number().over(Window.partitionBy(*by).orderBy(*order, *(tie_order or [F.rand(seed)])))
    return {
        "min": lambda: low,
        "max": lambda: high,
        "average": lambda: (low + high) / F.lit(2.0),
        "dense": lambda: F.dense_rank().over(w),
        "first": lambda: number,
        "last": lambda: low + high - number,
        "random": lambda: F.row_number().over(Window.partitionBy(*by).orderBy(*order, F.rand(seed))),
    }[ties]()


def rowid(by: Sequence[str], order: Sequence[Column | str], prefix: str | None = None) -> Column:
    """Number of the row in its group, as text after ``prefix`` if that is given."""
    number = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return number if prefix is None else F.concat(F.lit(prefix), number.cast("string"))


def rleid(columns: Sequence[str], w: WindowSpec) -> Column:
    """Number of the run of equal values; missing equals missing."""
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    start = F.lag(F.lit(1)).over(w).isNull()
    # Two window passes over one sorting: the inner flag, then its running sum.
    return F.when(start | changed, 1).otherwise(0)


def with_rleid(df: DataFrame, columns: Sequence[str], by: Sequence[str], order: Sequence[str | Column], name: str = "rleid", prefix: str | None = None) -> DataFrame:
    """``df`` with the number of each row's run of equal values, as text after ``prefix`` if that is given."""
    w = Window.partitionBy(*by).orderBy(*order)
    flagged = df.withColumn("__new", rleid(columns, w))
    number = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return flagged.withColumn(name, number if prefix is None else F.concat(F.lit(prefix), number.cast("string"))).drop("__new")


def nafill(x: Column | str, w: WindowSpec, kind: str = "locf", fill=None, limit: int | None = None, nan_missing: bool = False) -> Column:
    """Fill missing values from the row before (locf), the row after (nocb) or with a constant, ``limit`` rows at most."""
    raw = col(x)
    x = F.when(~F.isnan(raw), raw) if nan_missing else raw
    if kind == "const" and limit is None:
        return F.coalesce(x, lit(fill))
    if kind == "const":
        # Filled are the first rows of a gap: with a known value, or the first row, at most ``limit`` rows before.
        known = F.count(x).over(w.rowsBetween(-limit, -1)) > 0 if limit > 0 else F.lit(False)
        opening = (F.count(x).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 0) & (F.row_number().over(w) <= limit)
        return F.when(x.isNull() & (known | opening), lit(fill)).otherwise(x)
    if kind == "nocb":  # from the end, so that no frame reaches from a row to the last one
        w = w.back
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(x, ignorenulls=True).over(before if limit is None else w.rowsBetween(-limit, 0))
    if fill is None:
        return found
    # A gap at the open end has no value to carry: its first rows (nocb: last rows) take ``fill``, ``limit`` of them at most.
    opening = F.count(x).over(before) == 0
    if limit is not None:
        opening &= F.count(F.lit(1)).over(before) <= limit
    return F.when(opening, lit(fill)).otherwise(found)


def nafill_spread(df: DataFrame, x: str, by: Sequence[str], order: Sequence[str], name: str, kind: str = "locf", fill=None, nan_missing: bool = False) -> DataFrame:
    """``df`` with missing values of x filled from the row before (locf) or after (nocb), however large one group is.

    Runs at once: groups are cut into sorted ranges, and what a range ends with goes on to the next one.
    """
    value = not_nan(F.col(x)) if nan_missing else F.col(x)
    out = carry_last(df, by, [F.asc(o) if kind == "locf" else F.desc(o) for o in order], value, name)
    return out if fill is None else out.withColumn(name, F.coalesce(name, lit(fill)))


_IDENTITY = {"mean": float("nan"), "sum": 0.0, "max": float("-inf"), "min": float("inf"), "prod": 1.0, "median": None, "var": None, "sd": None}
_ROLL: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
    "prod": F.product,
    "median": lambda x: F.percentile(x, F.lit(0.5)),
    "var": F.var_samp,
    "sd": F.stddev_samp,
}


def froll(f: str, x: Column | str, n: int, w: WindowSpec, align: str = "right", fill=None, na_rm: bool = False, partial: bool = False) -> Column:
    """Rolling aggregate over n rows. Incomplete windows give ``fill``, or are used with ``partial``."""
    x = col(x).cast("double")
    x = not_nan(x) if na_rm else x
    if n == 0:
        return F.lit(_IDENTITY[f]).cast("double")
    back = {"right": n - 1, "left": 0, "center": n - 1 - n // 2}[align]
    frame = w.rowsBetween(-back, n - 1 - back)
    rows, known = F.count(F.lit(1)).over(frame), F.count(x).over(frame)
    value = _ROLL[f](x).over(frame)
    if na_rm:
        value = value if _IDENTITY[f] is None else F.coalesce(value, F.lit(_IDENTITY[f]))
    else:
        value = F.when(known == rows, F.when(F.max(F.isnan(x)).over(frame), F.lit(float("nan"))).otherwise(value))
    return value if partial else F.when(rows == n, value).otherwise(lit(fill).cast("double"))


def _fold_moments(p: Column) -> Column:
    """(count, mean, sum of squared deviations) of an array, in one stable pass."""

    def step(acc: Column, v: Column) -> Column:
        k, d = acc["k"] + 1.0, v - acc["m"]
        m = acc["m"] + d / k
        return F.struct(k.alias("k"), m.alias("m"), (acc["s"] + d * (v - m)).alias("s"))

    return F.aggregate(p, F.struct(F.lit(0.0).alias("k"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s")), step)


def _fold_var(p: Column) -> Column:
    return F.aggregate(F.array(_fold_moments(p)), F.lit(None).cast("double"), lambda _, a: F.when(a["k"] > 1, a["s"] / (a["k"] - 1)))


def _fold_median(p: Column) -> Column:
    ordered, k = F.array_sort(p), F.size(p)
    return (F.get(ordered, F.floor((k - 1) / 2).cast("int")) + F.get(ordered, F.floor(k / 2).cast("int"))) / 2


_FOLDS: dict[str, Callable[[Column], Column]] = {
    "sum": lambda p: F.aggregate(p, F.lit(0.0), lambda a, b: a + b),
    "mean": lambda p: F.aggregate(p, F.lit(0.0), lambda a, b: a + b) / F.nullif(F.size(p), F.lit(0)),
    "prod": lambda p: F.aggregate(p, F.lit(1.0), lambda a, b: a * b),
    "max": F.array_max,
    "min": F.array_min,
    "median": _fold_median,
    "var": _fold_var,
    "sd": lambda p: F.sqrt(_fold_var(p)),
}


#: Longest adaptive windows that are gathered to be summed; longer ones are differences of running sums.
GATHERED = 64


def froll_adaptive(df: DataFrame, f: str, x: str, n: str, by: Sequence[str], order: Sequence[str | Column], name: str, most: int, align: str = "right", fill=None, na_rm: bool = False, partial: bool = False) -> DataFrame:
    """A window length for each row (at most ``most``): the frame of ``most`` rows is gathered and its end is folded.

    Sums and means over more than ``GATHERED`` rows are differences of running sums instead, in a total order. Incomplete
    windows give ``fill``, or are used with ``partial``; windows with missing values give missing, unless
    ``na_rm`` leaves those out. A missing length, or one above ``most`` or below 0, gives missing.
    """
    if align not in ("right", "left"):
        raise ValueError("adaptive windows are aligned right or left")
    size = F.col(n).cast("int")
    if f in ("sum", "mean") and most > GATHERED:
        rows, value, whole = _by_running_sums(df, f, x, size, by, order, align, na_rm)
    else:
        rows, value, whole = _by_gathering(df, f, x, size, by, order, most, align, na_rm)
    out = value if partial else F.when(whole, value).otherwise(lit(fill).cast("double"))
    helpers = [c for c in rows.columns if c not in df.columns]
    return rows.withColumn("__out", F.when(size.between(0, most), out)).drop(*helpers).withColumn(name, F.col("__out")).drop("__out")


def _by_gathering(df: DataFrame, f: str, x: str, size: Column, by: Sequence[str], order: Sequence[str | Column], most: int, align: str, na_rm: bool) -> tuple[DataFrame, Column, Column]:
    w = Window.partitionBy(*by).orderBy(*order)
    frame = w.rowsBetween(-(most - 1), 0) if align == "right" else w.rowsBetween(0, most - 1)
    number = F.col(x).cast("double")
    gathered = F.collect_list(F.struct((not_nan(number) if na_rm else number).alias("v"))).over(frame)
    taken = F.least(F.greatest(size, F.lit(0)), F.size("__w"))
    start = F.size("__w") - taken + 1 if align == "right" else F.lit(1)
    cut = F.transform(F.slice("__w", start, taken), lambda e: e["v"])
    rows = df.withColumn("__w", gathered).withColumn("__p", cut)
    known = F.filter("__p", lambda v: v.isNotNull())
    value = _FOLDS[f](known)
    if _IDENTITY[f] is not None:
        value = F.coalesce(value, F.lit(_IDENTITY[f]))
    if not na_rm:
        value = F.when(F.exists("__p", F.isnan), F.lit(float("nan"))).otherwise(value)
        value = F.when(~F.exists("__p", lambda v: v.isNull()), value)
    return rows, value, F.size("__w") >= size


def _by_running_sums(df: DataFrame, f: str, x: str, size: Column, by: Sequence[str], order: Sequence[str | Column], align: str, na_rm: bool) -> tuple[DataFrame, Column, Column]:
    """Each row beside the running sums at its window's other end, met by row number; NaN and infinities are counted apart."""
    w, whole = Window.partitionBy(*by).orderBy(*order), Window.partitionBy(*by)
    v = F.col(x).cast("double")
    v = not_nan(v) if na_rm else v
    inf = float("inf")
    parts = {"s": F.when(F.isnan(v) | (F.abs(v) == inf), 0.0).otherwise(F.coalesce(v, F.lit(0.0))), "k": v.isNotNull().cast("long"), "nan": F.coalesce(F.isnan(v), F.lit(False)).cast("long"), "up": F.coalesce(v == inf, F.lit(False)).cast("long"), "down": F.coalesce(v == -inf, F.lit(False)).cast("long")}
    here = F.struct(*[c.alias(k) for k, c in parts.items()])
    sums = F.struct(*[F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(k) for k, c in parts.items()])
    rows = df.withColumns({"__rn": F.row_number().over(w), "__rows": F.count(F.lit(1)).over(whole), "__v": here, "__sums": sums})
    left = F.col("__rows") - F.col("__rn") + 1 if align == "left" else F.col("__rn")
    rows = rows.withColumn("__taken", F.least(F.greatest(size, F.lit(0)), left))
    rows = rows.withColumn("__to", F.col("__rn") + F.col("__taken") - 1 if align == "left" else F.col("__rn") - F.col("__taken"))
    ends = rows.select(*[F.col(f"`{c}`").alias(f"__b{k}") for k, c in enumerate(by)], F.col("__rn").alias("__end"), F.col("__sums").alias("__other"))
    test = F.col("__to") == F.col("__end")
    for k, c in enumerate(by):
        test = test & F.col(f"`{c}`").eqNullSafe(F.col(f"__b{k}"))
    met = rows.join(ends, test, "left")

    def over(k: str) -> Column:
        other = F.coalesce(F.col("__other")[k], F.lit(0))
        within = F.col("__sums")[k] - other if align == "right" else other - F.col("__sums")[k] + F.col("__v")[k]
        return F.when(F.col("__taken") > 0, within).otherwise(0)

    total = F.when((over("nan") > 0) | ((over("up") > 0) & (over("down") > 0)), F.lit(float("nan"))).when(over("up") > 0, inf).when(over("down") > 0, -inf).otherwise(over("s").cast("double"))
    value = total if f == "sum" else F.when(over("k") == 0, F.lit(float("nan"))).otherwise(total / F.when(over("k") > 0, over("k")))
    if not na_rm:
        value = F.when(over("k") == F.col("__taken"), value)
    return met, value, left >= size


def frolladapt(index: Column | str, n: int, by: Sequence[str | Column], partial: bool = False) -> Column:
    """How many rows lie within the last n units of an increasing index; n where those reach before the first row, unless ``partial``."""
    w = Window.partitionBy(*by).orderBy(index)
    rows = F.count(F.lit(1)).over(w.rangeBetween(-(n - 1), 0))
    early = col(index) < F.first(col(index)).over(w.rowsBetween(Window.unboundedPreceding, 0)) + (n - 1)
    return rows if partial else F.when(early, F.lit(n).cast("long")).otherwise(rows)


def frollapply(df: DataFrame, f: Callable, x: Sequence[str], n: int | str, by: Sequence[str], order: Sequence[str], name: str, align: str = "right", fill: float | None = None, partial: bool = False) -> DataFrame:
    """Any function of the window of some columns (a 2-d array); a group must fit one task's memory.

    ``n`` is a number of rows, or a column of them. Incomplete windows give ``fill``, or are used with ``partial``.
    """
    columns = df.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{name}` double"

    def run(pdf):
        pdf = pdf.sort_values(list(order), kind="stable")
        values = pdf[list(x)].to_numpy()
        out = []
        for i, size in enumerate(pdf[n] if isinstance(n, str) else [n] * len(pdf)):
            if size != size or size is None:
                out.append(None)
                continue
            size = int(size)
            low = i - {"right": size - 1, "left": 0, "center": size - 1 - size // 2}[align]
            whole = low >= 0 and low + size <= len(pdf)
            out.append(float(f(values[max(low, 0) : low + size])) if whole or partial else fill)
        pdf[name] = out
        return pdf[[*columns, name]]

    return df.groupBy(*by).applyInPandas(run, schema)
