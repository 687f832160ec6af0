"""Joins of an ordered table x with a table i: equal, unequal, rolling, overlapping, and merges of many tables.

Missing equals missing in every equal condition. Rows of i are kept unless ``nomatch`` is None (inner); join columns
carry i's values. Physical strategies are Catalyst's: nothing is broadcast by hand.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slate.operators.rows import number_rows
from slate.operators.spread import carry_last, carry_least

OPS = {"==": "==", "=": "==", "<=": "<=", "<": "<", ">=": ">=", ">": ">"}


@dataclass(frozen=True)
class On:
    """x column, operator, i column."""

    x: str
    op: str
    i: str

    def test(self) -> Column:
        a, b = F.col(f"x.`{self.x}`"), F.col(f"i.`{self.i}`")
        return {"==": a.eqNullSafe(b), "<=": a <= b, "<": a < b, ">=": a >= b, ">": a > b}[self.op]


def parse_on(on: Sequence[str] | dict[str, str], x: DataFrame, i: DataFrame) -> list[On]:
    """``["a", "b==c", "d>=e"]`` or {"x column": "i column"}; checks that the columns are there."""
    items = [f"`{a}`==`{b}`" for a, b in on.items()] if isinstance(on, dict) else list(on)
    out = []
    for item in items:
        m = re.fullmatch(r"\s*(`[^`]+`|[^`<>=!\s]+)\s*(?:(<=|>=|==|=|<|>)\s*(`[^`]+`|[^`<>=!\s]+))?\s*", item)
        if not m:
            raise ValueError(f"can't read join condition {item!r}")
        a, op, b = m[1].strip("`"), OPS[m[2] or "=="], (m[3] or m[1]).strip("`")
        if a not in x.columns or b not in i.columns:
            raise ValueError(f"join condition {item!r} names a column that isn't there")
        out.append(On(a, op, b))
    return out


def natural(x: DataFrame, i: DataFrame) -> list[str]:
    return [c for c in x.columns if c in i.columns]


def _types(x: DataFrame, i: DataFrame, on: list[On]) -> None:
    numbers = re.compile("tinyint|smallint|int|bigint|float|double|decimal.*")
    for o in on:
        a, b = dict(x.dtypes)[o.x], dict(i.dtypes)[o.i]
        if a != b and not (numbers.fullmatch(a) and numbers.fullmatch(b)):
            raise TypeError(f"can't join {o.x} ({a}) with {o.i} ({b})")
        if o.op != "==" and "string" in (a, b):
            raise TypeError(f"{o.x}: strings join by equality only")


def _project(joined: DataFrame, x: DataFrame, i: DataFrame, on: list[On]) -> DataFrame:
    """x's columns, the join columns with i's values, then i's others (``i.`` before a name that clashes)."""
    given = {o.x: o.i for o in on}
    left = [F.col(f"i.`{given[c]}`").alias(c) if c in given else F.col(f"x.`{c}`").alias(c) for c in x.columns]
    used = {o.i for o in on}
    right = [F.col(f"i.`{c}`").alias(f"i.{c}" if c in x.columns else c) for c in i.columns if c not in used]
    return joined.select(*left, *right)


def _repeat(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as its column ``times`` says, which goes; no row is held more than 100,000 times at once."""
    block = 100_000
    blocks = F.explode(F.sequence(F.lit(0), F.floor((F.col(times) - 1) / block)))
    inside = F.explode(F.sequence(F.lit(1), F.least(F.lit(block), F.col(times) - F.col("__block") * block).cast("int")))
    return df.withColumn("__block", blocks).withColumn("__copy", inside).drop("__block", "__copy", times)


def _counted(df: DataFrame) -> DataFrame:
    """The distinct rows with their number in ``__times``: what a row matches follows from its content, so no row ids are needed."""
    return df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("__times"))


def _tests(conditions: Sequence[On]) -> Column:
    return reduce(lambda p, q: p & q, [o.test() for o in conditions])


def _guard(x: DataFrame, i: DataFrame, conditions: Sequence[On], cartesian: bool, many: bool) -> None:
    """Count beforehand, by keys where all conditions are equal, what a join would give."""
    if cartesian and many:
        return
    left, right = (t.groupBy(*[F.col(f"`{getattr(o, side)}`").alias(getattr(o, side)) for o in conditions]).agg(F.count("*").alias("__n")) for t, side in ((x, "x"), (i, "i")))
    both = left.alias("x").join(right.alias("i"), _tests(conditions))
    row = both.agg(F.sum(F.col("x.__n") * F.col("i.__n")).alias("rows"), F.max(F.least("x.__n", "i.__n")).alias("least"), F.max("i.__n").alias("dups")).first()
    if not many and all(o.op == "==" for o in conditions) and (row["least"] or 0) > 1:
        raise ValueError("a key repeats in both tables; allow it by many=True")
    if not cartesian and (row["dups"] or 0) > 1 and row["rows"] > (total := x.count() + i.count()):
        raise ValueError(f"the join gives {row['rows']} rows, more than both tables have ({total}); allow it by cartesian=True")


def join(x: DataFrame, i: DataFrame, on: Sequence[str] | dict[str, str], nomatch: str | None = "NA", mult: str = "all", order: Sequence[str | Column] = (), cartesian: bool = True, many: bool = True, spread: bool | None = None) -> DataFrame:
    """Rows of i with their matches in x. ``mult`` takes the first or last match by ``order``, or all; ``error`` raises if a row of i has several.

    ``cartesian=False`` raises if i repeats keys and the result is longer than both tables, ``many=False`` if a key repeats
    in both; these two count at once. The first or last match by one unequal condition comes from a running window over both tables,
    not from pairs; ``spread`` (always without equal columns) cuts its groups into sorted ranges, at once. More than one
    unequal condition, or an order that looks at i, makes the pairs.
    """
    conditions = parse_on(on, x, i)
    _types(x, i, conditions)
    _guard(x, i, conditions, cartesian, many)
    if mult in ("first", "last") and not order:
        raise ValueError(f"mult={mult!r} needs an order")
    how = "left" if nomatch is not None else "inner"
    columns, equal = x.columns, [o.x for o in conditions if o.op == "=="]
    if mult in ("first", "last") and len(equal) == len(conditions):
        by = _turn(order) if mult == "last" else order
        x = x.withColumn("__rn", F.row_number().over(Window.partitionBy(*[F.col(f"`{c}`") for c in equal]).orderBy(*by))).where("__rn = 1").drop("__rn")
        mult = "all"
    if mult == "all":
        return _project(i.alias("i").join(x.alias("x"), _tests(conditions), how), x.select(*[F.col(f"`{c}`") for c in columns]), i, conditions)
    if mult in ("first", "last") and len(equal) + 1 == len(conditions) and _within(x, order):
        sided = _best_along(x, i, conditions, order, mult == "last", spread or (spread is None and not equal))
        return _project(sided if nomatch is not None else sided.where(F.col("x").isNotNull()), x, i, conditions)
    single = _counted(i)
    row = F.struct(*[F.col(f"x.`{c}`").alias(c) for c in columns])
    joined = single.alias("i").join(x.withColumn("__hit", F.lit(1)).alias("x"), _tests(conditions), how)
    grouped = joined.groupBy(*[F.col(f"i.`{c}`").alias(f"__i_{c}") for c in single.columns])
    if mult == "error":
        hits, found = F.count("x.__hit"), F.first(row)
        found = F.when(hits > 1, F.raise_error(F.lit("several rows of x match")).cast(joined.select(row.alias("r")).schema["r"].dataType)).otherwise(found)
    else:
        by = F.struct(*[F.col(f"x.`{o}`") if isinstance(o, str) else o for o in order])
        found = (F.min_by if mult == "first" else F.max_by)(row, F.when(F.col("x.__hit") == 1, by))
    picked = _repeat(grouped.agg(found.alias("__x")), "__i___times")
    sided = picked.select(F.struct(*[F.col(f"`__i_{c}`").alias(c) for c in i.columns]).alias("i"), F.col("__x").alias("x"))
    return _project(sided, x.select(*[F.col(f"`{c}`") for c in columns]), i, conditions)


def _within(x: DataFrame, order: Sequence[str | Column]) -> bool:
    """Whether ``order`` needs x's columns only."""
    try:
        x.alias("x").select(*[F.lit(0) if isinstance(o, str) else o for o in order])
    except AnalysisException:
        return False
    return True


def _best_along(x: DataFrame, i: DataFrame, conditions: Sequence[On], order: Sequence[str | Column], last: bool, spread: bool) -> DataFrame:
    """Structs ``i`` of all rows of i and ``x`` of the first or last by ``order`` that each matches; one condition is unequal.

    x and i are stacked along the unequal condition, from the end at which x matches most: the rows of x before a row of i in its
    group are its matches, and a running minimum or maximum of the order finds one of them without making pairs.
    """
    (along,), equal = [o for o in conditions if o.op != "=="], [o for o in conditions if o.op == "=="]
    keys = [f"__k{k}" for k in range(len(equal))]
    by = F.struct(*[(F.col(f"x.`{o}`") if isinstance(o, str) else o).alias(f"o{k}") for k, o in enumerate(order)])
    row = F.struct(*[F.col(f"x.`{c}`").alias(c) for c in x.columns])
    right = x.alias("x").select(*[F.col(f"x.`{o.x}`").alias(k) for k, o in zip(keys, equal, strict=True)], F.col(f"x.`{along.x}`").alias("__at"), F.lit(0).alias("__side"), F.struct(by.alias("by"), row.alias("row")).alias("__x"))
    left = i.alias("i").select(*[F.col(f"i.`{o.i}`").alias(k) for k, o in zip(keys, equal, strict=True)], F.col(f"i.`{along.i}`").alias("__at"), F.lit(1).alias("__side"), F.struct(*[F.col(f"i.`{c}`").alias(c) for c in i.columns]).alias("__i"))
    both = right.where(F.col("__at").isNotNull()).unionByName(left, allowMissingColumns=True)
    # Rows of x at the same place are matches unless the condition is strict: then they come after those of i.
    place = [F.desc("__at") if along.op in (">", ">=") else F.asc("__at"), F.desc("__side") if along.op in ("<", ">") else F.asc("__side")]
    if spread:
        both = carry_least(both, keys, place, F.col("__x"), "__best", last)
    else:
        w = Window.partitionBy(*keys).orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn("__best", (F.max_by if last else F.min_by)("__x", F.col("__x.by")).over(w))
    return both.where("__side = 1").select(F.col("__i").alias("i"), F.when(F.col("__at").isNotNull(), F.col("__best.row")).alias("x"))


def matches(x: DataFrame, i: DataFrame, on: Sequence[str] | dict[str, str], order: Sequence[str | Column], name: str = "which") -> DataFrame:
    """Row numbers (from 1, in x's ``order``) of the rows of x that rows of i match, null for a row without a match."""
    return join(number_rows(x, order, name), i, on).select(name)


def unmatched(x: DataFrame, i: DataFrame, on: Sequence[str] | dict[str, str], order: Sequence[str | Column], name: str = "which") -> DataFrame:
    """Row numbers (from 1, in i's ``order``) of the rows of i that match nothing in x."""
    conditions = parse_on(on, x, i)
    return number_rows(i, order, name).alias("i").join(x.alias("x"), _tests(conditions), "left_anti").select(name)


def _turn(order: Sequence[str | Column], prefix: str = "") -> list[Column]:
    return [F.desc(prefix + o) if isinstance(o, str) else o.desc() for o in order]


def anti(x: DataFrame, i: DataFrame, on: Sequence[str] | dict[str, str]) -> DataFrame:
    """Rows of x without a match in i."""
    return x.alias("x").join(i.alias("i"), reduce(lambda p, q: p & q, [o.test() for o in parse_on(on, x, i)]), "left_anti")


def semi(x: DataFrame, i: DataFrame, on: Sequence[str] | dict[str, str]) -> DataFrame:
    return x.alias("x").join(i.alias("i"), reduce(lambda p, q: p & q, [o.test() for o in parse_on(on, x, i)]), "left_semi")


def each_i(x: DataFrame, i: DataFrame, on: Sequence[str] | dict[str, str], aggs: dict[str, Column], count: str | None = "N") -> DataFrame:
    """Aggregate x's matches for each row of i; repeated rows of i stay apart, those without a match have count 0.

    In ``aggs`` columns are named ``x.a`` and ``i.b``.
    """
    conditions = parse_on(on, x, i)
    single = _counted(i)
    marked = x.withColumn("__hit", F.lit(1))
    joined = single.alias("i").join(marked.alias("x"), _tests(conditions), "left")
    n = [F.count("x.__hit").alias(count)] if count else []
    keep = [F.col(f"i.`{c}`").alias(c) for c in single.columns]
    return _repeat(joined.groupBy(*keep).agg(*n, *[c.alias(k) for k, c in aggs.items()]), "__times")


def update_on(x: DataFrame, i: DataFrame, on: Sequence[str], values: dict[str, str], order: Sequence[str]) -> DataFrame:
    """Set columns of x from the matching row of i (the last by ``order``); rows without a match stay."""
    last = i.withColumn("__rn", F.row_number().over(Window.partitionBy(*on).orderBy(*_turn(order)))).where("__rn = 1")
    new = last.select(*[F.col(c).alias(f"__{c}") for c in on], *[F.col(v).alias(f"__new_{k}") for k, v in values.items()], F.lit(True).alias("__hit"))
    joined = x.join(new, reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on]), "left")
    out = [F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c) if c in x.columns else F.lit(None)).alias(c) if c in values else F.col(c) for c in [*x.columns, *[v for v in values if v not in x.columns]]]
    return joined.select(*out)


def rolling(x: DataFrame, i: DataFrame, equal: Sequence[str], along: str, roll: float | str | bool = True, rollends: tuple[bool, bool] | None = None, order: Sequence[str] = (), nomatch: str | None = "NA", spread: bool | None = None) -> DataFrame:
    """As-of join: all x rows that match exactly, else the prevailing one before (roll > 0), after (< 0) or nearest.

    A finite ``roll`` limits the distance, limit included; ``nearest`` prefers the lower at equal distance. ``rollends``
    says whether rows before the first or after the last x row of a group are filled too. ``order`` breaks ties of
    ``along`` in x. One shuffle by the equal columns serves both sides: x and i are stacked and a running window
    carries the last x row. ``spread`` (always without equal columns) cuts groups into sorted ranges instead, so that no
    group has to fit a task; it runs at once. The result has i's columns, then x's others, and ``x.<along>``.
    """
    nearest = roll == "nearest"
    forward = not nearest and roll is not True and float(roll) < 0
    limit = None if nearest or roll is True or abs(float(roll)) == float("inf") else abs(float(roll))
    lo, hi = rollends if rollends is not None else (True, True) if nearest else (True, False) if forward else (False, True)
    kind = dict(i.dtypes)[along]
    if kind == "string" and (nearest or limit is not None):
        raise TypeError(f"{along}: strings have no distance to roll by")
    extra = [c for c in x.columns if c not in equal and c != along]
    names = {c: f"x.{c}" if c in i.columns else c for c in extra}
    payload = F.struct(F.col(along).alias("__t"), *[F.col(c).alias(names[c]) for c in extra])
    right = x.select(*equal, F.col(along).alias("__at"), F.lit(0).alias("__side"), F.struct(*order).alias("__o") if order else F.struct(F.lit(0)).alias("__o"), payload.alias("__x"), F.lit(None).cast("struct<" + ",".join(f"`{c}`:{t}" for c, t in i.dtypes) + ">").alias("__i"))
    left = i.select(*equal, F.col(along).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema["__o"].dataType).alias("__o"), F.lit(None).cast(right.schema["__x"].dataType).alias("__x"), F.struct(*i.columns).alias("__i"))
    both = right.unionByName(left)
    number = kind in ("int", "bigint", "double", "float", "smallint", "tinyint")

    def gap(a: Column, b: Column) -> Column:
        return (a - b).cast("double") if number else (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 1e6

    # Both frames begin at a group's end and stop at the row: down the order for the row before, up it for the row after.
    orders = {"__before": [F.asc("__at"), F.asc("__side"), F.asc("__o")]}
    if nearest or forward or lo or not hi:
        orders["__after"] = [F.desc("__at"), F.asc("__side"), F.desc("__o")]
    if spread or (spread is None and not equal):
        for name, by in orders.items():
            both = carry_last(both, equal, by, F.col("__x"), name)
    else:
        both = both.withColumns({name: F.last("__x", ignorenulls=True).over(Window.partitionBy(*equal).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)) for name, by in orders.items()})
    found = both.where("__side = 1")
    at, before = F.col("__at"), F.col("__before")
    after = F.col("__after") if "__after" in orders else F.lit(None)
    if nearest:
        pick = F.when(before.isNull(), F.when(F.lit(lo), after)).when(after.isNull(), F.when(F.lit(hi), before)).when(gap(at, before["__t"]) <= gap(after["__t"], at), before).otherwise(after)
    elif forward:
        pick = F.when(before.isNotNull() | F.lit(lo), after)
        pick = F.coalesce(pick, F.when(after.isNull() & F.lit(hi), before))
    else:
        pick = before if hi else F.when(after.isNotNull(), before)
        pick = F.coalesce(pick, F.when(before.isNull() & F.lit(lo), after)) if lo else pick
    if limit is not None:
        pick = F.when(F.abs(gap(at, pick["__t"])) - limit <= 1e-6, pick)
    rolled = found.select("__i", F.when(at.isNotNull(), pick).alias("__x"))
    # Exact matches keep all ties: only those go through a join, on equal columns and place.
    exact = rolled.where(F.col("__x")["__t"] == F.col(f"__i.{along}")).select("__i")
    keys = [F.col(f"__i.{c}").eqNullSafe(F.col(f"__k_{c}")) for c in equal] + [F.col(f"__i.{along}") == F.col("__xs.__t")]
    ties = exact.join(x.select(*[F.col(c).alias(f"__k_{c}") for c in equal], payload.alias("__xs")), reduce(lambda a, b: a & b, keys)).select("__i", F.col("__xs").alias("__x"))
    rest = rolled.where(F.col("__x").isNull() | (F.col("__x")["__t"] != F.col(f"__i.{along}")))
    every = ties.union(rest)
    if nomatch is None:
        every = every.where(F.col("__x").isNotNull())
    return every.select(*[F.col("__i")[c].alias(c) for c in i.columns], F.col("__x")["__t"].alias(f"x.{along}"), *[F.col("__x")[names[c]].alias(names[c]) for c in extra])


def _interval(df: DataFrame, lo: str, hi: str) -> DataFrame:
    """``df``, whose intervals are checked as they are read: a missing end, or a start beyond its end, is an error."""
    a, b = F.col(f"`{lo}`"), F.col(f"`{hi}`")
    bad = F.raise_error(F.concat(F.lit(f"no interval from {lo} to {hi}: "), F.coalesce(a.cast("string"), F.lit("missing")), F.lit(", "), F.coalesce(b.cast("string"), F.lit("missing"))))
    odd = a.isNull() | b.isNull() | (a > b)
    return df.withColumns({n: F.when(odd, bad.cast(df.schema[n].dataType)).otherwise(e) for n, e in ((lo, a), (hi, b))})


def overlaps(x: DataFrame, y: DataFrame, equal: Sequence[str], x_span: tuple[str, str], y_span: tuple[str, str], kind: str = "any", width: float | None = None, nomatch: str | None = "NA", mult: str = "all", order: Sequence[str] = ()) -> DataFrame:
    """Rows of x with y's intervals: any overlap, x within y, or equal start, end or both. Ends belong to intervals.

    The result has the equal columns, y's others, then x's others (``i.`` before a name that clashes). ``mult`` takes the first
    or last row of y by ``order``. A missing end, or a start beyond its end, is an error. With ``width`` intervals are
    dealt to bins of that size and joined bin by bin: a pair meets in the bin where the later of the two begins, so
    no pair comes twice; without it, and without equal columns, plans are nested loops.
    """
    if mult != "all" and not order:
        raise ValueError(f"mult={mult!r} needs an order")
    (a, b), (c, d) = x_span, y_span
    x, y = _interval(x, a, b), _interval(y, c, d)
    single = _counted(x) if mult != "all" else x
    xa, xb, ya, yb = F.col(f"x.`{a}`"), F.col(f"x.`{b}`"), F.col(f"y.`{c}`"), F.col(f"y.`{d}`")
    test = {"any": (ya <= xb) & (yb >= xa), "within": (xa >= ya) & (xb <= yb), "start": xa == ya, "end": xb == yb, "equal": (xa == ya) & (xb == yb)}[kind]
    for k in equal:
        test = test & F.col(f"x.`{k}`").eqNullSafe(F.col(f"y.`{k}`"))
    rows = [F.struct(*[F.col(f"{side}.`{n}`").alias(n) for n in t.columns]).alias(side) for side, t in (("x", single), ("y", y))]
    if not width:
        pairs = single.alias("x").join(y.alias("y"), test, "left" if nomatch is not None else "inner").select(*rows)
        pairs = pairs.withColumn("y", F.when(F.col(f"y.`{c}`").isNotNull(), F.col("y")))
    else:

        def bins(lo: str, hi: str) -> Column:
            return F.explode(F.sequence(F.floor(F.col(f"`{lo}`") / width), F.floor(F.col(f"`{hi}`") / width)))

        met = single.withColumn("__bin", bins(a, b)).alias("x").join(y.withColumn("__bin", bins(c, d)).alias("y"), (F.col("x.__bin") == F.col("y.__bin")) & (F.floor(F.greatest(xa, ya) / width) == F.col("x.__bin")) & test)
        pairs = met.select(*rows)
        if nomatch is not None:  # whether a row matches follows from its interval and equal columns
            had = pairs.select(*[F.col(f"x.`{n}`").alias(f"__h{k}") for k, n in enumerate([a, b, *equal])]).distinct()
            same = reduce(lambda p, q: p & q, [F.col(f"`{n}`").eqNullSafe(F.col(f"__h{k}")) for k, n in enumerate([a, b, *equal])])
            alone = single.join(had, same, "left_anti").select(F.struct(*[F.col(f"`{n}`").alias(n) for n in single.columns]).alias("x"))
            pairs = pairs.union(alone.withColumn("y", F.lit(None).cast(pairs.schema["y"].dataType)))
    if mult != "all":
        by = F.struct(*[F.col(f"y.`{o}`") for o in order])
        pairs = pairs.groupBy("x").agg((F.min_by if mult == "first" else F.max_by)("y", F.when(F.col("y").isNotNull(), by)).alias("y"))
        pairs = _repeat(pairs.withColumn("__times", F.col("x.__times")), "__times")
    theirs = [n for n in y.columns if n not in equal]
    ours = [F.col(f"x.`{n}`").alias(f"i.{n}" if n in theirs else n) for n in x.columns if n not in equal]
    return pairs.select(*[F.col(f"x.`{k}`").alias(k) for k in equal], *[F.col(f"y.`{n}`").alias(n) for n in theirs], *ours)


def overlap_rows(x: DataFrame, y: DataFrame, equal: Sequence[str], x_span: tuple[str, str], y_span: tuple[str, str], order_x: Sequence[str], order_y: Sequence[str], **kw) -> DataFrame:
    """Row numbers (xid, yid; from 1, in each table's order) of the pairs that ``overlaps`` finds."""
    return overlaps(number_rows(x, order_x, "xid"), number_rows(y, order_y, "yid"), equal, x_span, y_span, **kw).select("xid", "yid")


def merge(x: DataFrame, y: DataFrame, by: Sequence[str] | None = None, all_x: bool = False, all_y: bool = False, suffixes: tuple[str, str] = (".x", ".y"), sort: bool = False, incomparables: Sequence = (), by_x: Sequence[str] | None = None, by_y: Sequence[str] | None = None) -> DataFrame:
    """SQL-style merge; shared names by default, clashing others get suffixes, keys come first, under x's names.

    ``by_x`` and ``by_y`` name keys that are called otherwise in the two tables. Rows whose key holds one of
    ``incomparables`` (None: missing) match nothing.
    """
    if (by_x is None) != (by_y is None) or (by_x is not None and (by is not None or len(by_x) != len(by_y))):
        raise ValueError("give by, or as many names in by_x as in by_y")
    if by_x is not None:
        clash = set(by_x) & set(y.columns) - set(by_y)
        y = y.withColumnsRenamed({c: c + suffixes[1] for c in clash} | {b: a for a, b in zip(by_x, by_y, strict=True)})
        by = by_x
    by = list(by) if by is not None else natural(x, y)
    how = {(False, False): "inner", (True, False): "left", (False, True): "right", (True, True): "full"}[all_x, all_y]
    clash = set(x.columns) & set(y.columns) - set(by)
    a = x.select(*[F.col(c).alias(c + suffixes[0] if c in clash else f"__x_{c}" if c in by else c) for c in x.columns])
    b = y.select(*[F.col(c).alias(c + suffixes[1] if c in clash else f"__y_{c}" if c in by else c) for c in y.columns])
    tests = [F.col(f"__x_{c}").eqNullSafe(F.col(f"__y_{c}")) for c in by]
    tests += [~F.col(f"__x_{c}").eqNullSafe(F.lit(v)) for c in by for v in incomparables]
    joined = a.join(b, reduce(lambda p, q: p & q, tests), how)
    keys = [F.coalesce(f"__x_{c}", f"__y_{c}").alias(c) for c in by]
    out = joined.select(*keys, *[F.col(f"`{c}`") for c in joined.columns if not c.startswith(("__x_", "__y_"))])
    return out.orderBy(*by) if sort else out


def merge_list(tables: Sequence[DataFrame], on: Sequence[str] | Sequence[Sequence[str]], how: str | Sequence[str] = "left", mult: str | None | Sequence[str | None] = None, order: Sequence[str] = (), many: bool = True) -> DataFrame:
    """Fold of merges from the left: left, inner, full, right, semi, anti or cross; ``on``, ``how`` and ``mult`` for all steps, or a list of one each.

    ``mult`` takes the first or last row of a key by ``order`` (all, or ``error`` if a key repeats) on the side that is looked up;
    inner and full merges with first or last take one row of a key on both sides. By default it is ``error``. ``many=False``
    raises if a key repeats on both sides of a step.
    """
    steps = len(tables) - 1
    ons = [list(on)] * steps if not on or isinstance(on[0], str) else [list(o) for o in on]
    hows, mults = ([v] * steps if v is None or isinstance(v, str) else list(v) for v in (how, mult))
    if not len(ons) == len(hows) == len(mults) == steps:
        raise ValueError(f"{steps} steps need as many of on, how and mult")

    def single(t: DataFrame, on: Sequence[str], mult: str) -> DataFrame:
        keys = [F.col(f"`{c}`") for c in on]
        by = [o for o in order if o in t.columns]
        if not by:
            raise ValueError(f"mult={mult!r} needs an order")
        return t.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*(_turn(by) if mult == "last" else by)))).where("__rn = 1").drop("__rn")

    out = tables[0]
    for b, on_, how_, mult_ in zip(tables[1:], ons, hows, mults, strict=True):
        if how_ == "cross":
            out = out.crossJoin(b)
            continue
        _guard(out, b, [On(c, "==", c) for c in on_], True, many)
        if how_ in ("semi", "anti"):
            out = {"semi": semi, "anti": anti}[how_](out, b, on_)
            continue
        if mult_ in ("first", "last"):
            both = how_ in ("inner", "full")
            out, b = single(out, on_, mult_) if both or how_ == "right" else out, single(b, on_, mult_) if both or how_ != "right" else b
        elif mult_ in (None, "error"):  # repeated keys on the side that is looked up are an error once a row matches them
            repeated, marked = F.count("*").over(Window.partitionBy(*[F.col(f"`{c}`") for c in on_])) > 1, F.lit(True)
            out, b = (out.withColumn("__many", repeated), b.withColumn("__met", marked)) if how_ == "right" else (out.withColumn("__met", marked), b.withColumn("__many", repeated))
        out = merge(out, b, on_, how_ in ("left", "full"), how_ in ("right", "full"))
        if mult_ in (None, "error"):
            out = out.where(F.when(F.col("__many") & F.col("__met"), F.raise_error(F.lit("a key repeats")).cast("boolean")).otherwise(F.lit(True))).drop("__many", "__met")
    return out


def cross(**values: Sequence) -> tuple[list[str], list[tuple]]:
    """Rows of a cross join of vectors, the last varying fastest."""
    from itertools import product

    return list(values), list(product(*values.values()))
