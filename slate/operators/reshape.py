"""Wide to long, long to wide, and columns chosen or named by patterns."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def columns(df: DataFrame, *which: str | Callable[[str, str], bool], negate: bool = False) -> list[str]:
    """Columns by name, ``a:c`` range, ``/pattern/`` or a function of name and type, in the table's order."""
    names, chosen = df.columns, set()
    for w in which:
        if callable(w):
            chosen |= {n for n, t in df.dtypes if w(n, t)}
        elif w.startswith("/") and w.endswith("/") and len(w) > 1:
            chosen |= {n for n in names if re.search(w[1:-1], n)}
        elif ":" in w and w not in names:
            a, b = (names.index(p) for p in w.split(":"))
            chosen |= set(names[min(a, b) : max(a, b) + 1])
        elif w in names:
            chosen.add(w)
        else:
            raise ValueError(f"no column {w!r}")
    return [n for n in names if (n in chosen) != negate]


def patterns(df: DataFrame, *regexes: str) -> list[list[str]]:
    """For each pattern the columns that it finds."""
    return [[c for c in df.columns if re.search(r, c)] for r in regexes]


def measure(df: DataFrame, pattern: str | None = None, groups: Sequence[str] = (), convert: dict[str, Callable] | None = None, sep: str = "_") -> tuple[list[tuple], list[str]]:
    """Parse column names: (column, parts...) of each that matches, parts converted where asked.

    Without a pattern, names are split at ``sep``, and those with as many parts as there are groups are measured.
    """
    convert = convert or {}
    if pattern is None:
        most = max(len(c.split(sep)) for c in df.columns)
        if most == 1 or most != len(groups):
            raise ValueError(f"names have up to {most} parts between {sep!r}, not {len(groups)}")
        pattern = re.escape(sep).join([f"((?:(?!{re.escape(sep)}).)*)"] * len(groups))
    out = [(c, *[convert.get(g, str)(p) for g, p in zip(groups, m.groups(), strict=True)]) for c in df.columns if (m := re.fullmatch(pattern, c))]
    if not out:
        raise ValueError(f"no column matches {pattern!r}")
    if len({r[1:] for r in out}) < len(out):
        raise ValueError("two columns have the same parts")
    return out, list(groups)


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str] | Sequence[Sequence[str]], variable: str = "variable", value: str | Sequence[str] = "value", na_rm: bool = False) -> DataFrame:
    """One row for each id row and measure. Several lists of columns give several value columns, numbered from 1."""
    several = bool(values) and not isinstance(values[0], str)
    if not several:
        out = df.unpivot([*ids], [*values], variable, value)
        return out.where(F.col(value).isNotNull()) if na_rm else out
    names = [value] if isinstance(value, str) else list(value)
    k = max(map(len, values))
    rows = [F.struct(F.lit(i + 1).alias(variable), *[(F.col(f"`{v[i]}`") if i < len(v) and v[i] is not None else F.lit(None)).alias(n) for v, n in zip(values, names, strict=True)]) for i in range(k)]
    out = df.select(*ids, F.inline(F.array(*rows)))
    return out.where(~_all_null(names)) if na_rm else out


def _all_null(names: Sequence[str]) -> Column:
    return F.coalesce(*[F.col(n).cast("string") for n in names]).isNull()


def melt_measure(df: DataFrame, ids: Sequence[str], found: tuple[list[tuple], list[str]], value: str = "value") -> DataFrame:
    """Melt with the parsed parts of the names as columns; a part named ``value.name`` names value columns instead."""
    rows, groups = found
    if "value.name" not in groups:
        each = [F.struct(*[F.lit(p).alias(g) for g, p in zip(groups, r[1:], strict=True)], F.col(f"`{r[0]}`").alias(value)) for r in rows]
        return df.select(*ids, F.inline(F.array(*each)))
    at = groups.index("value.name")
    others = [g for g in groups if g != "value.name"]
    names = list(dict.fromkeys(r[1 + at] for r in rows))
    table: dict[tuple, dict[str, str]] = {}
    for r in rows:
        table.setdefault(tuple(p for g, p in zip(groups, r[1:], strict=True) if g != "value.name"), {})[r[1 + at]] = r[0]
    each = [F.struct(*[F.lit(p).alias(g) for g, p in zip(others, key, strict=True)], *[(F.col(f"`{cols[n]}`") if n in cols else F.lit(None)).alias(n) for n in names]) for key, cols in table.items()]
    return df.select(*ids, F.inline(F.array(*each)))


def dcast(df: DataFrame, rows: Sequence[str], cols: Sequence[str], aggs: dict[str, Callable[[], Column]], levels: Sequence[tuple] | None = None, fill=None, sep: str = "_", drop: bool = True, most: int = 1000) -> DataFrame:
    """Long to wide: a row for each combination of ``rows``, a column for each of ``cols`` and aggregate.

    Names are the levels, after the aggregate's name if there are several. Levels are looked up (at most ``most``)
    unless given. With ``drop=False`` all combinations of the row columns' values appear.
    """
    if levels is None:
        found = df.select(*[F.col(f"`{c}`") for c in cols]).distinct().limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"more than {most} columns")
        levels = sorted((tuple(r) for r in found), key=lambda t: [(v is not None, v) for v in t])
    out = []
    for name, agg in aggs.items():
        for level in levels:
            here = F.lit(True)
            for c, v in zip(cols, level, strict=True):
                here = here & F.col(f"`{c}`").eqNullSafe(F.lit(v))
            title = sep.join([*([name] if len(aggs) > 1 else []), *["NA" if v is None else str(v) for v in level]])
            value = agg(here)
            out.append((F.coalesce(value, F.lit(fill)) if fill is not None else value).alias(title))
    wide = df.groupBy(*[F.col(f"`{r}`") for r in rows]).agg(*out)
    if drop or len(rows) < 2:
        return wide
    grid = df.select(rows[0]).distinct()
    for r in rows[1:]:
        grid = grid.crossJoin(df.select(r).distinct())
    on = [grid[r].eqNullSafe(wide[r]) for r in rows]
    test = on[0]
    for t in on[1:]:
        test = test & t
    full = grid.join(wide, test, "left").select(*[grid[r] for r in rows], *[wide[f"`{c}`"] for c in wide.columns if c not in rows])
    return full.fillna(fill) if fill is not None else full


def _side(text: str, df: DataFrame, taken: Sequence[str]) -> list[str | Column]:
    """Columns of one side of a formula: names or SQL expressions joined by +; ``.`` is none, ``...`` all that aren't taken."""
    out: list[str | Column] = []
    for part in (p.strip() for p in re.split(r"\+(?![^(]*\))", text)):
        if part == "...":
            out += [c for c in df.columns if c not in taken]
        elif part in df.columns:
            out.append(part)
        elif part != ".":
            out.append(F.expr(part).alias(part))
    return out


def dcast_formula(df: DataFrame, formula: str, values: Sequence[str], aggs: dict[str, Callable[[Column], Column]] | None = None, subset: Column | None = None, **kw) -> DataFrame:
    """``rows ~ columns`` to wide. Sides are names or expressions joined by ``+``; ``.`` stands for nothing, ``...`` for all other columns.

    ``aggs`` are functions by name, of each column of ``values``; without them rows are counted. Columns are called by
    value (if several), function (if several), then levels.
    """
    left, tilde, right = formula.partition("~")
    if not tilde:
        raise ValueError("a formula has the form rows ~ columns")
    df = df if subset is None else df.where(subset)
    named = {p.strip() for side in (left, right) for p in side.split("+")} & set(df.columns)
    rows, cols = (_side(side, df, [*named, *values]) for side in (left, right))
    for i, side in enumerate((rows, cols)):
        for k, c in enumerate(side):
            if isinstance(c, Column):
                name = [p.strip() for p in re.split(r"\+(?![^(]*\))", (left, right)[i])][k]
                df, side[k] = df.withColumn(name, F.expr(name)), name
    aggs = aggs or {"length": lambda x: F.count_if(x.isNotNull() | x.isNull())}
    several = len(values) > 1, len(aggs) > 1
    titles = {"_".join([v] * several[0] + [f] * several[1]) or v: (v, g) for v in values for f, g in aggs.items()}
    found = {t: (lambda here, v=v, g=g: g(F.when(here, F.col(f"`{v}`"))) if g is not aggs.get("length") else F.count_if(here)) for t, (v, g) in titles.items()}
    if not cols:
        keys = [F.col(f"`{r}`") for r in rows]
        out = [agg(F.lit(True)).alias(t if len(titles) > 1 else ".") for t, agg in found.items()]
        return df.groupBy(*keys).agg(*out)
    if not rows:
        df, rows = df.withColumn(".", F.lit(".")), ["."]
    return dcast(df, rows, cols, found, **kw)


def transpose(df: DataFrame, index: str) -> DataFrame:
    """Rows to columns by an index column; small tables only, as every row becomes a column."""
    return df.transpose(F.col(index))
