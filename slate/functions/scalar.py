"""Scalar functions with explicit treatment of missing values; all are native column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Value = Column | int | float | str | bool | None


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit(v: Value) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def not_nan(x: Column) -> Column:
    """A number, missing where it is NaN."""
    return F.when(~F.isnan(x), x)


def is_na(x: Column | str, floating: bool = False) -> Column:
    """Whether a value is missing; of floating columns NaN counts as missing."""
    x = col(x)
    return x.isNull() | F.isnan(x) if floating else x.isNull()


def same(a: Column, b: Column) -> Column:
    """Equality under which missing equals missing."""
    return a.eqNullSafe(b)


def sort_key(c: Column | str, descending: bool = False, na_last: bool | None = False, floating: bool = False) -> list[Column]:
    """Sort columns that put missing first (or last) whatever the direction, then NaN, then numbers."""
    c = col(c)
    nulls = c.isNull().asc() if na_last else c.isNotNull().asc()
    value = c.desc() if descending else c.asc()
    if not floating:
        return [nulls, value]
    nan = F.isnan(F.coalesce(c, F.lit(0.0)))
    return [nulls, nan.asc() if descending else nan.desc(), value]


def fifelse(test: Column, yes: Value, no: Value, na: Value = None) -> Column:
    return F.when(test.isNull(), lit(na)).when(test, lit(yes)).otherwise(lit(no))


def fcase(*pairs: Value, default: Value = None) -> Column:
    """First value whose condition is true; missing conditions are passed over."""
    if len(pairs) % 2:
        raise ValueError("conditions and values come in pairs")
    out = F.when(lit(pairs[0]), lit(pairs[1]))
    for test, value in zip(pairs[2::2], pairs[3::2], strict=True):
        out = out.when(lit(test), lit(value))
    return out.otherwise(lit(default))


def fcoalesce(*values: Column, nan: bool = False) -> Column:
    """First value that isn't missing; with ``nan`` NaN counts as missing."""
    return F.coalesce(*[F.when(~F.isnan(v), v) if nan else v for v in map(col, values)])


def between(x: Column, lower: Value, upper: Value, inclusive: bool = True, na_bounds: bool = True) -> Column:
    """A missing bound is no bound, or with ``na_bounds=False`` gives missing unless the other bound already fails."""
    lower, upper = lit(lower), lit(upper)
    lo, hi = (x >= lower, x <= upper) if inclusive else (x > lower, x < upper)
    if not na_bounds:
        return lo & hi
    return F.when(x.isNotNull(), F.coalesce(lo, F.lit(True)) & F.coalesce(hi, F.lit(True)))


def isin(x: Column, values: Iterable) -> Column:
    """Membership that is never missing: missing is in the values only if they hold it."""
    values = list(values)
    known = [v for v in values if v is not None]
    hit = F.coalesce(x.isin(known), F.lit(False)) if known else F.lit(False)
    return hit | x.isNull() if len(known) < len(values) else hit


def notin(x: Column, values: Iterable) -> Column:
    return ~isin(x, values)


def like(x: Column, pattern: str, ignore_case: bool = False, fixed: bool = False) -> Column:
    """Regular expression search (or a fixed text); missing gives false."""
    if fixed:
        hit = F.contains(F.lower(x), F.lit(pattern.lower())) if ignore_case else F.contains(x, F.lit(pattern))
    else:
        hit = x.rlike("(?i)" + pattern if ignore_case else pattern)
    return F.coalesce(hit, F.lit(False))


def floor_mod(a: Column, b: Value) -> Column:
    """Remainder with the divisor's sign; missing for divisor 0."""
    b = lit(b)
    return F.try_subtract(a, F.floor(F.try_divide(a, b)) * b)


def floor_div(a: Column, b: Value) -> Column:
    return F.floor(F.try_divide(a, lit(b)))


def divide(a: Column, b: Column) -> Column:
    """Division of doubles as IEEE has it: by zero gives an infinity or NaN, not an error."""
    a, b = a.cast("double"), b.cast("double")
    infinite = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).otherwise(float("nan"))
    return F.when(b == 0, F.when(a.isNotNull(), infinite)).otherwise(a / F.when(b != 0, b))


def any_missing(columns: Sequence[str], floating: Iterable[str] = ()) -> Column:
    """Whether any of the columns is missing; of those in ``floating`` NaN counts as missing."""
    return reduce(lambda a, b: a | b, [F.coalesce(is_na(c, c in floating), F.lit(True)) for c in columns])


def tstrsplit(x: Column, sep: str, width: int, fill: Value = None, keep: Sequence[int] | None = None) -> list[Column]:
    """Parts 1..width of a split text, missing parts filled; ``keep`` picks some of them."""
    parts = F.split(x, sep)
    every = [F.coalesce(F.get(parts, F.lit(i)), F.when(x.isNotNull(), lit(fill))) for i in range(width)]
    return every if keep is None else [every[k - 1] for k in keep]


def split_columns(df: DataFrame, x: str, sep: str, names: Sequence[str] | None = None, fill: Value = None, types: dict[int, str] | None = None, keep: Sequence[int] | None = None, rev: bool = False) -> DataFrame:
    """``df`` with the parts of a split text as columns V1, V2, ... or ``names``; one pass finds how many there are.

    ``keep`` picks parts, ``types`` casts some of them (by number; what can't be cast is missing), ``rev`` counts from the end.
    """
    parts = F.split(F.col(f"`{x}`"), sep)
    width = df.agg(F.max(F.size(parts))).first()[0] or 0
    keep = list(keep) if keep is not None else list(range(1, width + 1))
    if not all(1 <= k <= width for k in keep):
        raise ValueError(f"keep holds numbers from 1 to {width}")
    names = list(names) if names is not None else [f"V{k}" for k in range(1, len(keep) + 1)]
    if len(names) != len(keep):
        raise ValueError(f"{len(names)} names for {len(keep)} parts")
    parts = F.reverse(parts) if rev else parts
    filled = {k: F.coalesce(F.get(parts, F.lit(k - 1)), F.when(F.col(f"`{x}`").isNotNull(), lit(fill))) for k in keep}
    return df.withColumns({n: filled[k].try_cast((types or {})[k]) if k in (types or {}) else filled[k] for n, k in zip(names, keep, strict=True)})


def numeric_key(x: Column, n_bytes: int = 2) -> Column:
    """A double rounded so that its last ``n_bytes`` (0, 1 or 2) don't count, to sort, group or join by."""
    if n_bytes not in (0, 1, 2):
        raise ValueError("0, 1 or 2 bytes")
    unit = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(x))) - (52 - 8 * n_bytes))
    return x if n_bytes == 0 else F.when((x == 0) | F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.rint(x / unit) * unit)


@dataclass(frozen=True)
class I:  # noqa: E742
    """A value in ``substitute``'s environment that stays a value."""

    value: object


def substitute(text: str, env: dict[str, object]) -> Column:
    """A SQL expression in which names stand for others: for a column's name, a list of them, another Column's text, or a value (``I``)."""

    def put(m: re.Match) -> str:
        if m[0][0] in "'`\"" or m[0] not in env:
            return m[0]
        v = env[m[0]]
        if isinstance(v, I):
            return str(v.value) if not isinstance(v.value, str) else "'" + v.value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return ", ".join(f"`{c}`" for c in ([v] if isinstance(v, str) else v))

    return F.expr(re.sub(r"'(?:[^'\\]|\\.)*'|`[^`]*`|\"[^\"]*\"|[A-Za-z_]\w*", put, text))
