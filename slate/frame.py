"""A table with an order and a key: one bracket-style call makes one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slate.functions.scalar import sort_key
from slate.operators import aggregate, joins
from slate.operators.rows import number_rows


def rowwise(spark: SparkSession, names: Sequence[str], *values: object, schema: str | None = None) -> DataFrame:
    """A small table written row by row: ``rowwise(spark, ["a", "b"], 1, "x", 2, "y")``."""
    if not names or len(values) % len(names):
        raise ValueError(f"{len(values)} values don't fill rows of {len(names)}")
    rows = [tuple(values[k : k + len(names)]) for k in range(0, len(values), len(names))]
    return spark.createDataFrame(rows, schema or list(names))


def tables(spark: SparkSession, frames: dict[str, Frame]) -> DataFrame:
    """Name, rows, columns, key and indexes of some frames; counts at once."""
    rows = [(n, f.df.count(), ",".join(f.df.columns), ",".join(f.key), ";".join(",".join(x) for x in f.indexes)) for n, f in sorted(frames.items())]
    return spark.createDataFrame(rows, "name string, rows long, columns string, key string, indexes string")


@dataclass(frozen=True)
class Frame:
    """``df`` with the columns that order its rows, and those it is keyed by. Nothing here is computed eagerly."""

    df: DataFrame
    order: tuple[str, ...] = ()
    key: tuple[str, ...] = ()
    indexes: tuple[tuple[str, ...], ...] = ()

    def _with(self, df: DataFrame) -> Frame:
        return replace(self, df=df)

    def q(self, i: Column | None = None, j: dict[str, Column] | Sequence[str] | None = None, by: Sequence[str | Column] = (), keyby: Sequence[str] = ()) -> Frame:
        """Filter by ``i`` (missing drops the row), group by ``by`` or sorted ``keyby``, select or aggregate ``j``."""
        df = self.df.where(i) if i is not None else self.df
        if j is None:
            return self._with(df)
        if by or keyby:
            if not isinstance(j, dict):  # the groups' own rows, one beside the other
                keys = [F.col(b) if isinstance(b, str) else b for b in by or keyby]
                out = df.select(*keys, *[c for c in j if c not in (by or keyby)])
                return Frame(out.orderBy(*[k for n in keyby for k in sort_key(n)]) if keyby else out, key=tuple(keyby))
            return Frame(aggregate.summarise(df, list(by or keyby), j, keyed=bool(keyby)), key=tuple(keyby))
        return Frame(df.select(*[c.alias(n) for n, c in j.items()]) if isinstance(j, dict) else df.select(*j), self.order)

    def update(self, values: dict[str, Column | None], where: Column | None = None, by: Sequence[str] = ()) -> Frame:
        """Add or change columns (None drops one), on some rows only, or from each group's aggregates."""
        df = self.df.drop(*[n for n, c in values.items() if c is None])
        new = {}
        for n, c in values.items():
            if c is None:
                continue
            if by:
                from pyspark.sql import Window

                c = c.over(Window.partitionBy(*by))
            old = F.col(n) if n in self.df.columns else F.lit(None)
            new[n] = c if where is None else F.when(where, c).otherwise(old)
        return self._with(df.withColumns(new))

    def delete(self, where: Column) -> Frame:
        return self._with(self.df.where(~F.coalesce(where, F.lit(False))))

    def join(self, i: DataFrame, on: Sequence[str] | None = None, **kw) -> Frame:
        """x[i]: the rows of i with their matches here; on the key where ``on`` isn't given."""
        return Frame(joins.join(self.df, i, list(on or self.key), order=self.order, **kw))

    def set_order(self, *columns: str, na_last: bool = False) -> Frame:
        """Order by columns (``-name`` descending), missing first by default."""
        names = [c.lstrip("-") for c in columns]
        keys = [k for c, n in zip(columns, names, strict=True) for k in sort_key(n, c.startswith("-"), na_last)]
        return replace(self, df=self.df.orderBy(*keys), order=tuple(names))

    def set_key(self, *columns: str) -> Frame:
        return replace(self.set_order(*columns), key=columns)

    def rows(self, positions: Sequence[int]) -> Frame:
        """Rows by position from 1 in the table's order: repeats and gaps kept, negative ones excluded, beyond the end missing.

        A missing position gives a missing row; missing ones alone give one.
        """
        if not self.order:
            raise ValueError("positions need an order")
        positions = [p for p in positions if p != 0]
        if positions and all(p is None for p in positions):
            positions = [None]
        if any((p or 0) < 0 for p in positions) and any(p is None or p > 0 for p in positions):
            raise ValueError("positive and negative positions can't be mixed")
        numbered = number_rows(self.df, self.order, "__rn")
        if positions and (positions[0] or 0) < 0:
            return self._with(numbered.where(~F.col("__rn").isin([-p for p in positions])).drop("__rn"))
        wanted = self.df.sparkSession.createDataFrame([(k, p) for k, p in enumerate(positions)], "__at int, __rn long")
        return self._with(wanted.join(numbered, "__rn", "left").orderBy("__at").drop("__at", "__rn"))

    def head(self, n: int = 6) -> Frame:
        """The first ``n`` rows, or with a negative ``n`` all but the last ones."""
        return self._with(self.df.orderBy(*self.order).limit(n if n >= 0 else max(0, self.df.count() + n)))

    def tail(self, n: int = 6) -> Frame:
        """The last ``n`` rows in the table's order, or with a negative ``n`` all but the first ones."""
        last = self.df.orderBy(*[F.desc(c) for c in self.order]).limit(n if n >= 0 else max(0, self.df.count() + n))
        return self._with(last.orderBy(*self.order))

    def reverse(self) -> Frame:
        """The rows in the opposite order."""
        return self._with(self.df.orderBy(*[F.desc(c) for c in self.order]))

    def rename(self, names: dict[str, str] | Callable[[str], str], skip_absent: bool = False) -> Frame:
        """New names by old ones, or from a function of the old name; order and key follow."""
        if callable(names):
            names = {c: names(c) for c in self.df.columns}
        absent = set(names) - set(self.df.columns)
        if absent and not skip_absent:
            raise ValueError(f"no column {min(absent)!r}")
        order, key = (tuple(names.get(c, c) for c in part) for part in (self.order, self.key))
        return Frame(self.df.withColumnsRenamed(names), order, key)

    def reorder(self, *columns: str, before: str | None = None, after: str | None = None) -> Frame:
        """Columns moved to the front, or beside another column."""
        rest = [c for c in self.df.columns if c not in columns]
        if before is not None and after is not None:
            raise ValueError("give before or after, not both")
        at = rest.index(before) if before is not None else rest.index(after) + 1 if after is not None else 0
        return self._with(self.df.select(*rest[:at], *columns, *rest[at:]))

    def n(self) -> int:
        """How many rows there are; ``f.rows([f.n()])`` is the last one."""
        return self.df.count()

    def which(self, i: Column, name: str = "which") -> Frame:
        """Positions (from 1, in the table's order) of the rows for which ``i`` is true."""
        return Frame(number_rows(self.df, self.order, name).where(i).select(name), (name,))

    def set(self, positions: Sequence[int], columns: Sequence[str], value: object) -> Frame:
        """Values at positions (from 1, in the table's order) of some columns replaced."""
        here = F.col("__rn").isin(list(positions))
        numbered = number_rows(self.df, self.order, "__rn")
        return self._with(numbered.withColumns({c: F.when(here, value if isinstance(value, Column) else F.lit(value)).otherwise(F.col(f"`{c}`")) for c in columns}).drop("__rn"))

    def transform(self, **values: Column) -> Frame:
        """Columns from the table as it is: none sees another's new value."""
        return self._with(self.df.withColumns(values))

    def within(self, *steps: tuple[str, Column | None]) -> Frame:
        """Columns one after the other, each from what the ones before made (None drops one)."""
        df = self.df
        for name, c in steps:
            df = df.drop(name) if c is None else df.withColumn(name, c)
        return self._with(df)

    def is_na(self) -> Frame:
        """For every value whether it is missing (NaN is)."""
        from slate.functions.scalar import is_na

        return Frame(self.df.select(*[is_na(F.col(f"`{n}`"), t in ("float", "double")).alias(n) for n, t in self.df.dtypes]))

    def ops(self, f: Callable, other: Frame | int | float | None = None) -> Frame:
        """A function of every value, or of every value and the one in the same place of a table with as many columns."""
        names = self.df.columns
        if isinstance(other, Frame):
            if len(other.df.columns) != len(names):
                raise ValueError("both tables need as many columns")
            a, b = (number_rows(t.df.toDF(*[f"{side}{k}" for k in range(len(names))]), [f"{side}{t.df.columns.index(o)}" for o in t.order], "__rn") for side, t in (("a", self), ("b", other)))
            both = a.join(b, "__rn").orderBy("__rn")
            return Frame(both.select(*[f(F.col(f"a{k}"), F.col(f"b{k}")).alias(n) for k, n in enumerate(names)]))
        return Frame(self.df.select(*[(f(F.col(f"`{n}`")) if other is None else f(F.col(f"`{n}`"), F.lit(other))).alias(n) for n in names]))

    def set_index(self, *columns: str) -> Frame:
        """Note that lookups will go by these columns too; without any, forget all such notes. Nothing is sorted."""
        if missing := [c for c in columns if c not in self.df.columns]:
            raise ValueError(f"no column {missing[0]!r}")
        return replace(self, indexes=(*[x for x in self.indexes if x != columns], columns) if columns else ())

    def has_key(self) -> bool:
        return bool(self.key)

    def na_omit(self, columns: Sequence[str] | None = None, invert: bool = False) -> Frame:
        from slate.functions.scalar import any_missing

        gone = any_missing(list(columns or self.df.columns), {n for n, t in self.df.dtypes if t in ("float", "double")})
        return self._with(self.df.where(gone if invert else ~gone))
