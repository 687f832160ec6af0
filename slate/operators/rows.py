"""Row numbers over a whole table's order, positions of values in a table, and codes of groups and levels.

A window without a partition would bring the table into one task. Here the table is sorted by ranges and saved, each
sorted part counts its own rows, and the parts' offsets (one row for each part) are joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slate.functions.scalar import col
from slate.sources.staged import save

#: monotonically_increasing_id() holds the part above this bit and the row within it below.
_PART_BIT = 33


def number_rows(df: DataFrame, order: Sequence[Column | str], name: str = "row") -> DataFrame:
    """``df`` with row numbers from 1 in a total order. It runs at once, as the sorted rows are saved.

    Rows that tie in ``order`` are numbered in any order among themselves; an empty table stays empty.
    """
    parts = save(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", _PART_BIT)
    sizes = parts.groupBy(part.alias("__part")).agg(F.count("*").alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part of the sort
    offsets = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    inside = F.col("__at").bitwiseAND((1 << _PART_BIT) - 1)
    return parts.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(name, F.col("__offset") + inside + 1).drop("__part", "__at", "__offset")


def match_position(x: DataFrame, column: str, table: DataFrame, table_column: str, order: Sequence[Column | str], name: str = "position") -> DataFrame:
    """x with the first position (from 1, in the table's ``order``) of its value in a table; missing where it isn't there.

    Missing matches missing.
    """
    numbered = number_rows(table.select(F.col(table_column).alias("__value"), *[col(o).alias(f"__o{k}") for k, o in enumerate(order)]), [f"__o{k}" for k in range(len(order))], "__row")
    first = numbered.groupBy("__value").agg(F.min("__row").alias(name))
    return x.join(first, F.col(column).eqNullSafe(F.col("__value")), "left").drop("__value")


def match_position_each(x: DataFrame, column: str, order_x: Sequence[Column | str], table: DataFrame, table_column: str, order: Sequence[Column | str], name: str = "position") -> DataFrame:
    """As ``match_position``, but the k-th row of a value takes the value's k-th position in the table, so none is taken twice."""
    numbered = number_rows(table.select(F.col(table_column).alias("__value"), *[col(o).alias(f"__o{k}") for k, o in enumerate(order)]), [f"__o{k}" for k in range(len(order))], name)
    placed = numbered.select("__value", name, F.row_number().over(Window.partitionBy("__value").orderBy(name)).alias("__k2"))
    counted = x.withColumn("__k", F.row_number().over(Window.partitionBy(column).orderBy(*order_x)))
    return counted.join(placed, F.col(column).eqNullSafe(F.col("__value")) & (F.col("__k") == F.col("__k2")), "left").drop("__value", "__k", "__k2")


def is_sorted(df: DataFrame, columns: Sequence[str], order: Sequence[Column | str], strictly: bool = False) -> bool:
    """Whether, along ``order``, no row (``strictly``: no equal row either) is before the one above it by ``columns``, missing first."""
    numbered = number_rows(df, order, "__place").select("__place", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__now"))
    above = numbered.select((F.col("__place") + 1).alias("__place"), F.col("__now").alias("__above"))
    bad = F.col("__above") >= F.col("__now") if strictly else F.col("__above") > F.col("__now")
    return numbered.join(above, "__place").where(bad).isEmpty()


def group_index(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str = "group") -> DataFrame:
    """A row for each group, numbered from 1 by first appearance in ``order``; the last number is how many there are."""
    firsts = df.groupBy(*by).agg(F.min(F.struct(*[col(o).alias(f"o{k}") for k, o in enumerate(order)])).alias("__first"))
    return number_rows(firsts, ["__first"], name).drop("__first")


def level_codes(df: DataFrame, column: str, name: str = "code", descending: bool = False) -> DataFrame:
    """df with the code (from 1) of each value among the sorted levels that occur; missing has none."""
    levels = df.select(F.col(column).alias("__level")).where("__level is not null").distinct()
    codes = number_rows(levels, [F.desc("__level") if descending else F.asc("__level")], name)
    return df.join(codes, F.col(column) == F.col("__level"), "left").drop("__level")


def in_ranges(x: DataFrame, column: str, ranges: DataFrame, lower: str, upper: str, width: float) -> DataFrame:
    """Rows of x whose value lies in any range, ends included: ranges are dealt to bins of ``width``, x joins its own bin.

    A range with a missing end, or whose ends are the wrong way round, holds nothing; so does a missing value.
    """
    bins = F.sequence(F.floor(F.col(lower) / width), F.floor(F.col(upper) / width))
    dealt = ranges.where(F.col(lower) <= F.col(upper)).select(F.col(lower).alias("__lo"), F.col(upper).alias("__hi"), F.explode(bins).alias("__bin"))
    value = F.col(column)
    return x.join(dealt, (F.floor(value / width) == F.col("__bin")) & (value >= F.col("__lo")) & (value <= F.col("__hi")), "left_semi")
