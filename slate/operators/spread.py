"""Ordered work on groups of any size: a group is cut into sorted ranges, and what a range ends with goes on to the next one."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slate.sources.staged import save


def _same(by: Sequence[str], other: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"`{other}{c}`")) for c in by], F.col("__part") == F.col(f"{other}part"))


def carry_last(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """``df`` with the last value that isn't missing at or before each row of its group, in a total order."""
    return _carry(df, by, order, value, name, lambda v: F.last(v, ignorenulls=True), F.coalesce)


def carry_least(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: Column, name: str, most: bool = False) -> DataFrame:
    """``df`` with the value, a struct or missing, whose field ``by`` is least (or ``most``) at or before each row of its group."""

    def both(here: Column, carried: Column) -> Column:
        better = here["by"] >= carried["by"] if most else here["by"] <= carried["by"]
        return F.when(carried.isNull() | better, here).otherwise(carried)

    return _carry(df, by, order, value, name, lambda v: (F.max_by if most else F.min_by)(v, v["by"]), both)


def _carry(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: Column, name: str, fold: Callable[[Column], Column], both: Callable[[Column, Column], Column]) -> DataFrame:
    """The values at or before each row folded into one; ``fold`` passes missing ones over, ``both`` joins a range's own with what came before.

    The rows are sorted by (group, order) into ranges and saved. Windows stay within a range; the few groups that reach over
    several ranges carry one value from each to the later ones. So no task holds more than a range, whatever key is hot.
    """
    keys = [F.col(f"`{c}`") for c in by]
    sorted_rows = df.withColumn("__v", F.struct(value.alias("v"))).repartitionByRange(*keys, *order)
    parts = save(sorted_rows.withColumn("__part", F.spark_partition_id()))
    w = Window.partitionBy("__part", *keys).orderBy(*order)
    known = F.when(F.col("__v.v").isNotNull(), F.col("__v.v"))
    here = parts.withColumn("__here", fold(known).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = here.withColumn("__end", F.lead(F.lit(1)).over(w).isNull()).where("__end").select("__part", *keys, "__here")
    spans = ends.groupBy(*keys).agg(F.min("__part").alias("__lo"), F.max("__part").alias("__hi")).where("__lo < __hi")
    # Two groups a range at most reach over its ends.
    spans = spans.select(*[F.col(f"`{c}`").alias(f"__s_{c}") for c in by], F.col("__lo").alias("__s_lo"))
    test = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"`__s_{c}`")) for c in by], F.lit(True))
    across = ends.join(spans, test, "left_semi") if by else ends
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = save(across.select(F.col("__part").alias("__c_part"), *[F.col(f"`{c}`").alias(f"__c_{c}") for c in by], fold(F.col("__here")).over(before).alias("__c_value")))
    joined = here.join(carried, _same(by, "__c_"), "left")
    return joined.withColumn(name, both(F.col("__here"), F.col("__c_value"))).drop("__v", "__part", "__here", "__c_part", "__c_value", *[f"__c_{c}" for c in by])
