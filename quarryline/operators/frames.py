"""Window frames that Spark lacks: GROUPS, and EXCLUDE CURRENT ROW."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def groups_frame(df: DataFrame, name: str, agg: Callable[[], Column], partition: list[str], order: list[Column], preceding: int | None, following: int | None) -> DataFrame:
    """df plus `name`: agg over the peer groups from `preceding` before the row's to `following` after it
    (None: unbounded). Both windows share one sort."""
    g = "__group"
    ranked = df.withColumn(g, F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    frame = Window.partitionBy(*partition).orderBy(g).rangeBetween(Window.unboundedPreceding if preceding is None else -preceding, Window.unboundedFollowing if following is None else following)
    return ranked.withColumn(name, agg().over(frame)).drop(g)


def sum_without_row(x: str, partition: list[str], order: list[Column], preceding: int, following: int) -> Column:
    """The sum over a ROWS frame around the row without the row itself; NULL without other values."""
    w = Window.partitionBy(*partition).orderBy(*order)
    sides = [w.rowsBetween(-preceding, -1)] * (preceding > 0) + [w.rowsBetween(1, following)] * (following > 0)
    if not sides:
        return F.lit(None).cast("double")
    n, s = F.lit(0), F.lit(0)
    for side in sides:
        n, s = n + F.count(x).over(side), s + F.coalesce(F.sum(x).over(side), F.lit(0))
    return F.when(n > 0, s)
