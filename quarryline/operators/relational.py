"""Relational operators over DataFrames with this engine's meaning of NULL, order and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import semantic

JOINS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "cross": "cross", "semi": "left_semi", "anti": "left_anti"}


def select(df: DataFrame, *fields: str) -> DataFrame:
    """The named columns; a name that df lacks is a column of NULL."""
    return df.select(*(F.col(f) if f == "*" or f in df.columns else F.lit(None).alias(f) for f in fields))


def join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]] | None = None, how: str = "inner", left_name: str = "l", right_name: str = "r") -> DataFrame:
    """An equi-join on pairs of columns (none: cross). Columns that clash become left_name_column and
    right_name_column; NULL keys match nothing. Catalyst picks broadcast, sort-merge or hash."""
    if how not in JOINS:
        raise semantic(f"no join {how}")
    if how == "cross" or not on:
        out = left.alias("l").crossJoin(right.alias("r"))
    else:
        cond = F.lit(True)
        for a, b in on:
            cond = cond & (F.col(f"l.{a}") == F.col(f"r.{b}"))
        out = left.alias("l").join(right.alias("r"), cond, JOINS[how])
    if how in ("semi", "anti"):
        return out
    clash = set(left.columns) & set(right.columns)
    return out.select(*(F.col(f"l.{c}").alias(f"{left_name}_{c}" if c in clash else c) for c in left.columns), *(F.col(f"r.{c}").alias(f"{right_name}_{c}" if c in clash else c) for c in right.columns))


def using_join(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    return left.join(right, columns, JOINS[how])


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Joins on all columns of the same name, merged; without any it is a cross join."""
    common = [c for c in left.columns if c in right.columns]
    return left.join(right, common, JOINS[how]) if common else left.crossJoin(right)


def sort(df: DataFrame, *keys: str) -> DataFrame:
    """keys: `column [asc|desc] [nulls first|last]`; NULLs last in both directions unless said."""
    out = []
    for key in keys:
        words = key.lower().split()
        c = F.col(key.split()[0])
        down, first = "desc" in words[1:], "first" in words[1:]
        out.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if down else (c.asc_nulls_first() if first else c.asc_nulls_last()))
    return df.orderBy(*out)


def page(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def top_k(df: DataFrame, k: int, *keys: str) -> DataFrame:
    """The first k rows of an order; Spark keeps k rows per task and never sorts the rest."""
    return sort(df, *keys).limit(k)


def total(x: str) -> Column:
    """A sum as DOUBLE that is 0.0 without values."""
    return F.coalesce(F.sum(F.col(x).try_cast("double")), F.lit(0.0))


def group_concat(x: str, separator: str = ", ", order: str | None = None) -> Column:
    """Values as one text in the order given, or else in their own."""
    return F.expr(f"listagg(CAST({x} AS STRING), '{separator}') WITHIN GROUP (ORDER BY {order or x})")


def set_operation(kind: str, left: DataFrame, right: DataFrame, all: bool = False) -> DataFrame:  # noqa: A002
    if kind == "union":
        return left.union(right) if all else left.union(right).distinct()
    if kind == "intersect":
        return left.intersectAll(right) if all else left.intersect(right)
    if kind == "except":
        return left.exceptAll(right) if all else left.subtract(right)
    raise semantic(f"no set operation {kind}")
