"""Three-way merge of rows, and row version hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def three_way_merge(base: DataFrame, local: DataFrame, remote: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of base, local and remote joined on keys, column by column: what only one side has changed is
    taken, what both have changed alike too. `conflict` tells of a column that both changed to
    different values; such a row keeps base's values there."""
    cols = [c for c in base.columns if c not in keys]
    part = lambda df, p: df.select(*keys, *(F.col(c).alias(f"{p}_{c}") for c in cols))
    rows = part(base, "b").join(part(local, "l"), keys, "full").join(part(remote, "r"), keys, "full")
    clash, out = F.lit(False), []
    for c in cols:
        b, mine, theirs = F.col(f"b_{c}"), F.col(f"l_{c}"), F.col(f"r_{c}")
        same, left, right = mine.eqNullSafe(theirs), mine.eqNullSafe(b), theirs.eqNullSafe(b)
        out.append(F.when(same, mine).when(left, theirs).when(right, mine).otherwise(b).alias(c))
        clash = clash | ~(same | left | right)
    return rows.select(*keys, *out, clash.alias("conflict"))


def row_version(df: DataFrame) -> Column:
    """sha256 of a row as JSON, its columns in their order, NULLs kept."""
    return F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)
