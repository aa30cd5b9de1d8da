"""Aggregate and window functions. `over` is what follows the call: FILTER and OVER clauses."""

from __future__ import annotations

from .registry import function


def plain(name: str, spark: str, least: int, most: int | None, kind: str) -> None:
    function(name, least, most, kind)(lambda *args, over="": f"{spark}({', '.join(args)}){over}")


plain("COUNT", "count", 1, None, "aggregate")
plain("SUM", "try_sum", 1, 1, "aggregate")
plain("AVG", "try_avg", 1, 1, "aggregate")
plain("MIN", "min", 1, 1, "aggregate")
plain("MAX", "max", 1, 1, "aggregate")
for _name, _least, _most in (
    ("ROW_NUMBER", 0, 0), ("RANK", 0, 0), ("DENSE_RANK", 0, 0), ("PERCENT_RANK", 0, 0), ("CUME_DIST", 0, 0), ("NTILE", 1, 1), ("LAG", 1, 3), ("LEAD", 1, 3),
    ("FIRST_VALUE", 1, 1), ("LAST_VALUE", 1, 1), ("NTH_VALUE", 2, 2),
):
    plain(_name, _name.lower(), _least, _most, "window")


@function("TOTAL", 1, 1, "aggregate")
def total(x: str, over: str = "") -> str:
    return f"coalesce(sum(try_cast({x} AS DOUBLE)){over}, 0.0D)"


@function("GROUP_CONCAT", 1, 2, "aggregate")
def group_concat(x: str, separator: str = "', '", over: str = "", order: str | None = None) -> str:
    """Texts joined in the given order, or else in their own."""
    text = f"CAST({x} AS STRING)"
    return f"listagg({text}, {separator}) WITHIN GROUP (ORDER BY {order or text}){over}"
