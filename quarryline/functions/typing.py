"""Type and system functions."""

from __future__ import annotations

import re

from ..errors import semantic
from ..types import quoted
from .registry import alias, function, literal

#: Spark's type names by storage class.
CLASSES = {"integer": ("tinyint", "smallint", "int", "bigint", "boolean"), "real": ("float", "double"), "text": ("string",), "blob": ("binary",)}


@function("TYPEOF", 1)
def typeof(x: str) -> str:
    cases = " ".join(f"WHEN typeof({x}) IN ({', '.join(map(quoted, names))}) THEN '{kind}'" for kind, names in CLASSES.items())
    return f"CASE WHEN {x} IS NULL THEN 'null' {cases} WHEN typeof({x}) LIKE 'decimal%' THEN 'real' ELSE 'text' END"


alias("HEX", "hex({0})", 1)


@function("PRINTF FORMAT", 1, None)
def printf(fmt: str, *args: str) -> str:
    """%d %i %s %f %x %X %%, with flags, width and precision."""
    said = literal(fmt)
    if said is None:
        return f"format_string({', '.join((fmt, *args))})"
    todo, out, cast = list(args), [], {"d": "BIGINT", "i": "BIGINT", "x": "BIGINT", "X": "BIGINT", "f": "DOUBLE", "s": "STRING"}

    def one(m: re.Match) -> str:
        if m[2] == "%":
            return "%%"
        if m[2] not in cast or not todo:
            raise semantic(f"PRINTF has no argument or meaning for %{m[2]}")
        out.append(f"CAST({todo.pop(0)} AS {cast[m[2]]})")
        return f"%{m[1]}{'d' if m[2] == 'i' else m[2]}"

    said = re.sub(r"%([-+ 0,#]*\d*(?:\.\d+)?)([A-Za-z%])", one, said)
    return f"format_string({', '.join((quoted(said), *out))})"


#: The engine replaces these by its session's counters; by themselves they are 0.
COUNTERS = ("CHANGES", "TOTAL_CHANGES", "LAST_INSERT_ROWID", "TXN_CURRENT", "TXN_DIFFERENCE")
for _name in COUNTERS:
    alias(_name, "0", 0, None)
alias("ROWID OID", "CAST(NULL AS BIGINT)", 0)
alias("SQLITE_VERSION", "'3.45.0'", 0)
alias("SQLITE_SOURCE_ID", "'2024-01-15 00:00:00'", 0)
