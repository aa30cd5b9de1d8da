"""SQL type names, their Spark types, and casts that give NULL where a value doesn't fit."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .errors import syntax

#: Other names of a type.
ALIASES = {
    "INTEGER": "INT", "TINYINT": "SMALLINT", "NUMERIC": "DECIMAL", "DEC": "DECIMAL", "REAL": "DOUBLE", "DOUBLE PRECISION": "DOUBLE",
    "STRING": "TEXT", "CLOB": "TEXT", "NCLOB": "TEXT", "CHARACTER": "CHAR", "NCHAR": "CHAR", "NATIONAL CHARACTER": "CHAR", "NATIONAL CHAR": "CHAR",
    "CHARACTER VARYING": "VARCHAR", "CHAR VARYING": "VARCHAR", "NVARCHAR": "VARCHAR", "NATIONAL CHARACTER VARYING": "VARCHAR", "NATIONAL CHAR VARYING": "VARCHAR",
    "BOOL": "BOOLEAN", "DATETIME": "TIMESTAMP", "DATETIME2": "TIMESTAMP", "TIMESTAMP WITHOUT TIME ZONE": "TIMESTAMP", "TIMESTAMP WITH TIME ZONE": "TIMESTAMP_TZ",
    "TIME WITHOUT TIME ZONE": "TIME", "TIME WITH TIME ZONE": "TIME_TZ", "VARBINARY": "BLOB", "BINARY": "BLOB", "BYTEA": "BLOB", "BIT VARYING": "BIT_VARYING",
    "UNSIGNED": "U64", "SIGNED": "BIGINT", "LONG": "BIGINT", "NONE": "TEXT",
}

#: Spark's type of each.
SPARK = {
    "NULL": "void", "SMALLINT": "smallint", "INT": "int", "BIGINT": "bigint", "U64": "decimal(20,0)", "FLOAT": "double", "DOUBLE": "double", "CHAR": "string",
    "VARCHAR": "string", "TEXT": "string", "DATE": "date", "TIME": "string", "TIME_TZ": "string", "TIMESTAMP": "timestamp", "TIMESTAMP_TZ": "timestamp",
    "INTERVAL": "interval day to second", "BOOLEAN": "boolean", "BLOB": "binary", "BIT": "string", "BIT_VARYING": "string", "XML": "string",
}

INTEGERS = {"SMALLINT", "INT", "BIGINT"}


@dataclass(frozen=True)
class SqlType:
    name: str
    params: tuple[int, ...] = field(default=())

    @property
    def spark(self) -> str:
        if self.name == "DECIMAL":
            p, s = (*self.params, 0)[:2] if self.params else (38, 0)
            return f"decimal({p},{s})"
        return SPARK[self.name]

    def __str__(self) -> str:
        return self.name + (f"({','.join(map(str, self.params))})" if self.params else "")


def parse_type(text: str) -> SqlType:
    """A SqlType from its SQL text, as `DECIMAL(10, 2)` or `character varying(20)`."""
    m = re.fullmatch(r"\s*([A-Za-z_][A-Za-z0-9_ ]*?)\s*(?:\(([\d\s,]+)\))?((?:\s+[A-Za-z]+)*)\s*", text)
    if not m:
        raise syntax(f"no type: {text}", token=text)
    name = " ".join((m[1] + (m[3] or "")).upper().split())
    name = ALIASES.get(name, name)
    if name not in SPARK and name != "DECIMAL":
        raise syntax(f"unknown type {text}", token=text)
    params = tuple(int(x) for x in m[2].split(",")) if m[2] else ()
    if name == "CHAR" and not params:
        params = (1,)
    return SqlType(name, params)


def quoted(s: str) -> str:
    """A Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def cast_sql(x: str, kind: SqlType) -> str:
    """Spark SQL text that converts x: NULL where the value doesn't fit, fractions cut for integers."""
    s, name = f"CAST({x} AS STRING)", kind.name
    if name in INTEGERS:
        return f"coalesce(try_cast({x} AS {kind.spark}), try_cast(try_cast({s} AS DOUBLE) AS {kind.spark}))"
    if name == "U64":
        return f"nullif(greatest(try_cast({x} AS DECIMAL(20,0)), CAST(-1 AS DECIMAL(20,0))), CAST(-1 AS DECIMAL(20,0)))"
    if name == "DECIMAL":  # a value that would be rounded is rejected
        return f"CASE WHEN try_cast({x} AS {kind.spark}) = try_cast({x} AS DECIMAL(38,18)) THEN try_cast({x} AS {kind.spark}) END"
    if name in ("FLOAT", "DOUBLE"):
        return f"nullif(nullif(nullif(try_cast({x} AS DOUBLE), double('NaN')), double('Infinity')), double('-Infinity'))"
    if name == "CHAR":
        return f"CASE WHEN length({s}) <= {kind.params[0]} THEN rpad({s}, {kind.params[0]}) END"
    if name == "VARCHAR":
        return f"CASE WHEN length({s}) <= {(kind.params or (255,))[0]} THEN {s} END"
    if name in ("TEXT", "XML"):
        return s
    if name in ("BIT", "BIT_VARYING"):
        most = f" AND length({s}) <= {kind.params[0]}" if kind.params else ""
        return f"CASE WHEN {s} RLIKE '^[01]*$'{most} THEN {s} END"
    if name == "BOOLEAN":
        return f"CASE lower({s}) WHEN 'true' THEN true WHEN '1' THEN true WHEN 'false' THEN false WHEN '0' THEN false END"
    if name == "DATE":
        return f"CASE WHEN {s} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([ T].*)?$' THEN try_cast({x} AS DATE) END"
    if name == "TIME":
        return f"CASE WHEN {s} RLIKE '^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$' THEN {s} END"
    if name == "TIME_TZ":
        body = "^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]"
        return f"CASE WHEN {s} RLIKE '{body}$' THEN concat({s}, 'Z') WHEN {s} RLIKE '{body}(Z|[+-][0-9]{{2}}:[0-9]{{2}})$' THEN {s} END"
    if name in ("TIMESTAMP", "TIMESTAMP_TZ"):
        return f"date_trunc('SECOND', try_cast({x} AS TIMESTAMP))"
    if name == "BLOB":
        return f"CASE WHEN startswith({s}, 'base64:') THEN try_to_binary(substr({s}, 8), 'base64') WHEN startswith({s}, 'hex:') THEN try_to_binary(substr({s}, 5), 'hex') ELSE CAST({s} AS BINARY) END"
    return f"try_cast({x} AS {kind.spark})"
