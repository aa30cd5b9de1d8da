"""String and regular expression functions. Lengths count code points; NULL in, NULL out, but for CONCAT
and CONCAT_WS, which read NULL as an empty text."""

from __future__ import annotations

from ..types import quoted
from .registry import alias, function


@function("SUBSTR SUBSTRING", 2, 3)
def substr(s: str, start: str, n: str | None = None) -> str:
    if n is None:
        return f"substring({s}, CAST({start} AS INT))"
    return f"if({n} < 0, substring({s}, CAST({start} AS INT)), substring({s}, CAST({start} AS INT), CAST({n} AS INT)))"


alias("LENGTH CHAR_LENGTH CHARACTER_LENGTH", "length(CAST({0} AS STRING))", 1)
alias("UPPER UCASE", "upper({0})", 1)
alias("LOWER LCASE", "lower({0})", 1)
alias("REPLACE", "if({1} = '', {0}, replace({0}, {1}, {2}))", 3)
alias("INSTR", "instr(upper({0}), upper({1}))", 2)
alias("REVERSE", "reverse(CAST({0} AS STRING))", 1)
alias("REPEAT", "repeat({0}, greatest(CAST({1} AS INT), 0))", 2)
alias("LEFT", "left({0}, CAST({1} AS INT))", 2)
alias("RIGHT", "right({0}, CAST({1} AS INT))", 2)
alias("UNICODE", "ascii({0})", 1)


def trimmer(side: str):
    return lambda s, chars=None: f"trim({side} FROM {s})" if chars is None else f"trim({side} {chars} FROM {s})"


for _name, _side in {"TRIM": "BOTH", "LTRIM": "LEADING", "RTRIM": "TRAILING"}.items():
    function(_name, 1, 2)(trimmer(_side))


@function("LPAD", 2, 3)
def lpad(s: str, n: str, pad: str = "' '") -> str:
    return f"lpad({s}, CAST({n} AS INT), {pad})"


@function("RPAD", 2, 3)
def rpad(s: str, n: str, pad: str = "' '") -> str:
    return f"rpad({s}, CAST({n} AS INT), {pad})"


@function("CHAR CHR", 1, None)
def char(*codes: str) -> str:
    return f"concat({', '.join(f'char({c})' for c in codes)})"


@function("CONCAT", 1, None)
def concat(*args: str) -> str:
    return "concat(" + ", ".join(f"coalesce(CAST({a} AS STRING), '')" for a in args) + ")"


@function("CONCAT_WS", 2, None)
def concat_ws(sep: str, *args: str) -> str:
    return f"concat_ws({sep}, " + ", ".join(f"coalesce(CAST({a} AS STRING), '')" for a in args) + ")"


@function("QUOTE", 1)
def quote(x: str) -> str:
    number = "'tinyint', 'smallint', 'int', 'bigint', 'float', 'double', 'boolean'"
    escaped = f"concat('\\'', replace(CAST({x} AS STRING), '\\'', '\\'\\''), '\\'')"
    return f"CASE WHEN {x} IS NULL THEN 'NULL' WHEN typeof({x}) IN ({number}) OR typeof({x}) LIKE 'decimal%' THEN CAST({x} AS STRING) ELSE {escaped} END"


@function("LIKE", 2, 3)
def like(s: str, pattern: str, escape: str = "'\\\\'") -> str:
    return f"({s} ILIKE {pattern} ESCAPE {escape})"


@function("GLOB", 2)
def glob(s: str, pattern: str) -> str:
    """`*`, `?`, `[...]` and `[!...]`, case-sensitive."""
    escaped = f"regexp_replace({pattern}, {quoted('([.+^$(){}|' + chr(92) * 2 + '])')}, {quoted(chr(92) * 2 + '$1')})"
    for a, b in (("[!", "[^"), ("*", ".*"), ("?", ".")):
        escaped = f"replace({escaped}, {quoted(a)}, {quoted(b)})"
    return f"({s} RLIKE concat('(?s)^', {escaped}, '$'))"


def folded(pattern: str) -> str:
    return f"concat('(?i)', {pattern})"


@function("REGEXP", 2)
def regexp(pattern: str, s: str) -> str:
    return f"({s} RLIKE {folded(pattern)})"


@function("REGEXP_MATCH", 2)
def regexp_match(pattern: str, s: str) -> str:
    return f"regexp_substr({s}, {folded(pattern)})"


@function("REGEXP_EXTRACT", 2, 3)
def regexp_extract(pattern: str, s: str, group: str = "0") -> str:
    return f"CASE WHEN {s} RLIKE {folded(pattern)} THEN regexp_extract({s}, {folded(pattern)}, {group}) END"


@function("REGEXP_REPLACE", 3, 4)
def regexp_replace(pattern: str, s: str, to: str, limit: str | None = None) -> str:
    """limit: at most so many are replaced, from the left. Needs no Python: what stands before the
    match number limit + 1 is replaced, the rest is kept."""
    if limit is None:
        return f"regexp_replace({s}, {folded(pattern)}, {to})"
    ends = f"regexp_extract_all({s}, {folded(pattern)}, 0)"
    # places where matches end, found one after another
    step = f"aggregate(slice({ends}, 1, greatest(CAST({limit} AS INT), 0)), 1, (p, m) -> CAST(locate(m, {s}, p) + length(m) AS INT))"
    head = f"substring({s}, 1, {step} - 1)"
    return f"CASE WHEN {limit} <= 0 THEN {s} ELSE concat(regexp_replace({head}, {folded(pattern)}, {to}), substring({s}, {step})) END"


@function("REGEXP_LIKE", 2, 3)
def regexp_like(s: str, pattern: str, flags: str = "''") -> str:
    return f"({s} RLIKE concat(if(contains({flags}, 'c'), '', '(?i)'), if(contains({flags}, 'm'), '(?m)', ''), {pattern}))"
