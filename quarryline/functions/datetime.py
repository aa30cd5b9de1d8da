"""Date and time functions. A moment is an ISO text, a date or timestamp column, or a Julian day number;
sessions run in UTC."""

from __future__ import annotations

import re

from ..errors import semantic
from ..types import quoted
from .registry import alias, function, literal

UNITS = {"day": "make_dt_interval({})", "month": "make_ym_interval(0, {})", "year": "make_ym_interval({}, 0)"}


def moment(x: str) -> str:
    """A TIMESTAMP from x, or NULL if it is no moment."""
    if (literal(x) or "").lower() == "now":
        return "current_timestamp()"
    s = f"CAST({x} AS STRING)"
    julian = f"timestamp_micros(CAST(round((try_cast({s} AS DOUBLE) - 2440587.5D) * 86400000000D) AS BIGINT))"
    return f"if({s} RLIKE '^[0-9.]+$', {julian}, try_cast(replace({s}, '/', '-') AS TIMESTAMP))"


def modified(x: str, *modifiers: str) -> str:
    """moment(x) after modifiers, which are literals: `start of day|week|month|year`, `±N days|months|years`.
    A week begins on Sunday; months are clamped to their last day; other modifiers do nothing."""
    t = moment(x)
    for text in modifiers:
        said = literal(text)
        if said is None:
            raise semantic(f"a date modifier must be a literal, not {text}")
        said = said.strip().lower()
        if m := re.fullmatch(r"start of (day|month|year)", said):
            t = f"date_trunc('{m[1].upper()}', {t})"
        elif said == "start of week":
            t = f"(date_trunc('DAY', {t}) - make_dt_interval(dayofweek({t}) - 1))"
        elif m := re.fullmatch(r"([+-]?\d+) (day|month|year)s?", said):
            t = f"({t} + {UNITS[m[2]].format(int(m[1]))})"
    return t


def formats(pattern: str):
    return lambda x="'now'", *modifiers: f"date_format({modified(x, *modifiers)}, '{pattern}')"


function("DATE", 0, None)(formats("yyyy-MM-dd"))
function("TIME", 0, None)(formats("HH:mm:ss"))
function("DATETIME", 0, None)(formats("yyyy-MM-dd HH:mm:ss"))


@function("JULIANDAY", 0, None)
def julianday(x: str = "'now'", *modifiers: str) -> str:
    return f"(unix_micros({modified(x, *modifiers)}) / 86400000000D + 2440587.5D)"


#: What a letter after % stands for: a pattern of date_format, or Spark SQL text over {t}.
DIRECTIVES = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "f": "SSSSSS", "j": "DDD"}
COMPUTED = {"w": "CAST(dayofweek({t}) - 1 AS STRING)", "W": "lpad(CAST(floor((dayofyear({t}) + 6 - weekday({t})) / 7) AS STRING), 2, '0')"}


@function("STRFTIME", 1, None)
def strftime(fmt: str, x: str = "'now'", *modifiers: str) -> str:
    said = literal(fmt)
    if said is None:
        raise semantic("the format of STRFTIME must be a literal")
    t, parts = modified(x, *modifiers), []
    for piece in re.findall(r"%.|[^%]+|%", said, re.S):
        if piece[0] == "%" and piece[1:] in DIRECTIVES:
            parts.append(f"date_format({t}, '{DIRECTIVES[piece[1]]}')")
        elif piece[0] == "%" and piece[1:] in COMPUTED:
            parts.append(COMPUTED[piece[1]].format(t=t))
        else:
            parts.append(quoted("%" if piece == "%%" else piece))
    return f"if({t} IS NULL, NULL, concat({', '.join(parts)}))" if parts else "''"


alias("NOW CURRENT_TIMESTAMP", "current_timestamp()", 0)
alias("CURRENT_DATE", "current_date()", 0)
alias("CURRENT_TIME", "date_format(current_timestamp(), 'HH:mm:ss')", 0)
for _name in ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE"):
    function(_name, 1)(lambda x, part=_name.lower(): f"{part}({moment(x)})")


@function("SECOND", 1)
def second(x: str) -> str:
    return f"CAST(extract(SECOND FROM {moment(x)}) AS DOUBLE)"


@function("DATE_TRUNC", 2)
def date_trunc(unit: str, x: str) -> str:
    return f"date_trunc({unit}, {moment(x)})"
