"""The function registry: a name, its number of arguments, and how its call reads in Spark SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SqlError, semantic


@dataclass(frozen=True)
class Function:
    name: str
    kind: str  # scalar, aggregate or window
    least: int
    most: int | None
    render: Callable[..., str]


FUNCTIONS: dict[str, Function] = {}


def function(names: str, least: int, most: int | None = -1, kind: str = "scalar"):
    """Registers a renderer, from argument texts to text, under each of the names. most: -1 as least."""

    def keep(render: Callable[..., str]):
        for name in names.split():
            FUNCTIONS[name] = Function(name, kind, least, least if most == -1 else most, render)
        return render

    return keep


def alias(names: str, text: str, least: int, most: int | None = -1, kind: str = "scalar") -> None:
    """Registers functions whose call is `text`, a format with {0}, {1}, … or {} for all arguments."""

    def render(*args: str) -> str:
        return text.replace("{}", ", ".join(args)) if "{}" in text else text.format(*args)

    function(names, least, most, kind)(render)


def _load() -> None:
    from . import aggregate, datetime, json, math, string, typing  # noqa: F401


def lookup(name: str) -> Function | None:
    _load()
    return FUNCTIONS.get(name.upper())


def is_registered_function(name: str) -> bool:
    return lookup(name) is not None


def get_registered_functions(kind: str | None = None) -> list[str]:
    _load()
    return sorted(n for n, f in FUNCTIONS.items() if kind in (None, f.kind))


def rendered(name: str, args: list[str]) -> str:
    found = lookup(name)
    if found is None:
        raise SqlError("SQL_UNKNOWN_FUNCTION", f"no function {name}", token=name)
    if len(args) < found.least or found.most is not None and len(args) > found.most:
        raise semantic(f"{name} takes {found.least}{'' if found.most == found.least else ' or more' if found.most is None else f' to {found.most}'} arguments, not {len(args)}")
    return found.render(*args)


def call(name: str, *args: str) -> Column:
    """A Column of a registered function over arguments in Spark SQL text (column names, literals)."""
    return F.expr(rendered(name, [str(a) for a in args]))


def literal(text: str) -> str | None:
    """The value of a Spark SQL string literal, or None if text is something else."""
    m = re.fullmatch(r"'((?:[^'\\]|\\.)*)'", text, re.S)
    return re.sub(r"\\(.)", r"\1", m[1], flags=re.S) if m else None
