"""Conditional, mathematical and bit functions. Values outside a function's domain give NULL."""

from __future__ import annotations

from .registry import alias, function


def finite(x: str) -> str:
    return f"nullif(nullif(nullif({x}, double('NaN')), double('Infinity')), double('-Infinity'))"


alias("COALESCE", "coalesce({})", 1, None)
alias("NULLIF", "nullif({0}, {1})", 2)
alias("IFNULL ISNULL", "coalesce({0}, {1})", 2)
alias("IIF", "if({0}, {1}, {2})", 3)

alias("ABS", "abs({0})", 1)
alias("CEIL CEILING", "ceil({0})", 1)
alias("FLOOR", "floor({0})", 1)
alias("SIGN", "CAST(sign({0}) AS INT)", 1)
alias("MOD", "try_mod({0}, {1})", 2)
alias("PI", "pi()", 0)
alias("SQUARE", "try_multiply(CAST({0} AS DOUBLE), CAST({0} AS DOUBLE))", 1)
alias("RANDOM", "CAST(floor(rand() * 2147483648D - 1073741824D) AS INT)", 0)
alias("BITAND", "(CAST({0} AS INT) & CAST({1} AS INT))", 2)
alias("BITOR", "(CAST({0} AS INT) | CAST({1} AS INT))", 2)
alias("BITXOR", "(CAST({0} AS INT) ^ CAST({1} AS INT))", 2)
alias("BITNOT", "(~CAST({0} AS INT))", 1)
alias("LSHIFT", "shiftleft(CAST({0} AS INT), CAST({1} AS INT))", 2)
alias("RSHIFT", "shiftright(CAST({0} AS INT), CAST({1} AS INT))", 2)

for _name, _spark in {"SQRT": "sqrt", "EXP": "exp", "SIN": "sin", "COS": "cos", "TAN": "tan", "ASIN": "asin", "ACOS": "acos", "ATAN": "atan", "DEGREES": "degrees", "RADIANS": "radians"}.items():
    alias(_name, finite(f"{_spark}(CAST({{0}} AS DOUBLE))"), 1)
alias("ATAN2", "atan2(CAST({0} AS DOUBLE), CAST({1} AS DOUBLE))", 2)
alias("POW POWER", finite("pow(CAST({0} AS DOUBLE), CAST({1} AS DOUBLE))"), 2)
alias("LN", finite("ln(CAST({0} AS DOUBLE))"), 1)
alias("LOG2", finite("log2(CAST({0} AS DOUBLE))"), 1)
alias("LOG10", finite("log10(CAST({0} AS DOUBLE))"), 1)


@function("LOG", 1, 2)
def log(x: str, base: str | None = None) -> str:
    return finite(f"ln(CAST({x} AS DOUBLE))" if base is None else f"log(CAST({base} AS DOUBLE), CAST({x} AS DOUBLE))")


@function("ROUND", 1, 2)
def round_(x: str, digits: str = "0") -> str:
    return f"round({x}, CAST({digits} AS INT))"


@function("TRUNC TRUNCATE", 1, 2)
def trunc(x: str, digits: str = "0") -> str:
    scale = f"pow(10D, {digits})"
    return f"(sign({x}) * floor(abs(CAST({x} AS DOUBLE)) * {scale}) / {scale})"
