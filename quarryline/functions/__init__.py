"""Scalar, aggregate and window functions by SQL name; each renders its call as Spark SQL text."""

from .registry import Function, call, get_registered_functions, is_registered_function, lookup

__all__ = ["Function", "call", "get_registered_functions", "is_registered_function", "lookup"]
