"""Errors of the engine, by code."""

from __future__ import annotations


class EngineError(Exception):
    """An error with a code and optional details (token, hint, dialect, kind)."""

    def __init__(self, code: str, message: str, **details):
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.details = code, message, details


class SqlError(EngineError):
    """The text is no statement of the dialect."""


class ConstraintError(EngineError):
    """A write breaks a constraint; details has its kind and name."""

    def __init__(self, kind: str, message: str, **details):
        super().__init__("CONSTRAINT_VIOLATION", message, kind=kind, **details)


class TransactionError(EngineError):
    def __init__(self, message: str):
        super().__init__("TRANSACTION_STATE", message)


class PrivilegeError(EngineError):
    def __init__(self, message: str):
        super().__init__("PERMISSION_DENIED", message)


class ConflictError(EngineError):
    """Two writers met; details has table, object, expected, actual and strategy."""

    def __init__(self, message: str, **details):
        super().__init__("OPTIMISTIC_CONFLICT", message, **details)


def syntax(message: str, **details) -> SqlError:
    return SqlError("SQL_SYNTAX_ERROR", message, **details)


def order(message: str, **details) -> SqlError:
    return SqlError("SQL_SYNTAX_INVALID_CLAUSE_ORDER", message, **details)


def incomplete(message: str, **details) -> SqlError:
    return SqlError("SQL_SYNTAX_INCOMPLETE_STATEMENT", message, **details)


def dialect_error(message: str, **details) -> SqlError:
    return SqlError("SQL_DIALECT_UNSUPPORTED_SYNTAX", message, **details)


def semantic(message: str, **details) -> SqlError:
    return SqlError("SQL_SEMANTIC_ERROR", message, **details)
