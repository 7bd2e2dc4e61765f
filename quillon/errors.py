"""Errors that the library raises before Spark sees a plan."""

from __future__ import annotations


class QuillonError(Exception):
    """Base of all."""


class SchemaError(QuillonError):
    """Columns, types or names don't fit."""


class ColumnNotFound(SchemaError):
    def __init__(self, name: str, columns: list[str]) -> None:
        super().__init__(f"no column {name!r}; there are {', '.join(columns)}")


class TypeMismatch(SchemaError):
    pass


class JoinError(SchemaError):
    pass


class OrderError(QuillonError):
    """A positional operation on rows without an order."""


class SourceError(QuillonError):
    """A file is missing, empty or malformed."""


class UnsupportedExpression(QuillonError):
    pass


class StreamingError(QuillonError):
    """An operation that needs all rows, on a stream."""
