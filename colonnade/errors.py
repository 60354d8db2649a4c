"""The kinds of error that operators raise."""

from __future__ import annotations


class ColonnadeError(Exception):
    """Base of all errors raised on purpose."""


class ValidationError(ColonnadeError):
    """A document or file breaks its format."""


class TypeMismatch(ValidationError):
    def __init__(self, column: str, row: int, expected: str, got: str):
        super().__init__(f"{column}[{row}] holds a {got}; the column takes {expected}")


class PrimaryKeyViolation(ColonnadeError):
    def __init__(self, column: str, value: object):
        super().__init__(f"the key column {column} needs a value in every row" if value is None else f"the key {column} = {value!r} is taken")


class UniqueViolation(ColonnadeError):
    def __init__(self, column: str, value: object):
        super().__init__(f"{column} = {value!r} stands in another row, and may not repeat")


class NotNullViolation(ColonnadeError):
    def __init__(self, column: str):
        super().__init__(f"{column} may not be left empty")


class InsertError(ColonnadeError):
    """A row or an operation list has the wrong shape."""


class QueryError(ColonnadeError):
    """A filter, column or option of a query is wrong."""


class StorageError(ColonnadeError):
    """A table or file cannot be read or written."""


class SchemaError(ColonnadeError):
    """A column is added twice or named wrongly."""


class Conflict(ColonnadeError):
    def __init__(self, read: int, current: int):
        super().__init__(f"another writer has published version {current} since version {read} was read; read again and retry")
        self.read, self.current = read, current
