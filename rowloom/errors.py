"""Errors with the MySQL codes that clients of such tables expect."""

from __future__ import annotations


class TableError(Exception):
    code = 1105


class DuplicateKey(TableError):
    """A live row has the primary key, or the value of a unique index."""

    code = 1062


class Unsupported(TableError):
    code = 1235


class RowTooLarge(TableError):
    code = 1197


class ReadOnly(TableError):
    code = 1290


class NoIndex(TableError):
    """A scan of a large table that nobody has allowed."""


class StaleVersion(TableError):
    """Someone else has committed in between."""


class InvalidDefinition(TableError):
    pass


class NoSuchTable(TableError):
    code = 1146
