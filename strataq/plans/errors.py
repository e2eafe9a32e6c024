"""Refusals and failures, each with a name that callers can test for."""

from __future__ import annotations


class QueryError(Exception):
    """An invalid or unsupported query: exit code 2."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code
        self.message = message


class DataError(QueryError):
    """Input that can't be read or output that can't be written: exit code 1."""
