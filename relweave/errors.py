"""Errors of this package; all are ValueErrors."""


class BuildError(ValueError):
    """A query is put together wrongly."""


class QueryError(BuildError):
    """A query can't be compiled."""
