"""Streams. The engine keeps no state of its own: a schema's source may be a streaming DataFrame, and queries made of filters,
joins with static tables, grouping and projections compile to streaming plans unchanged. Ranking, DISTINCT ON, global order,
limits, EXISTS filters, preloads and pages need all rows and are for batches only."""

from __future__ import annotations

from relweave.errors import QueryError

#: Operations that a stream can take.
STREAMABLE = frozenset({"where", "select", "select_merge", "join", "group_by", "having"})


def check_streamable(query) -> None:
    """Raises where a query with a streaming source has operations that need all rows."""
    if bad := sorted({op.kind for op in query.ops} - STREAMABLE):
        raise QueryError(f"not for streams: {', '.join(bad)}")
