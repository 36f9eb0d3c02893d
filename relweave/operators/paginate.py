"""Pages: keyset cursors and offsets. One look-ahead row tells whether more follows; nothing is counted.

A page is one job where its roots are provably unique (only to-one joins); otherwise keys are found first and rows loaded by
them in a second one. Separate preloads are made for the rows of the page only.
"""

from __future__ import annotations

import base64
import binascii
import datetime
import decimal
import json
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.errors import BuildError, QueryError
from relweave.functions.refs import direction, split_token
from relweave.plans.planner import Planner

DEFAULT_PAGE_SIZE = 100
MAX_CURSOR = 8192
FLIP = {"asc_nulls_first": "desc_nulls_last", "asc_nulls_last": "desc_nulls_first", "desc_nulls_first": "asc_nulls_last", "desc_nulls_last": "asc_nulls_first"}


def default_page_size() -> int:
    return DEFAULT_PAGE_SIZE


@dataclass(frozen=True)
class Page:
    """Entries (dicts), what is needed to go on, how they were found, and in how many jobs."""

    entries: list[dict]
    pagination: dict
    strategy: str
    jobs: int


def encode_cursor(values: dict[str, Any]) -> str:
    def plain(v: Any) -> Any:
        if isinstance(v, datetime.date | datetime.datetime):
            return v.isoformat()
        return str(v) if isinstance(v, decimal.Decimal) else v

    raw = json.dumps({k: plain(v) for k, v in values.items()}, separators=(",", ":")).encode()
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


def decode_cursor(cursor: str | dict) -> dict[str, Any]:
    if isinstance(cursor, dict):
        out = cursor
    elif not isinstance(cursor, str):
        raise BuildError(f"a cursor is a string or a dict, got {cursor!r}")
    else:
        if len(cursor) > MAX_CURSOR:
            raise BuildError(f"the cursor is longer than {MAX_CURSOR} bytes")
        try:
            out = json.loads(base64.b64decode(cursor + "=" * (-len(cursor) % 4), altchars=b"-_", validate=True))
        except (binascii.Error, ValueError, UnicodeDecodeError) as e:
            raise BuildError("the cursor can't be read") from e
    if not isinstance(out, dict) or not all(isinstance(k, str) for k in out):
        raise BuildError("a cursor holds tokens and values")
    return out


def _size(page_size: Any, max_page_size: Any) -> int:
    for what, n in (("page_size", page_size), ("max_page_size", max_page_size)):
        if n is not None and (isinstance(n, bool) or not isinstance(n, int) or n < 1):
            raise BuildError(f"{what} is a whole number of 1 or more, got {n!r}")
    n = DEFAULT_PAGE_SIZE if page_size is None else page_size
    return n if max_page_size is None else min(n, max_page_size)


def _check(query) -> None:
    if not query.schema.primary_key:
        raise QueryError(f"{query.schema.name} has no primary key to page by")
    if query._has("select", "select_merge", "lateral", "group_by"):
        raise QueryError("pages hold whole root rows: no select, grouping or lateral joins")


def effective_order(query) -> list[tuple[str, str]]:
    """Tokens and directions that order pages: the query's, the first of each token, then the key, ascending."""
    out: dict[str, str] = {}
    for op in query.ops:
        if op.kind == "order_by":
            for d, t in op.data["terms"]:
                if not isinstance(t, str):
                    raise QueryError("pages are ordered by tokens, not by functions or aggregates")
                out.setdefault(t, direction(d))
    for k in query.schema.primary_key:
        out.setdefault(k, "asc_nulls_last")
    return [(d, t) for t, d in out.items()]


def _order_assocs(query) -> list:
    """The associations that the query's orders name; they stay when a page's order takes their place."""
    return [op.assocs for op in query.ops if op.kind == "order_by" and op.assocs]


def keyset(order: list[tuple[str, str]], values: dict[str, Any]):
    """Rows after the cursor: OR over positions of equality before and beyond there."""

    def build(resolve) -> Column:
        same: list[Column] = []
        out: list[Column] = []
        for d, t in order:
            c, v = resolve(t), values[t]
            last = d.endswith("last")
            if v is None:
                beyond = None if last else c.isNotNull()
            else:
                beyond = c < v if d.startswith("desc") else c > v
                beyond = beyond | c.isNull() if last else beyond
            if beyond is not None:
                out.append(reduce(lambda a, b: a & b, [*same, beyond]))
            same.append(c.isNull() if v is None else c == v)
        return reduce(lambda a, b: a | b, out) if out else F.lit(False)

    return build


def _typed(value: Any, kind: T.DataType) -> Any:
    if value is None or isinstance(kind, T.StringType):
        return value
    return F.lit(value).cast(kind) if isinstance(value, str) or isinstance(kind, T.DecimalType) else value


def _rows(query, spark: SparkSession, columns: dict[str, str], distinct: bool, n: int, skip: int = 0):
    """The first n rows of root columns and others by token."""
    ops = tuple(op for op in query.ops if op.kind not in ("preload", "limit") and not (op.kind == "offset" and skip))
    base = replace(query, ops=ops).limit(n)
    base = base.offset(skip) if skip else base
    fields = [] if distinct else list(query.registry.frame(spark, query.schema.name).columns if query.registry.schemas.get(query.schema.name) is query.schema else query.schema.read(spark).columns)

    def form(resolve) -> dict[str, Column]:
        return {f: resolve(f) for f in fields} | {k: resolve(t) for k, t in columns.items()}

    base = base.distinct(True) if distinct else base
    return base.select(form).to_df(spark).collect()


def _tree(query, spark: SparkSession):
    stage, _, _ = Planner(query, spark).run()
    return stage


def _strategy(query, stage, order: list[tuple[str, str]]) -> str:
    if any(n.many for n in stage.tree.nodes()) or any(op.kind == "preload" and op.data["how"] == "through_join" for op in query.ops):
        return "keys_first"
    return "cursor_projection" if any(split_token(t)[1] for _, t in order) else "single_query"


def _by_keys(query, spark: SparkSession, keys: list[tuple], graph: bool) -> list[dict]:
    """Entries for keys, in their order: from the root table, or from the whole join graph where a preload needs it."""
    pk = query.schema.primary_key

    def match(resolve) -> Column:
        if len(pk) == 1:
            return resolve(pk[0]).isin([k[0] for k in keys])
        return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [resolve(c) == v for c, v in zip(pk, k, strict=True)]) for k in keys])

    kept = tuple(op for op in query.ops if op.kind not in ("order_by", "limit", "offset")) if graph else tuple(op for op in query.ops if op.kind == "preload")
    found = replace(query, ops=kept).where(match).to_df(spark).collect()
    by = {tuple(r[c] for c in pk): r.asDict(recursive=True) for r in found}
    return [by[k] for k in keys if k in by]


def paginate_cursor(query, spark: SparkSession | None = None, *, page_size: int | None = None, max_page_size: int | None = None, cursor: str | dict | None = None, direction: str = "after") -> Page:
    spark = spark or SparkSession.getActiveSession()
    n = _size(page_size, max_page_size)
    if direction not in ("after", "before"):
        raise BuildError(f"direction is after or before, got {direction!r}")
    _check(query)
    order = effective_order(query)
    travel = [(FLIP[d], t) for d, t in order] if direction == "before" else order
    values = decode_cursor(cursor) if cursor not in (None, "", {}) else None
    stage = _tree(query, spark)
    paged = replace(query, ops=tuple(op for op in query.ops if op.kind != "order_by"))
    if values is not None:
        if set(values) != {t for _, t in order}:
            raise BuildError("the cursor belongs to another order")
        kinds = {t: stage.df.schema[stage.tree.find(t)[0].column(stage.tree.find(t)[1])].dataType for _, t in order}
        paged = paged.where(keyset(travel, {t: _typed(v, kinds[t]) for t, v in values.items()}))
    paged = paged.order_by(_order_assocs(query), travel)
    strategy, pk = _strategy(query, stage, order), query.schema.primary_key
    names = {f"#c{i}": t for i, (_, t) in enumerate(order)}
    rows = _rows(paged, spark, names | {f"#k{i}": k for i, k in enumerate(pk)}, strategy == "keys_first", n + 1)
    more, rows = len(rows) > n, rows[:n]
    rows = rows[::-1] if direction == "before" else rows
    keys = [tuple(r[f"#k{i}"] for i in range(len(pk))) for r in rows]
    if len(set(keys)) < len(keys):
        raise QueryError("a page holds one root twice; order it by fields that a root has once")
    entries, jobs = [{k: v for k, v in r.asDict(recursive=True).items() if k[0] != "#"} for r in rows], 1
    if keys and (strategy == "keys_first" or any(op.kind == "preload" for op in query.ops)):
        graph = any(op.kind == "preload" and op.data["how"] == "through_join" for op in query.ops)
        entries, jobs = _by_keys(query, spark, keys, graph), 2
    at = lambda r: encode_cursor({t: r[c] for c, t in names.items()})
    pagination = {"cursor_direction": direction, "cursor_for_entries_before": at(rows[0]) if rows else None, "cursor_for_entries_after": at(rows[-1]) if rows else None, "has_more_entries": more, "max_page_size": n}
    return Page(entries, pagination, strategy, jobs)


def paginate_offset(query, spark: SparkSession | None = None, *, page_size: int | None = None, max_page_size: int | None = None, **other: Any) -> Page:
    """A page of unique roots at the query's own offset."""
    if other:
        raise BuildError(f"offset pages don't take {', '.join(sorted(other))}")
    spark = spark or SparkSession.getActiveSession()
    n = _size(page_size, max_page_size)
    _check(query)
    order, pk, stage = effective_order(query), query.schema.primary_key, _tree(query, spark)
    skip = ([op.data["n"] for op in query.ops if op.kind == "offset"] or [0])[-1]
    paged = replace(query, ops=tuple(op for op in query.ops if op.kind not in ("order_by", "offset"))).order_by(_order_assocs(query), order)
    single = not any(x.many for x in stage.tree.nodes()) and not any(op.kind == "preload" and op.data["how"] == "through_join" for op in query.ops)
    names = {f"#c{i}": t for i, (_, t) in enumerate(order)}
    rows = _rows(paged, spark, names | {f"#k{i}": k for i, k in enumerate(pk)}, not single, n + 1, skip)
    more, rows = len(rows) > n, rows[:n]
    keys = [tuple(r[f"#k{i}"] for i in range(len(pk))) for r in rows]
    if len(set(keys)) < len(keys):
        raise QueryError("a page holds one root twice; order it by fields that a root has once")
    entries, jobs = [{k: v for k, v in r.asDict(recursive=True).items() if k[0] != "#"} for r in rows], 1
    if keys and (not single or any(op.kind == "preload" for op in query.ops)):
        graph = any(op.kind == "preload" and op.data["how"] == "through_join" for op in query.ops)
        entries, jobs = _by_keys(query, spark, keys, graph), 2
    return Page(entries, {"has_more_entries": more, "max_page_size": n}, "single_query" if single else "keys_first", jobs)
