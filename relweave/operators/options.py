"""Options as data: dispatch of (operation, argument) pairs to queries, with an allowlist for those from outside.

Boundary mode is for options that a user may send: filters on the root's own fields, order, limit and offset, with plain values
only. Full mode takes every operation. ``includes`` names preloads that the caller allows by ``include``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column

from relweave.errors import BuildError
from relweave.functions.aggregates import Agg
from relweave.functions.refs import Args, FieldRef

BOUNDARY = ("where", "where_any", "order_by", "limit", "offset")
FULL = (
    "where", "where_any", "maybe_where", "where_has", "where_missing", "where_exists_subquery", "where_not_exists_subquery", "where_exists",
    "where_not_exists", "inner_join", "left_join", "left_join_leaf", "left_join_path", "left_join_latest", "left_join_top_n", "select", "select_merge",
    "group_by", "having", "having_any", "distinct", "distinct_roots", "order_by", "maybe_order_by", "limit", "offset", "top_n_per", "first_per",
    "preload_separate", "preload_separate_scoped", "preload_through_join",
)
#: Operations whose argument may be a tuple as data.
TUPLES = ("where", "select", "select_merge", "where_has", "where_missing", "having", "order_by", "distinct")


class Extension:
    """More operations: functions of (query, *arguments). Those named in ``boundary`` may come from outside."""

    def __init__(self, operations: dict[str, Callable] | None = None, boundary: Iterable[str] = ()):
        self.operations, self.boundary = dict(operations or {}), frozenset(boundary)
        if clash := sorted(set(self.operations) & set(FULL)):
            raise BuildError(f"an extension can't replace {', '.join(clash)}")
        if unknown := sorted(self.boundary - set(self.operations)):
            raise BuildError(f"boundary names operations that don't exist: {', '.join(unknown)}")

    def operation(self, function: Callable | None = None, *, boundary: bool = False):
        """Decorator that registers a function under its name."""

        def register(f: Callable) -> Callable:
            if f.__name__ in FULL or f.__name__ in self.operations:
                raise BuildError(f"{f.__name__} exists already")
            self.operations[f.__name__] = f
            if boundary:
                self.boundary |= {f.__name__}
            return f

        return register(function) if function else register


def _pairs(options: Any) -> list[tuple[str, Any]]:
    if isinstance(options, dict):
        return list(options.items())
    if isinstance(options, list) and all(isinstance(x, tuple) and len(x) == 2 and isinstance(x[0], str) for x in options):
        return options
    raise BuildError(f"options are a dict or a list of (operation, argument) pairs, got {options!r}")


def _plain(value: Any, what: str) -> None:
    """Raises unless the value is made of constants."""
    from relweave.operators.query import Query

    if isinstance(value, dict):
        [_plain(x, what) for kv in value.items() for x in kv]
    elif isinstance(value, list | tuple):
        [_plain(x, what) for x in value]
    elif isinstance(value, Agg | FieldRef | Column | Query | Args) or callable(value):
        raise BuildError(f"{what}: {value!r} is not allowed in options from outside")


def _boundary(op: str, value: Any) -> None:
    _plain(value, op)
    if op in ("limit", "offset"):
        if isinstance(value, str):
            value = int(value) if value.strip().isdigit() else -1
        if isinstance(value, bool) or not isinstance(value, int) or value < 0:
            raise BuildError(f"{op} is a whole number of 0 or more")
        return
    from relweave.functions.filters import entries, groups

    if op == "order_by":
        named = [t[1] for t in (value if isinstance(value, list) else list(value.items()) if isinstance(value, dict) else [value]) if isinstance(t, tuple) and len(t) == 2]
    else:
        found = entries(value) if op == "where" else [e for g in groups(value, op) for e in g]
        if not all(isinstance(e, tuple) and e for e in found):
            raise BuildError(f"{op}: filters are tuples")
        named = [e[0] for e in found]
    for t in named:
        if not isinstance(t, str) or "@" in t:
            raise BuildError(f"{op}: only the root's own fields may be named from outside, not {t!r}")


def _include(query, wanted: Any, includes: dict):
    allowed: dict[str, Any] = {}
    for k, v in includes.items():
        if callable(v) or not isinstance(k, str):
            raise BuildError("includes maps names to preloads")
        allowed[k] = v
    names = [wanted] if isinstance(wanted, str) else wanted
    if not isinstance(names, list | tuple) or not all(isinstance(n, str) for n in names):
        raise BuildError(f"include takes names, got {wanted!r}")
    for name in dict.fromkeys(names):
        if name not in allowed:
            raise BuildError(f"include: {name!r} is not allowed; allowed are {', '.join(sorted(allowed)) or 'none'}")
        spec = allowed[name]
        if isinstance(spec, tuple) and len(spec) == 2 and isinstance(spec[1], dict) and set(spec[1]) <= {"where", "order_by"}:
            query = query.preload_separate_scoped(spec[0], **spec[1])
        elif isinstance(spec, tuple) and len(spec) == 2 and spec[0] in ("preload_separate", "preload_through_join"):
            query = getattr(query, spec[0])(spec[1])
        else:
            query = query.preload_separate(spec)
    return query


def from_opts(query, options: Any, mode: str = "boundary", includes: dict | None = None, extension: Extension | None = None):
    if mode not in ("boundary", "full"):
        raise BuildError(f"mode is boundary or full, got {mode!r}")
    if options is None:
        return query
    own = extension.operations if extension else {}
    includes_wanted: list = []
    for op, value in _pairs(options):
        if op == "include":
            if includes is None:
                raise BuildError("include needs includes, the preloads that the caller allows")
            includes_wanted += [value] if isinstance(value, str) else value if isinstance(value, list) else [value]
            continue
        if value is None:
            raise BuildError(f"{op}: the argument can't be None")
        known = FULL if mode == "full" else BOUNDARY
        if op not in known and not (op in own and (mode == "full" or op in extension.boundary)):
            raise BuildError(f"unknown operation {op!r}" if mode == "full" or op not in FULL else f"{op} is not allowed in boundary mode")
        if mode == "boundary":
            if isinstance(value, Args):
                raise BuildError(f"{op}: args() is for full mode")
            if op in BOUNDARY:
                _boundary(op, value)
            else:
                _plain(value, op)
        if isinstance(value, tuple) and op in FULL and op not in TUPLES:
            raise BuildError(f"{op}: a tuple is data; pack several arguments with args()")
        values = value.values if isinstance(value, Args) else (value,)
        named = values[-1] if op in ("top_n_per", "first_per", "left_join_latest", "left_join_top_n", "where_exists_subquery", "where_not_exists_subquery", "preload_separate_scoped") and isinstance(values[-1], dict) else None
        values = values[:-1] if named is not None else values
        query = own[op](query, *values) if op in own else getattr(query, op)(*values, **(named or {}))
    return _include(query, includes_wanted, includes) if includes_wanted else query
