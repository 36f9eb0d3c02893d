"""The filter language: entries become columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from relweave.errors import BuildError
from relweave.functions.refs import FieldRef

COMPARISONS = {"equal_to": "eq", "other_than": "ne", "greater_than": "gt", "greater_than_or_equal_to": "ge", "less_than": "lt", "less_than_or_equal_to": "le"}
_ORDER = ("eq", "ne", "gt", "ge", "lt", "le")
_TEXT = ("starts_with", "ends_with", "contains")
Resolve = Callable[[str], Column]


def entries(filters: Any) -> list:
    """A list of entries from a dict, a lone tuple, a function or a list."""
    if filters is None:
        raise BuildError("filters can't be None")
    if isinstance(filters, dict):
        return list(filters.items())
    if isinstance(filters, tuple) or callable(filters):
        return [filters]
    if not isinstance(filters, list):
        raise BuildError(f"filters are a list, a dict or a tuple, got {filters!r}")
    return [e for f in filters for e in (f.items() if isinstance(f, dict) else [f])]


def groups(value: Any, what: str) -> list[list]:
    """Groups of an OR: a list of lists of filters, none empty."""
    if not isinstance(value, list) or not all(isinstance(g, list | dict) for g in value):
        raise BuildError(f"{what} takes a list of lists of filters, got {value!r}")
    out = [entries(g) for g in value]
    if any(not g for g in out):
        raise BuildError(f"{what}: a group is empty")
    return out


def tokens_of(filters: Iterable) -> Iterable[str]:
    """Tokens that filters name, on either side; functions tell none."""
    for e in filters:
        if isinstance(e, tuple) and e and isinstance(e[0], str):
            yield e[0]
            yield from (v.token for v in e[1:] if isinstance(v, FieldRef))


def all_of(filters: Any, resolve: Resolve, cast: Callable | None = None) -> Column:
    found = [one(e, resolve, cast) for e in entries(filters)]
    return reduce(lambda a, b: a & b, found) if found else F.lit(True)


def any_of(groups_: Iterable[list], resolve: Resolve, cast: Callable | None = None) -> Column | None:
    """OR of the groups that aren't empty; None if all are."""
    found = [all_of(g, resolve, cast) for g in groups_ if g]
    return reduce(lambda a, b: a | b, found) if found else None


def one(entry: Any, resolve: Resolve, cast: Callable | None = None) -> Column:
    """cast(token, value): the value as the field's type takes it."""
    from relweave.functions.aggregates import Agg

    if callable(entry):
        return entry(resolve)
    if not isinstance(entry, tuple) or not 2 <= len(entry) <= 4:
        raise BuildError(f"a filter is (token, value), (token, operator, value), (token, operator, value, options) or a function, got {entry!r}")
    if isinstance(entry[0], Agg):
        raise BuildError("an aggregate can't be filtered by where; use having")
    token, op, value, options = (entry[0], "eq", entry[1], {}) if len(entry) == 2 else (*entry, {}) if len(entry) == 3 else entry
    op, options = COMPARISONS.get(op, op), dict(options or {})
    left = resolve(token)
    if isinstance(value, FieldRef):
        return _by_field(left, op, resolve(value.token), options)
    if isinstance(value, Agg):
        raise BuildError("an aggregate can't be a filter's value")
    cast = cast or (lambda _, v: v)
    if op in _TEXT:
        return _text(left, op, value, options)
    if options:
        raise BuildError(f"operator {op!r} takes no options, got {options!r}")
    if op in _ORDER:
        if value is None:
            if op not in ("eq", "ne"):
                raise BuildError(f"{op} can't be compared with None")
            return left.isNull() if op == "eq" else left.isNotNull()
        return getattr(left, f"__{op}__")(F.lit(cast(token, value)))
    if op in ("in", "not_in"):
        return _membership(left, op, value, lambda v: cast(token, v))
    if op == "include":
        return F.array_contains(left, cast(token, value))
    if op == "exclude":
        return ~F.array_contains(left, cast(token, value))
    if op in ("like", "ilike"):
        return getattr(left, op)(value)
    raise BuildError(f"unknown operator {op!r} in {entry!r}")


def _membership(left: Column, op: str, value: Any, cast: Callable) -> Column:
    from relweave.operators.query import Query

    if isinstance(value, Query):
        df = value.to_df()
        if len(df.columns) != 1:
            raise BuildError(f"{op}: a subquery must select one field, this one has {len(df.columns)}")
        found = left.isin(df)
    elif isinstance(value, list | tuple | set):
        found = left.isin([cast(v) for v in value])
    else:
        raise BuildError(f"{op} takes a list or a query, got {value!r}")
    return found if op == "in" else ~found


def _insensitive(options: dict) -> bool:
    case = options.pop("case", "sensitive")
    if options or case not in ("sensitive", "insensitive", "i"):
        raise BuildError(f"text search takes case: sensitive, insensitive or i; got {options or case!r}")
    return case != "sensitive"


def _text(left: Column, op: str, value: Any, options: dict) -> Column:
    if not isinstance(value, str):
        raise BuildError(f"{op} takes a string, got {value!r}")
    if _insensitive(options):
        left, value = F.lower(left), value.lower()
    return {"starts_with": left.startswith, "ends_with": left.endswith, "contains": left.contains}[op](value)


def _by_field(left: Column, op: str, right: Column, options: dict) -> Column:
    if op in _TEXT:
        # The field's % and _ are wildcards, its backslashes are literal; null counts as the empty string.
        right = F.replace(right.cast("string"), F.lit("\\"), F.lit("\\\\"))
        pattern = F.concat_ws("", *([F.lit("%")] if op != "starts_with" else []), right, *([F.lit("%")] if op != "ends_with" else []))
        return F.ilike(left, pattern) if _insensitive(options) else F.like(left, pattern)
    if options or op not in _ORDER:
        raise BuildError(f"operator {op!r} can't compare two fields" + (" with options" if options else ""))
    return getattr(left, f"__{op}__")(right)
