"""Aggregates as values, turned into columns when a query is compiled."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from relweave.errors import BuildError
from relweave.functions.filters import COMPARISONS, all_of
from relweave.functions.refs import direction, split_token

MAX_ORDER_TERMS = 5


@dataclass(frozen=True)
class Agg:
    kind: str
    token: str | None = None
    distinct: bool = False
    order_by: tuple = ()
    where: Any = field(default=None, hash=False, compare=False)

    @property
    def tokens(self) -> list[str]:
        return [t for t in (self.token, *(t for _, t in self.order_by)) if isinstance(t, str)]


def count(token: str | None = None, modifier: str | None = None) -> Agg:
    if modifier not in (None, "distinct"):
        raise BuildError(f"count knows the modifier 'distinct' only, not {modifier!r}")
    if modifier and token is None:
        raise BuildError("a distinct count needs a field")
    return Agg("count", token, modifier == "distinct")


def count_distinct(token: str) -> Agg:
    return count(token, "distinct")


def avg(token: str) -> Agg:
    return Agg("avg", token)


def sum_(token: str) -> Agg:
    return Agg("sum", token)


def min_(token: str) -> Agg:
    return Agg("min", token)


def max_(token: str) -> Agg:
    return Agg("max", token)


def array_agg(token: str, *, distinct: bool = False, order_by: list | tuple = (), filter: Any = None) -> Agg:  # noqa: A002
    """All values of a group, nulls too, as an array; null for a group without rows. order_by: (direction, token or function)."""
    split_token(token)
    if not isinstance(distinct, bool):
        raise BuildError("array_agg: distinct must be true or false")
    if not isinstance(order_by, list | tuple) or len(order_by) > MAX_ORDER_TERMS:
        raise BuildError(f"array_agg: order_by takes a list of at most {MAX_ORDER_TERMS} terms")
    for term in order_by:
        if not isinstance(term, tuple) or len(term) != 2:
            raise BuildError(f"array_agg: order_by takes (direction, token) pairs, got {term!r}")
        direction(term[0])
        if isinstance(term[1], Agg):
            raise BuildError("array_agg: an aggregate can't order another")
        if distinct and term[1] != token:
            raise BuildError("array_agg: distinct values can only be ordered by themselves")
    if filter is not None and not isinstance(filter, list | tuple | dict) and not callable(filter):
        raise BuildError("array_agg: filter takes filters or a function")
    return Agg("array_agg", token, distinct, tuple(order_by), filter)


def aggregate_column(agg: Agg, resolve: Callable[[str], Column], cast: Callable | None = None) -> Column:
    x = resolve(agg.token) if agg.token else None
    if agg.kind == "array_agg":
        return _array_agg(agg, x, resolve, cast)
    if agg.kind == "count":
        return F.count("*") if x is None else F.count_distinct(x) if agg.distinct else F.count(x)
    return {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[agg.kind](x)


def _array_agg(agg: Agg, x: Column, resolve: Callable[[str], Column], cast: Callable | None) -> Column:
    """Values travel in structs, which collecting keeps even where they are null, with the keys that order them."""
    terms = [(direction(d), resolve(t) if isinstance(t, str) else t(resolve)) for d, t in agg.order_by]
    row = F.struct(x.alias("v"), *[] if agg.distinct else [k.alias(f"k{i}") for i, (_, k) in enumerate(terms)])
    if agg.where is not None:
        row = F.when(all_of(agg.where, resolve, cast), row)
    rows = F.collect_set(row) if agg.distinct else F.collect_list(row)
    if terms:
        keys = [(d, "v" if agg.distinct else f"k{i}") for i, (d, _) in enumerate(terms)]

        def compare(a: Column, b: Column) -> Column:
            out = F.lit(0)
            for d, k in reversed(keys):
                down, first = d.startswith("desc"), d.endswith("first")
                null = F.when(a[k].isNull() & b[k].isNull(), out).when(a[k].isNull(), F.lit(-1 if first else 1)).when(b[k].isNull(), F.lit(1 if first else -1))
                out = null.when(a[k] < b[k], F.lit(1 if down else -1)).when(a[k] > b[k], F.lit(-1 if down else 1)).otherwise(out)
            return out

        rows = F.array_sort(rows, compare)
    return F.when(F.size(rows) > 0, F.transform(rows, lambda r: r["v"]))


def having_column(entry: Any, agg_column: Callable[[Agg], Column], resolve: Callable[[str], Column]) -> Column:
    """One HAVING filter on an aggregate: (agg, value) or (agg, operator, value)."""
    agg, *rest = entry
    op, value = ("eq", rest[0]) if len(rest) == 1 else rest if len(rest) == 2 else (None, None)
    if op is None:
        raise BuildError(f"an aggregate filter is (aggregate, operator, value) without options, got {entry!r}")
    left = agg_column(agg)
    op = COMPARISONS.get(op, op)
    if op in ("in", "not_in"):
        if not isinstance(value, list | tuple):
            raise BuildError(f"{op} on an aggregate takes a list")
        return left.isin(list(value)) if op == "in" else ~left.isin(list(value))
    if op not in ("eq", "ne", "gt", "ge", "lt", "le"):
        raise BuildError(f"unsupported aggregate filter {entry!r}")
    if value is None:
        if op not in ("eq", "ne"):
            raise BuildError(f"{op} can't be compared with None")
        return left.isNull() if op == "eq" else left.isNotNull()
    return getattr(left, f"__{op}__")(value)
