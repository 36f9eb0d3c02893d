"""Queries: immutable lists of operations on a schema."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession

from relweave.errors import BuildError, QueryError
from relweave.functions.aggregates import Agg
from relweave.functions.filters import entries, groups
from relweave.functions.refs import FieldRef, direction
from relweave.sources.schema import Registry, Schema


@dataclass(frozen=True)
class Op:
    kind: str
    assocs: Any = None
    data: dict = field(default_factory=dict)


def _order(terms: Any, what: str = "order_by", aggregates: bool = True) -> list[tuple[str, Any]]:
    if terms is None:
        raise BuildError(f"{what} can't be None")
    if isinstance(terms, tuple) and len(terms) == 2 and isinstance(terms[0], str):
        terms = [terms]
    terms = list(terms.items()) if isinstance(terms, dict) else terms
    if not isinstance(terms, list):
        raise BuildError(f"{what} takes a list of (direction, token) pairs, got {terms!r}")
    for t in terms:
        if not isinstance(t, tuple) or len(t) != 2:
            raise BuildError(f"{what}: expected (direction, token), got {t!r}")
        direction(t[0])
        if isinstance(t[1], Agg) and not aggregates:
            raise BuildError(f"{what}: no aggregates here")
        if not isinstance(t[1], str | Agg | Column) and not callable(t[1]):
            raise BuildError(f"{what}: can't order by {t[1]!r}")
    return terms


def _expressions(value: Any, what: str, aggregates: bool = False) -> list:
    if value is None:
        raise BuildError(f"{what} can't be None")
    if isinstance(value, dict):
        raise BuildError(f"{what} takes tokens, not a dict")
    out: list = []
    for x in value if isinstance(value, list) else [value]:
        if isinstance(x, list):
            out += _expressions(x, what, aggregates)
        elif isinstance(x, tuple):
            raise BuildError(f"{what} takes tokens, not pairs: {x!r}")
        elif isinstance(x, Agg) and not aggregates:
            raise BuildError(f"{what}: no aggregates here")
        elif isinstance(x, str | Column) or callable(x):
            out.append(x)
        else:
            raise BuildError(f"{what}: can't use {x!r}")
    return out


def _count(n: Any, what: str) -> int:
    if isinstance(n, str):
        try:
            n = int(n.strip())
        except ValueError:
            raise QueryError(f"{what}: {n!r} is not a whole number") from None
    if isinstance(n, bool) or not isinstance(n, int):
        raise QueryError(f"{what} takes a whole number, got {n!r}")
    if n < 0:
        raise QueryError(f"{what} can't be negative")
    return n


@dataclass(frozen=True)
class Query:
    """A query over a schema of a registry. Every method gives a new query; nothing runs before an action on to_df()."""

    registry: Registry = field(repr=False)
    schema: Schema
    ops: tuple[Op, ...] = ()
    #: Associations that a wrapped frame has joined: path, fields with their columns, primary key.
    bound: tuple = ()

    def _with(self, kind: str, assocs: Any = None, **data: Any) -> Query:
        return replace(self, ops=(*self.ops, Op(kind, assocs, data)))

    def to_df(self, spark: SparkSession | None = None) -> DataFrame:
        from relweave.plans.planner import Planner

        spark = spark or SparkSession.getActiveSession()
        if spark is None:
            raise QueryError("there is no Spark session")
        return Planner(self, spark).compile()

    def _has(self, *kinds: str) -> bool:
        return any(op.kind in kinds for op in self.ops)

    # Filters

    def where(self, *args: Any, or_: list | None = None) -> Query:
        """where(filters) or where(associations, filters, or_=[group, ...]): filters, or any of the groups."""
        if not 1 <= len(args) <= 2:
            raise BuildError("where takes filters, or associations and filters")
        assocs, filters = (None, args[0]) if len(args) == 1 else args
        alternatives = [] if or_ is None else [entries(g) for g in or_] if isinstance(or_, list) and all(isinstance(g, list | dict) for g in or_) else None
        if alternatives is None:
            raise BuildError(f"where: or_ takes a list of groups, got {or_!r}")
        return self._with("where", assocs, groups=[entries(filters), *alternatives])

    def where_any(self, *args: Any) -> Query:
        """where_any(groups) or where_any(associations, groups): all filters of at least one group."""
        if not 1 <= len(args) <= 2:
            raise BuildError("where_any takes groups, or associations and groups")
        assocs, value = (None, args[0]) if len(args) == 1 else args
        found = groups(value, "where_any")
        return self._with("where", assocs, groups=found) if found else self

    def maybe_where(self, condition: bool, *args: Any, or_: list | None = None) -> Query:
        if not isinstance(condition, bool):
            raise BuildError(f"maybe_where takes true or false, got {condition!r}")
        return self.where(*args, or_=or_) if condition else self

    # EXISTS

    def _exists(self, assocs: Any, negated: bool, what: str, scope: Any, where: Any, where_any: Any, strict: bool, scoped: bool) -> Query:
        if not self.schema.primary_key:
            raise QueryError(f"{what}: {self.schema.name} has no primary key")
        if not assocs:
            raise BuildError(f"{what} needs associations")
        if scoped and not isinstance(scope, list):
            raise BuildError(f"{what} needs scope=[...]: the filters that the outer query would not lend")
        parts = {"scope": entries(scope), "where": entries(where if where is not None else []), "where_any": groups(where_any if where_any is not None else [], what)}
        if strict:
            for e in [*parts["scope"], *parts["where"], *[e for g in parts["where_any"] for e in g]]:
                if isinstance(e, tuple) and isinstance(e[0], str) and "@" not in e[0] and not any(isinstance(v, FieldRef) for v in e[1:]):
                    raise BuildError(f"{what}: {e!r} filters the root itself; put it into where(), or name an association with @")
        return self._with("exists", assocs, negated=negated, **parts)

    def where_exists_subquery(self, assocs: Any, *, scope: Any = None, where: Any = None, where_any: Any = None) -> Query:
        return self._exists(assocs, False, "where_exists_subquery", scope, where, where_any, True, True)

    def where_not_exists_subquery(self, assocs: Any, *, scope: Any = None, where: Any = None, where_any: Any = None) -> Query:
        return self._exists(assocs, True, "where_not_exists_subquery", scope, where, where_any, False, True)

    def where_has(self, assocs: Any, filters: Any = ()) -> Query:
        return self._exists(assocs, False, "where_has", [], list(filters) if filters == () else filters, None, True, False)

    def where_missing(self, assocs: Any, filters: Any = ()) -> Query:
        return self._exists(assocs, True, "where_missing", [], list(filters) if filters == () else filters, None, True, False)

    def where_exists(self, *_: Any, **__: Any) -> Query:
        raise BuildError("where_exists is gone; use where_exists_subquery with scope=[...]")

    def where_not_exists(self, *_: Any, **__: Any) -> Query:
        raise BuildError("where_not_exists is gone; use where_not_exists_subquery with scope=[...]")

    # Joins

    def join_neutral(self, assocs: Any) -> Query:
        return self._with("join", assocs, each="any", leaf=None, on=None) if assocs else self

    def inner_join(self, assocs: Any) -> Query:
        return self._with("join", assocs, each="inner", leaf=None, on=None)

    def _left(self, what: str, assocs: Any, each: str, filters: Any, or_: list | None) -> Query:
        from relweave.plans.tree import parse_paths

        def chain(items: list) -> int:
            if len(items) != 1:
                raise BuildError(f"{what} takes one path of associations, got {assocs!r}")
            return 1 + (chain(items[0][1]) if items[0][1] else 0)

        if chain(parse_paths(assocs)) > 1 and what == "left_join":
            raise BuildError("left_join takes an association of the root; use left_join_leaf or left_join_path for nested ones")
        own = entries([] if filters is None else filters)
        alternatives = [entries(g) for g in or_ or []]
        on = (own, alternatives) if own or any(alternatives) else None
        return self._with("join", assocs, each=each, leaf="left", on=on)

    def left_join(self, assocs: Any, filters: Any = None, *, or_: list | None = None) -> Query:
        return self._left("left_join", assocs, "left", filters, or_)

    def left_join_leaf(self, assocs: Any, filters: Any = None, *, or_: list | None = None) -> Query:
        return self._left("left_join_leaf", assocs, "inner", filters, or_)

    def left_join_path(self, assocs: Any, filters: Any = None, *, or_: list | None = None) -> Query:
        return self._left("left_join_path", assocs, "left", filters, or_)

    def _lateral(self, what: str, assocs: Any, order_by: Any, n: Any, where: Any, child_assoc_fields: Any) -> Query:
        if isinstance(n, bool) or not isinstance(n, int) or n < 1:
            raise BuildError(f"{what}: n must be 1 or more, got {n!r}")
        if where is None:
            raise BuildError(f"{what}: where can't be None")
        if self._has("lateral"):
            raise BuildError(f"{what}: only one lateral helper a query")
        if self._has("select", "select_merge"):
            raise BuildError(f"{what} selects root and child itself, so it can't follow a select")
        terms = _order(order_by, what, aggregates=False)
        if not terms:
            raise BuildError(f"{what}: order_by is needed")
        return self._with("lateral", assocs, order_by=terms, n=n, where=entries(where), child_assocs=child_assoc_fields)

    def left_join_latest(self, assocs: Any, *, order_by: Any, where: Any = (), child_assoc_fields: Any = None) -> Query:
        return self._lateral("left_join_latest", assocs, order_by, 1, list(where) if where == () else where, child_assoc_fields)

    def left_join_top_n(self, assocs: Any, *, n: int, order_by: Any, where: Any = (), child_assoc_fields: Any = None) -> Query:
        return self._lateral("left_join_top_n", assocs, order_by, n, list(where) if where == () else where, child_assoc_fields)

    # Projection

    def select(self, *args: Any) -> Query:
        assocs, form = self._form("select", args)
        if self._has("select"):
            raise BuildError("a query has one select; use select_merge to add columns")
        if self._has("select_merge", "lateral"):
            raise BuildError("select can't follow select_merge or a lateral helper")
        return self._with("select", assocs, form=form)

    def select_merge(self, *args: Any) -> Query:
        assocs, form = self._form("select_merge", args)
        if self._has("lateral"):
            raise BuildError("select_merge can't follow a lateral helper")
        if isinstance(form, list) and len(set(form)) < len(form):
            raise BuildError(f"select_merge: {form!r} names a token twice")
        return self._with("select_merge", assocs, form=form)

    @staticmethod
    def _form(what: str, args: tuple) -> tuple[Any, Any]:
        if not 1 <= len(args) <= 2 or args[-1] is None:
            raise BuildError(f"{what} takes columns, or associations and columns")
        return (None, args[0]) if len(args) == 1 else args

    # Grouping

    def group_by(self, *args: Any) -> Query:
        assocs, keys = (None, args[0]) if len(args) == 1 else args
        found = _expressions(keys, "group_by")
        return self._with("group_by", assocs, keys=found) if found else self

    def having(self, *args: Any, or_: list | None = None) -> Query:
        assocs, filters = (None, args[0]) if len(args) == 1 else args
        return self._with("having", assocs, groups=[self._having_entries(filters), *[self._having_entries(g) for g in or_ or []]])

    def having_any(self, *args: Any) -> Query:
        assocs, value = (None, args[0]) if len(args) == 1 else args
        found = groups(value, "having_any")
        return self._with("having", assocs, groups=found) if found else self

    @staticmethod
    def _having_entries(filters: Any) -> list:
        return entries(filters)

    # Distinct

    def distinct(self, *args: Any) -> Query:
        assocs, on = (None, args[0]) if len(args) == 1 else args
        if on is None:
            raise BuildError("distinct can't be None")
        if isinstance(on, bool):
            return self._with("distinct", assocs, on=on)
        if isinstance(on, tuple):
            on = [on]
        items = list(on.items()) if isinstance(on, dict) else on if isinstance(on, list) else [on]
        terms = [t if isinstance(t, tuple) else ("asc", t) for t in items]
        for t in terms:
            _order([t], "distinct", aggregates=False)
        return self._with("distinct", assocs, on=terms) if terms else self

    def distinct_roots(self, on: Any = True) -> Query:
        if on == []:
            return self
        if not isinstance(on, bool):
            raise BuildError(f"distinct_roots takes true or false, got {on!r}")
        if not self.schema.primary_key:
            raise QueryError(f"distinct_roots: {self.schema.name} has no primary key")
        return self._with("distinct", on="roots" if on else False)

    # Order

    def order_by(self, *args: Any) -> Query:
        assocs, terms = (None, args[0]) if len(args) == 1 else args
        found = _order(terms)
        return self._with("order_by", assocs, terms=found) if found else self

    def maybe_order_by(self, condition: bool, *args: Any) -> Query:
        if not isinstance(condition, bool):
            raise BuildError(f"maybe_order_by takes true or false, got {condition!r}")
        return self.order_by(*args) if condition else self

    def limit(self, n: Any) -> Query:
        return self._with("limit", n=_count(n, "limit"))

    def offset(self, n: Any) -> Query:
        return self._with("offset", n=_count(n, "offset"))

    # Ranking

    def top_n_per(self, *args: Any, partition_by: Any = None, order_by: Any = None, n: Any = None, disable_distinct_on: bool = False) -> Query:
        """The first n root rows of each partition. disable_distinct_on is taken for compatibility: there is one plan, a window."""
        if isinstance(n, bool) or not isinstance(n, int) or n < 1:
            raise BuildError(f"top_n_per: n must be 1 or more, got {n!r}")
        if partition_by is None or order_by is None:
            raise BuildError("top_n_per needs partition_by and order_by")
        if not isinstance(disable_distinct_on, bool):
            raise BuildError("top_n_per: disable_distinct_on is true or false")
        by = _expressions(partition_by, "top_n_per: partition_by")
        terms = _order(order_by, "top_n_per: order_by")
        if not by or not terms:
            raise BuildError("top_n_per: partition_by and order_by can't be empty")
        return self._with("top_n_per", args[0] if args else None, partition_by=by, order_by=terms, n=n)

    def first_per(self, *args: Any, partition_by: Any = None, order_by: Any = None, n: int = 1, disable_distinct_on: bool = False) -> Query:
        if n != 1:
            raise BuildError("first_per takes the first row; use top_n_per for more")
        return self.top_n_per(*args, partition_by=partition_by, order_by=order_by, n=1, disable_distinct_on=disable_distinct_on)

    # Preloads

    def preload_separate(self, assocs: Any) -> Query:
        return self._with("preload", assocs, how="separate")

    def preload_through_join(self, assocs: Any) -> Query:
        return self._with("preload", assocs, how="through_join")

    def preload_separate_scoped(self, assoc: str, *, where: Any = None, order_by: Any = None) -> Query:
        if not isinstance(assoc, str):
            raise BuildError("preload_separate_scoped takes one direct association")
        filters, terms = entries(where if where is not None else []), _order(order_by if order_by is not None else [], aggregates=False)
        for e in filters:
            if not isinstance(e, tuple) or not isinstance(e[0], str) or "@" in e[0]:
                raise BuildError(f"preload_separate_scoped: filters name the child's own fields, got {e!r}")
        for _, t in terms:
            if not isinstance(t, str) or "@" in t:
                raise BuildError(f"preload_separate_scoped: order_by names the child's own fields, got {t!r}")
        return self._with("preload", assoc, how="separate", options={"where": filters, "order_by": terms})

    # Pages and options

    def paginate_cursor(self, spark: SparkSession | None = None, **options: Any):
        from relweave.operators.paginate import paginate_cursor

        return paginate_cursor(self, spark, **options)

    paginate = paginate_cursor

    def paginate_offset(self, spark: SparkSession | None = None, **options: Any):
        from relweave.operators.paginate import paginate_offset

        return paginate_offset(self, spark, **options)

    def from_opts(self, options: dict | list | None, mode: str = "boundary", includes: dict | None = None, extension: Any = None) -> Query:
        from relweave.operators.options import from_opts

        return from_opts(self, options, mode, includes, extension)

    def from_list(self, *_: Any) -> Query:
        raise BuildError("from_list is gone; use from_opts")

    def subquery(self, options: dict | list | None = None) -> Query:
        """The query with options applied in full mode, for use as a value of in and not_in."""
        return self.from_opts(options, "full")

    def apply(self, change: Callable[[Query], Query]) -> Query:
        return change(self)
