"""Compiles a query's operations to one lazy DataFrame.

Within a stage the order of calls does not matter between clauses, so operations are put in the order of SQL: joins, filters,
grouping, having, ranking, projection, distinct, order, offset, limit. A stage ends at top_n_per; what follows sees its rows.
Bindings are flat columns named by path and field, which keeps pruning and pushdown as the optimiser likes them. Structs are
built at the end only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relweave.errors import BuildError, QueryError
from relweave.functions.aggregates import Agg, aggregate_column, having_column
from relweave.functions.filters import all_of, any_of, tokens_of
from relweave.functions.refs import Literal, direction, split_token
from relweave.plans.tree import PRESENT, Node, Tree
from relweave.streaming import check_streamable

BARRIER = "top_n_per"


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def ordered(c: Column, d: str) -> Column:
    return getattr(c, direction(d))()


def fail(message: str):
    raise BuildError(message)


@dataclass
class Stage:
    """A stage's tree and rows. ``keys``: columns of the grouping expressions, by the object given; ``aggs``: of aggregates."""

    tree: Tree
    df: DataFrame
    keys: dict[Any, str] = field(default_factory=dict)
    aggs: dict[int, str] = field(default_factory=dict)
    grouped: bool = False
    names: list[str] | None = None

    def has(self, node: Node, name: str) -> bool:
        return node.column(name) in (self.df.columns if self.names is None else self.names)

    def resolve(self, token: str) -> Column:
        node, name = self.tree.find(token)
        if not self.has(node, name):
            if self.grouped and name in self.tree.registry.frame(self.df.sparkSession, node.schema.name).columns:
                raise BuildError(f"{token!r} must be grouped by or aggregated")
            raise BuildError(f"{token!r}: {node.schema.name} has no field {name!r}")
        return col(node.column(name))

    def cast(self, token: str, value: Any) -> Any:
        node, name = self.tree.find(token)
        return node.schema.casts[name](value) if name in node.schema.casts and value is not None else value

    def expression(self, x: Any, what: str) -> Column:
        """A token, function or column; what grouping has made of it, where there is one."""
        key = x if isinstance(x, str) else id(x)
        if key in self.keys:
            return col(self.keys[key])
        if isinstance(x, Agg):
            return col(self.aggs[id(x)]) if id(x) in self.aggs else fail(f"{what}: an aggregate has no place here")
        if isinstance(x, str):
            return self.resolve(x)
        if isinstance(x, Column):
            return x
        if callable(x):
            return x(self.resolve)
        raise BuildError(f"{what}: expected a token, a function or a column, got {x!r}")


def prefixed(df: DataFrame, prefix: str, present: bool = True) -> DataFrame:
    extra = [F.lit(True).alias(prefix + PRESENT)] if present else []
    return df.select(*[col(c).alias(prefix + c) for c in df.columns], *extra)


def hop_join(left: DataFrame, left_key: Column, right: DataFrame, right_key: Column, how: str, on: Column | None = None) -> DataFrame:
    condition = left_key == right_key
    return left.join(right, condition if on is None else condition & on, how)


def join_node(df: DataFrame, tree: Tree, node: Node, spark: SparkSession, how: str, on: Callable[[DataFrame, list[str]], Column | None] = lambda *_: None, prepare: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """Joins an association's rows, which ``prepare`` may add columns to; a through or many-to-many edge is a chain whose inner
    tables leave no columns."""
    registry, at, hidden = tree.registry, node.parent.prefix, []
    hops = registry.hops(node.parent.schema, node.path[-1])
    for i, (_, a) in enumerate(hops):
        last = i == len(hops) - 1
        prefix = node.prefix if last else f"{node.prefix}#{i}/"
        right = prefixed(registry.frame(spark, a.related), prefix, last)
        right = prepare(right) if last else right
        key = col(at + a.owner_key)
        if a.kind == "many_to_many":
            table, owner, related = a.link
            link = prefixed(registry.frame(spark, table).select(owner, related), f"{prefix}#link/", False)
            df = hop_join(df, key, link, col(f"{prefix}#link/{owner}"), how)
            key, hidden = col(f"{prefix}#link/{related}"), [*hidden, f"{prefix}#link/{owner}", f"{prefix}#link/{related}"]
        condition = on(df, [*df.columns, *right.columns]) if last and node.on else None
        df = hop_join(df, key, right, col(prefix + a.related_key), how, condition)
        if not last:
            hidden += right.columns
        at = prefix
    return df.drop(*hidden)


def source(query, spark: SparkSession) -> DataFrame:
    """The root's rows: those of the registry's table, or of the frame that the query wraps."""
    registered = query.registry.schemas.get(query.schema.name)
    return query.registry.frame(spark, query.schema.name) if registered is query.schema else query.schema.read(spark)


class Planner:
    def __init__(self, query, spark: SparkSession):
        self.query, self.spark, self.registry, self.flags = query, spark, query.registry, 0

    def stages(self, ops: list) -> list[list]:
        out = [[]]
        for op in ops:
            out[-1].append(op)
            if op.kind == BARRIER:
                out.append([])
        return out

    def compile(self) -> DataFrame:
        return self.output(*self.run())

    def run(self) -> tuple[Stage, list, list]:
        """The last stage before projection, its operations, and the preloads."""
        preloads = [op for op in self.query.ops if op.kind == "preload"]
        stages = self.stages([op for op in self.query.ops if op.kind != "preload"])
        rows = source(self.query, self.spark)
        if rows.isStreaming:
            check_streamable(self.query)
        df, stage = self.bind(rows), None
        for i, ops in enumerate(stages):
            stage = self.stage(df, ops, preloads if i == len(stages) - 1 else [], () if i else self.query.bound)
            if ops and ops[-1].kind == BARRIER:
                df = stage.df.select(*[col(c) for c in stage.df.columns if c.startswith("/")])
        return stage, stages[-1], preloads

    def bind(self, rows: DataFrame) -> DataFrame:
        """The root's columns, and those of associations that a wrapped frame has joined."""
        taken = {c for _, fields, _ in self.query.bound for _, c in fields}
        columns = [*[col(c).alias("/" + c) for c in rows.columns if c not in taken], F.lit(True).alias("/" + PRESENT)]
        for path, fields, key in self.query.bound:
            prefix, of = "/".join(path) + "/", dict(fields)
            columns += [*[col(c).alias(prefix + f) for f, c in fields], col(of[key[0]]).isNotNull().alias(prefix + PRESENT)]
        return rows.select(*columns)

    def tree(self, ops: list, preloads: list) -> Tree:
        tree = Tree(self.registry, self.query.schema)
        for op in ops:
            if op.kind == "join":
                tree.join(op.assocs, op.data["each"], op.data["leaf"], op.data["on"])
            elif op.kind != "lateral" and op.kind != "exists":
                tree.join(op.assocs)
        for op in preloads:
            tree.add_preload(op.assocs, op.data["how"], op.data.get("options"))
        return tree

    def joins(self, df: DataFrame, tree: Tree, left_default: str = "left", bound: tuple = ()) -> DataFrame:
        """Joins all nodes; one whose ON filters name others waits for them. Those that are bound are there already: an inner join
        of one drops the rows that lack it."""
        there = {path for path, _, _ in bound}
        done, todo = {tree.root.path} | there, [n for n in tree.nodes()[1:] if n.path not in there]
        for n in tree.nodes():
            if n.path in there and n.on:
                raise QueryError(f"{'.'.join(n.path)} is joined by the frame; filters can't be added to that join")
            if n.path in there and n.qualifier == "inner":
                df = df.where(col(n.column(PRESENT)))
        while todo:
            for n in todo:
                needs = {tree.find(t)[0].path for f, gs in n.on for g in (f, *gs) for t in tokens_of(g)} - {n.path}
                if n.parent.path in done and needs <= done:
                    break
            else:
                raise QueryError(f"join filters of {'.'.join(todo[0].path)} wait for one another")
            how = {"any": left_default}.get(n.qualifier, n.qualifier)
            # NOT IN a subquery: a flag on the side that has the field.
            flagged = {id(e): (tree.find(e[0]), f"#in{self.flag()}") for f, gs in n.on for g in (f, *gs) for e in g if self.is_not_in(e)}
            entries = {id(e): e for f, gs in n.on for g in (f, *gs) for e in g}

            def flags(rows: DataFrame, own: bool, flagged=flagged, entries=entries, n=n) -> DataFrame:
                for k, ((node, name), flag) in flagged.items():
                    if (node is n) == own:
                        rows = self.with_flag(rows, col(node.column(name)), entries[k], flag)
                return rows

            def on(left: DataFrame, names: list[str], n=n, flagged=flagged) -> Column | None:
                stage = Stage(tree, left, names=names)
                told = lambda g: [(lambda _, f=flagged[id(e)][1]: col(f)) if id(e) in flagged else e for e in g]
                found = [c for f, gs in n.on if (c := any_of([told(g) for g in (f, *gs)], stage.resolve, stage.cast)) is not None]
                return reduce(lambda a, b: a & b, found) if found else None

            df = join_node(flags(df, False), tree, n, self.spark, how, on, lambda right, flags=flags: flags(right, True))
            done.add(n.path)
            todo = [x for x in todo if x is not n]
        return df

    def stage(self, df: DataFrame, ops: list, preloads: list, bound: tuple = ()) -> Stage:
        tree = self.tree(ops, preloads)
        stage = Stage(tree, self.joins(df, tree, bound=bound))
        for op in ops:
            if op.kind == "where":
                given = [g for g in op.data["groups"] if g]
                absent = [e for e in given[0] if self.is_not_in(e)] if len(given) == 1 else []
                given = [[e for e in given[0] if not self.is_not_in(e)]] if absent else self.unnested(stage, given)
                if (c := any_of(given, stage.resolve, stage.cast)) is not None:
                    stage.df = stage.df.where(c)
                for e in absent:
                    stage.df = self.not_in(stage, e)
            elif op.kind == "exists":
                stage.df = self.exists(stage.df, op)
        self.group(stage, ops)
        if ops and ops[-1].kind == BARRIER:
            self.top_n(stage, ops)
        return stage

    @staticmethod
    def is_not_in(e: Any) -> bool:
        from relweave.operators.query import Query

        return isinstance(e, tuple) and len(e) == 3 and e[1] == "not_in" and isinstance(e[2], Query)

    def values(self, e: tuple) -> tuple[DataFrame, Column]:
        """A NOT IN's subquery as a column #in, and what its nulls say: empty, whole (it has none) or nulls."""
        found = e[2].to_df(self.spark)
        if len(found.columns) != 1:
            raise BuildError(f"not_in: a subquery must select one field, this one has {len(found.columns)}")
        found = found.toDF("#in")
        nulls = F.count_if(col("#in").isNull())
        return found, found.agg(F.when(F.count("*") == 0, "empty").when(nulls == 0, "whole").otherwise("nulls").alias("state")).scalar()

    def not_in(self, stage: Stage, e: tuple) -> DataFrame:
        """NOT IN a subquery as an anti join on equal keys and one scalar about nulls: the optimiser's own null-aware join would
        broadcast the subquery whatever its size."""
        (found, state), left = self.values(e), stage.resolve(e[0])
        rest = stage.df.join(found, left == col("#in"), "left_anti")
        return rest.where((state == "empty") | (state == "whole") & left.isNotNull())

    def flag(self) -> int:
        self.flags += 1
        return self.flags

    def with_flag(self, df: DataFrame, left: Column, e: tuple, flag: str) -> DataFrame:
        """A column that tells whether a NOT IN holds, from a left join with the distinct values."""
        found, state = self.values(e)
        joined = df.join(found.where(col("#in").isNotNull()).distinct(), left == col("#in"), "left")
        return joined.withColumn(flag, (state == "empty") | (state == "whole") & left.isNotNull() & col("#in").isNull()).drop("#in")

    def unnested(self, stage: Stage, groups: list[list]) -> list[list]:
        """The groups with each NOT IN a subquery as a flag that is joined to the stage's rows."""
        out = []
        for g in groups:
            out.append([])
            for e in g:
                if self.is_not_in(e):
                    flag = f"#in{self.flag()}"
                    stage.df = self.with_flag(stage.df, stage.resolve(e[0]), e, flag)
                    e = lambda _, flag=flag: col(flag)
                out[-1].append(e)
        return out

    # Grouping

    def group(self, stage: Stage, ops: list) -> None:
        keys = [k for op in ops if op.kind == "group_by" for k in op.data["keys"]]
        aggs: list[Agg] = []

        def collect(x: Any) -> None:
            if isinstance(x, Agg):
                aggs.append(x)
            elif isinstance(x, dict):
                [collect(v) for v in x.values()]
            elif isinstance(x, list | tuple):
                [collect(v) for v in x]

        for op in ops:
            if op.kind in ("select", "select_merge"):
                collect(op.data["form"])
            elif op.kind == "order_by":
                collect([t for _, t in op.data["terms"]])
            elif op.kind == "having":
                collect(op.data["groups"])
            elif op.kind == BARRIER:
                collect([t for _, t in op.data["order_by"]])
        if not keys and not aggs:
            if any(op.kind == "having" for op in ops):
                raise BuildError("having needs a grouping or an aggregate")
            return
        made, names = [], {}
        for i, k in enumerate(keys):
            if isinstance(k, str):
                node, name = stage.tree.find(k)
                stage.resolve(k)
                made.append(col(node.column(name)))
                names[k] = node.column(name)
            else:
                made.append(stage.expression(k, "group_by").alias(f"#key{i}"))
                names[id(k)] = f"#key{i}"
        taken = set(names.values())
        pk = [stage.tree.root.column(c) for c in stage.tree.root.schema.primary_key]
        if pk and set(pk) <= taken:  # the key stands for the whole row
            made += [col(c) for c in stage.df.columns if c.startswith("/") and c not in taken and not c.endswith(PRESENT)]
        columns = []
        for i, a in enumerate(aggs):
            if id(a) not in stage.aggs:
                stage.aggs[id(a)] = f"#agg{i}"
                columns.append(aggregate_column(a, stage.resolve, stage.cast).alias(f"#agg{i}"))
        stage.df = stage.df.groupBy(*made).agg(*columns) if columns else stage.df.select(*made).distinct()
        stage.keys, stage.grouped = names, True
        for op in ops:
            if op.kind == "having":
                stage.df = stage.df.where(self.having(stage, op.data["groups"]))

    def having(self, stage: Stage, groups: list[list]) -> Column:
        def one(e: Any) -> Column:
            if isinstance(e, tuple) and e and isinstance(e[0], Agg):
                return having_column(e, lambda a: col(stage.aggs[id(a)]), stage.resolve)
            return all_of([e], stage.resolve, stage.cast)

        found = [reduce(lambda a, b: a & b, map(one, g)) for g in groups if g]
        return reduce(lambda a, b: a | b, found) if found else F.lit(True)

    # EXISTS

    def exists(self, df: DataFrame, op) -> DataFrame:
        """A semi or anti join. Without filters on the root's own fields the first hop's key is enough, and the root isn't read again."""
        schema = self.query.schema
        tree = Tree(self.registry, schema)
        tree.join(op.assocs, "inner")
        parts = [op.data["scope"], op.data["where"], *op.data["where_any"]]
        how = "left_anti" if op.data["negated"] else "left_semi"
        on_root = any(not callable(e) and tree.find(t)[0] is tree.root for p in parts for e in p for t in tokens_of([e])) or any(callable(e) for p in parts for e in p)
        tops = list(tree.root.children.values())
        if not on_root and len(tops) == 1 and tops[0].assoc.kind in ("belongs_to", "has_one", "has_many"):
            top = tops[0]
            inner = prefixed(self.registry.frame(self.spark, top.schema.name), top.prefix)
            for n in tree.nodes()[2:]:
                inner = join_node(inner, tree, n, self.spark, "inner")
            keys = [("/" + top.assoc.owner_key, top.prefix + top.assoc.related_key)]
        else:
            inner = self.joins(prefixed(source(self.query, self.spark), "/"), tree)
            keys = [("/" + k, "/" + k) for k in schema.primary_key]
        stage = Stage(tree, inner)
        conditions = [all_of(p, stage.resolve, stage.cast) for p in self.unnested(stage, [op.data["scope"], op.data["where"]]) if p]
        if (c := any_of(self.unnested(stage, op.data["where_any"]), stage.resolve, stage.cast)) is not None:
            conditions.append(c)
        inner = stage.df
        for c in conditions:
            inner = inner.where(c)
        inner = inner.select(*[col(k).alias(f"#exists{i}") for i, (_, k) in enumerate(keys)])
        return df.join(inner, reduce(lambda a, b: a & b, [col(k) == col(f"#exists{i}") for i, (k, _) in enumerate(keys)]), how)

    # Ranking

    def top_n(self, stage: Stage, ops: list) -> None:
        op, root = ops[-1], stage.tree.root
        pk, kinds = root.schema.primary_key, {x.kind for x in ops[:-1]}
        if not pk:
            raise QueryError(f"top_n_per: {root.schema.name} has no primary key")
        if bad := kinds & {"limit", "offset", "order_by", "select", "select_merge", "lateral"}:
            raise QueryError(f"top_n_per comes before {', '.join(sorted(bad))}")
        tokens = {t for _, t in op.data["order_by"] if isinstance(t, str)}
        if missing := [k for k in pk if k not in tokens]:
            raise QueryError(f"top_n_per: order_by must hold the primary key, {', '.join(missing)} is missing")
        distinct = [x for x in ops if x.kind == "distinct" and x.data["on"] is not False]
        if any(n.many for n in stage.tree.nodes()) and not stage.grouped and not distinct:
            raise QueryError("top_n_per: a to-many join repeats rows; group them, take distinct ones, or use an EXISTS filter")
        if stage.grouped and not all(stage.has(root, c) for c in pk):
            raise QueryError("top_n_per on groups needs the primary key among the grouping keys")
        for d in distinct:
            stage.df = self.distinct_on(stage, d, [])
        by = [stage.expression(x, "partition_by") for x in op.data["partition_by"]]
        order = [ordered(stage.expression(t, "order_by"), d) for d, t in op.data["order_by"]]
        stage.df = stage.df.withColumn("#rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("`#rank`") <= op.data["n"]).drop("#rank")

    def distinct_on(self, stage: Stage, op, order: list[tuple]) -> DataFrame:
        terms = self.distinct_terms(stage, op)
        if not terms:
            return stage.df
        rest = [ordered(stage.expression(t, "order_by"), d) for d, t in order]
        window = Window.partitionBy(*[c for _, c in terms]).orderBy(*(rest or [ordered(c, d) for d, c in terms]))
        return stage.df.withColumn("#first", F.row_number().over(window)).where(F.col("`#first`") == 1).drop("#first")

    def distinct_terms(self, stage: Stage, op) -> list[tuple[str, Column]]:
        on = op.data["on"]
        if on == "roots":
            return [("asc", col("/" + k)) for k in stage.tree.root.schema.primary_key]
        if on is True:
            return [("asc", col(c)) for c in stage.df.columns if c.startswith("/") and not c.endswith(PRESENT)]
        return [(d, stage.expression(t, "distinct")) for d, t in on]

    # Output

    def output(self, stage: Stage, ops: list, preloads: list) -> DataFrame:
        of = lambda kind: [op for op in ops if op.kind == kind]
        order = [t for op in of("order_by") for t in op.data["terms"]]
        selects, merges, lateral = of("select"), of("select_merge"), of("lateral")
        distinct = [op for op in of("distinct") if op.data["on"] is not False]
        if any(op.data["on"] == "roots" for op in distinct) and any(n.many and n.preload and n.preload.how == "through_join" for n in stage.tree.root.walk()):
            raise QueryError("distinct_roots would cut the rows that a to-many preload through a join needs")
        if preloads and (selects or merges or lateral or stage.grouped):
            raise QueryError("preloads need whole root rows, without select, grouping or lateral joins")
        lead: list[Column] = []
        plain_distinct = False
        for op in distinct:
            if op.data["on"] is True:
                plain_distinct = True
                continue
            stage.df = self.distinct_on(stage, op, order)
            lead += [ordered(c, d) for d, c in self.distinct_terms(stage, op)]
        if lateral:
            return self.lateral(stage, lateral, ops, order)
        sort = [*lead, *[ordered(stage.expression(t, "order_by"), d) for d, t in order]]
        limit, offset = ([op.data["n"] for op in of(k)][-1:] for k in ("limit", "offset"))
        columns = self.projection(stage, selects, merges)
        through = [n for n in stage.tree.root.walk() if n.preload and n.preload.how == "through_join"]
        if through or any(n.preload for n in stage.tree.root.walk()):
            from relweave.operators.preload import hydrate

            stage.df = self.cut(stage.df, sort, offset, limit)
            return hydrate(stage, [(d, stage.expression(t, "order_by")) for d, t in order], bool(through), self)
        if plain_distinct:
            # Sort columns ride along; SQL asks that they be among the selected ones, so they don't add rows.
            hidden = [(f"#sort{i}", stage.expression(t, "order_by"), d) for i, (d, t) in enumerate(order)]
            names = [c for c in stage.df.select(*columns).columns]
            out = stage.df.select(*columns, *[c.alias(h) for h, c, _ in hidden]).distinct()
            return self.cut(out, [ordered(col(h), d) for h, _, d in hidden], offset, limit).select(*[col(n) for n in names])
        return self.cut(stage.df, sort, offset, limit).select(*columns)

    @staticmethod
    def cut(df: DataFrame, sort: list[Column], offset: list[int], limit: list[int]) -> DataFrame:
        df = df.orderBy(*sort) if sort else df
        df = df.offset(offset[0]) if offset and offset[0] else df
        return df.limit(limit[0]) if limit else df

    def root_columns(self, stage: Stage) -> list[Column]:
        return [col(c).alias(c[1:]) for c in stage.df.columns if c.startswith("/") and c != "/" + PRESENT]

    def projection(self, stage: Stage, selects: list, merges: list) -> list[Column]:
        if selects:
            fields = self.form(stage, selects[0].data["form"])
        elif stage.grouped and not merges:
            return [col(c).alias(c.rsplit("/", 1)[-1]) for c in stage.df.columns if not c.endswith(PRESENT)]
        else:
            fields = {c[1:]: col(c) for c in stage.df.columns if c.startswith("/") and c != "/" + PRESENT}
        for op in merges:
            form = op.data["form"]
            if isinstance(form, str):
                if "@" in form:
                    raise BuildError(f"select_merge: {form!r} needs a key, as in {{'name': {form!r}}}")
                form = [form]
            if isinstance(form, list) and any("@" in t for t in form if isinstance(t, str)):
                raise BuildError("select_merge: tokens of associations need keys")
            if isinstance(form, tuple):
                raise BuildError("select_merge takes a dict, a list of tokens, a token or a function")
            if selects and not isinstance(selects[0].data["form"], dict | list) and not callable(selects[0].data["form"]):
                raise BuildError("select_merge needs a select of named columns")
            fields = fields | (form(stage.resolve) if callable(form) else self.form(stage, form))
        return [c.alias(k) for k, c in fields.items()]

    def form(self, stage: Stage, form: Any) -> dict[str, Column]:
        if isinstance(form, str):
            return {split_token(form)[0]: stage.expression(form, "select")}
        if isinstance(form, Agg):
            return {form.kind: stage.expression(form, "select")}
        if isinstance(form, tuple):
            return {f"_{i}": self.element(stage, x) for i, x in enumerate(form, 1)}
        if isinstance(form, list):
            if len(set(form)) < len(form):
                raise BuildError(f"select: {form!r} names a token twice")
            return {t: stage.expression(t, "select") for t in form}
        if isinstance(form, dict):
            return {k: self.element(stage, v) for k, v in form.items()}
        if callable(form):
            made = form(stage.resolve)
            return made if isinstance(made, dict) else {"value": made}
        raise BuildError(f"select: can't use {form!r}")

    def element(self, stage: Stage, x: Any) -> Column:
        if isinstance(x, Literal):
            return F.lit(x.value)
        if isinstance(x, tuple):
            return F.struct(*[self.element(stage, v).alias(f"_{i}") for i, v in enumerate(x, 1)])
        if isinstance(x, str | Agg | Column) or callable(x):
            return stage.expression(x, "select")
        return F.lit(x)

    # Latest and top-N children

    def lateral(self, stage: Stage, found: list, ops: list, order: list) -> DataFrame:
        """Children ranked by their key, then joined: as the optimiser would rewrite the lateral join, one shuffle of children."""
        from relweave.operators.query import Query

        if len(found) > 1:
            raise QueryError("one left_join_latest or left_join_top_n a query")
        if any(op.kind in ("select", "select_merge") for op in ops):
            raise QueryError("a lateral helper selects root and child itself")
        op, schema = found[0], self.query.schema
        name = op.assocs
        if not isinstance(name, str) or name[-1:] in "?!":
            raise QueryError("a lateral helper takes one association's name")
        a = self.registry.assoc(schema, name)
        if a.kind != "has_many":
            raise QueryError(f"a lateral helper needs a direct has_many; {name} is {a.kind}")
        child = self.registry[a.related]
        if not child.primary_key:
            raise QueryError(f"{child.name} has no primary key")
        tokens = {t for _, t in op.data["order_by"] if isinstance(t, str)}
        if missing := [k for k in child.primary_key if k not in tokens]:
            raise QueryError(f"order_by must hold the child's primary key, {', '.join(missing)} is missing")
        inner = Planner(Query(self.registry, child).where(op.data["child_assocs"], op.data["where"]) if op.data["where"] else Query(self.registry, child).join_neutral(op.data["child_assocs"]), self.spark)
        kids, _, _ = inner.run()
        window = Window.partitionBy(col("/" + a.related_key)).orderBy(*[ordered(kids.expression(t, "order_by"), d) for d, t in op.data["order_by"]])
        ranked = kids.df.where(col("/" + a.related_key).isNotNull()).withColumn("#rank", F.row_number().over(window)).where(F.col("`#rank`") <= op.data["n"])
        fields = [c for c in kids.df.columns if c.startswith("/") and c != "/" + PRESENT]
        right = ranked.select(F.struct(*[col(c).alias(c[1:]) for c in fields]).alias("#child"), col("/" + a.related_key).alias("#fk"), F.col("`#rank`").alias("#place"))
        joined = stage.df.join(right, col("/" + a.owner_key) == col("#fk"), "left")
        stage.df = joined
        sort = [ordered(stage.expression(t, "order_by"), d) for d, t in order]
        limit, offset = ([o.data["n"] for o in ops if o.kind == k][-1:] for k in ("limit", "offset"))
        cut = self.cut(joined, [*sort, col("#place").asc_nulls_last()] if sort else [], offset, limit)
        return cut.select(F.struct(*self.root_columns(stage)).alias(schema.name), col("#child").alias(name))

