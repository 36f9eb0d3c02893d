"""Hydration: associated rows as nested columns, a struct for to-one and an array for to-many associations.

Separate preloads take the children of the loaded roots only (a semi join, where the query narrows its roots), aggregate them by
their key once and join that to the roots, so roots never multiply. Preloads through a join take the rows that the query joined,
and collapse them to one row per root.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave.errors import QueryError
from relweave.functions.aggregates import Agg, aggregate_column
from relweave.functions.filters import all_of
from relweave.plans.tree import PRESENT, Node, Tree


def hydrate(stage, order: list[tuple[str, Column]], collapse: bool, planner) -> DataFrame:
    from relweave.plans.planner import col, ordered

    df, root = stage.df, stage.tree.root
    for n in root.walk():
        if n.preload and n.preload.how == "through_join":
            above = n.parent
            while above.path:
                if not (above.preload and above.preload.how == "through_join"):
                    raise QueryError(f"preload of {'.'.join(n.path)} through a join needs its parents to be loaded so too")
                above = above.parent
    loaded = [root, *[n for n in root.walk() if n.preload and n.preload.how == "through_join"]]
    own = {n.path: [c for c in df.columns if c.startswith(n.prefix) and "/" not in c[len(n.prefix) :]] for n in loaded}
    for n in loaded:
        for name, child in n.children.items():
            if child.preload and child.preload.how == "separate":
                if name in [c[len(n.prefix) :] for c in own[n.path]]:
                    raise QueryError(f"{name} is both a field and a preload of {n.schema.name}")
                df = attach(df, n, name, child, planner)
                own[n.path].append(n.column(name))
    if collapse:
        # A root takes its place by its first row's keys.
        sorts, down = [f"#o{i}" for i in range(len(order))], [d.startswith("desc") for d, _ in order]
        keep = [c for cs in own.values() for c in cs]
        df = df.select(*[col(c) for c in keep], *[c.alias(n) for n, (_, c) in zip(sorts, order, strict=True)])
        for depth in range(max(len(n.path) for n in loaded), 0, -1):
            here = [n for n in loaded if len(n.path) == depth]
            keys, rest = [], []  # a row's primary key stands for all of it
            for n in loaded:
                if len(n.path) < depth:
                    pk = [n.column(k) for k in n.schema.primary_key]
                    whole = not pk or not set(pk) <= set(own[n.path])
                    keys += own[n.path] if whole else pk
                    rest += [] if whole else [c for c in own[n.path] if c not in pk]
            kids = []
            for n in here:
                row = F.when(col(n.column(PRESENT)), F.struct(*[col(c).alias(c[len(n.prefix) :]) for c in own[n.path] if not c.endswith(PRESENT)]))
                rows = F.array_sort(F.collect_set(row))
                kids.append((rows if n.many else F.get(rows, 0)).alias(n.parent.column(n.path[-1])))
                own[n.parent.path] = [*own[n.parent.path], n.parent.column(n.path[-1])]
            df = df.groupBy(*[col(k) for k in keys]).agg(*kids, *[F.first(col(c)).alias(c) for c in rest], *[(F.max(col(c)) if d else F.min(col(c))).alias(c) for c, d in zip(sorts, down, strict=True)])
        if sorts:
            df = df.orderBy(*[ordered(col(c), d) for c, (d, _) in zip(sorts, order, strict=True)])
    elif order:
        # The joins above keep no order.
        df = df.orderBy(*[ordered(c, d) for d, c in order])
    return df.select(*[col(c).alias(c[1:]) for c in own[root.path] if c != "/" + PRESENT])


def narrows(query) -> bool:
    """Whether a query takes some of its roots only, and the same ones if it is run again: rows that a limit cuts off are settled
    only by an order that holds the primary key."""
    kinds = {op.kind for op in query.ops}
    tokens = {t for op in query.ops if op.kind == "order_by" for _, t in op.data["terms"] if isinstance(t, str)}
    settled = not kinds & {"limit", "offset"} or bool(query.schema.primary_key) and set(query.schema.primary_key) <= tokens
    ties = any(op.kind == "distinct" and op.data["on"] not in (True, False, "roots") for op in query.ops)
    return settled and not ties and bool(kinds - {"preload", "order_by"})


def attach(df: DataFrame, parent: Node, name: str, child: Node, planner) -> DataFrame:
    """A column of the parent's with the association's rows; nested preloads are attached to those first."""
    from relweave.plans.planner import Stage, col, join_node, prefixed

    registry, spark = planner.registry, planner.spark
    tree = Tree(registry, child.schema)
    rows = prefixed(registry.frame(spark, child.schema.name), "/", False)
    hops = registry.hops(parent.schema, name)
    narrow = narrows(planner.query)

    def of_owners(found: DataFrame, key: list[Column], owned: tuple[str, ...]) -> DataFrame:
        """Rows whose key some loaded owner has."""
        owners = df.select(*[col(parent.column(k)).alias(f"#own{i}") for i, k in enumerate(owned)])
        return found.join(owners, [k == col(f"#own{i}") for i, k in enumerate(key)], "left_semi") if narrow else found

    if len(hops) == 1 and hops[0][1].kind != "many_to_many":
        rows = of_owners(rows, [col("/" + hops[0][1].related_key)], (hops[0][1].owner_key,))
    below = replace(child, path=(), parent=None)
    for sub, node in child.children.items():
        if node.preload:
            if node.preload.how == "through_join":
                raise QueryError(f"{sub} can't be loaded through a join beneath a separate preload")
            rows = attach(rows, below, sub, node, planner)
    stage, options = Stage(tree, rows), child.preload.options or {}
    if options.get("where"):
        rows = rows.where(all_of(options["where"], stage.resolve, stage.cast))
    fields = [c for c in rows.columns if not c.endswith("/" + PRESENT)]
    out = parent.column(name)
    if len(hops) == 1 and hops[0][1].kind != "many_to_many":
        a = hops[0][1]
        left, keys = [a.owner_key], [col("/" + a.related_key).alias("#key0")]
    else:
        # Pairs of owner and child, once each however many ways lead there.
        if not parent.schema.primary_key or not child.schema.primary_key:
            raise QueryError(f"preload of {name} needs primary keys on both sides")
        walk = Tree(registry, parent.schema)
        walk.join(name, "inner")
        node = walk.root.children[name]
        pairs = join_node(prefixed(registry.frame(spark, parent.schema.name), "/"), walk, node, spark, "inner")
        left = list(parent.schema.primary_key)
        pairs = pairs.select(*[col("/" + k).alias(f"#key{i}") for i, k in enumerate(left)], *[col(node.column(k)).alias(f"#kid{i}") for i, k in enumerate(child.schema.primary_key)])
        pairs = of_owners(pairs, [col(f"#key{i}") for i in range(len(left))], tuple(left)).distinct()
        on = [col("/" + k) == col(f"#kid{i}") for i, k in enumerate(child.schema.primary_key)]
        rows = rows.join(pairs, on)
        keys = [col(f"#key{i}") for i in range(len(left))]
    terms = options.get("order_by") or [("asc", k) for k in child.schema.primary_key]
    rows = rows.select(*[c.alias(f"#key{i}") for i, c in enumerate(keys)], *[col(c) for c in fields])
    row = F.struct(*[col(c).alias(c[1:]) for c in fields])
    found = aggregate_column(Agg("array_agg", "#row", order_by=tuple(terms)), lambda t: row if t == "#row" else col("/" + t))
    grouped = rows.groupBy(*[col(f"#key{i}") for i in range(len(left))]).agg(found.alias(out))
    joined = df.join(grouped, [col(parent.column(k)) == col(f"#key{i}") for i, k in enumerate(left)], "left").drop(*[f"#key{i}" for i in range(len(left))])
    return joined.withColumn(out, F.coalesce(col(out), F.array()) if child.many else F.get(col(out), 0))
