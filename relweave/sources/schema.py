"""A graph of declared tables: schemas, primary keys, associations."""

from __future__ import annotations

import weakref
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from relweave.errors import BuildError


@dataclass(frozen=True)
class Assoc:
    """An edge of the graph. ``hops``: names of associations that a through edge walks; ``link``: the table of a many-to-many
    edge and its two keys."""

    kind: str
    related: str = ""
    owner_key: str = ""
    related_key: str = ""
    hops: tuple[str, ...] = ()
    link: tuple[str, str, str] = ("", "", "")


def belongs_to(related: str, owner_key: str, related_key: str) -> Assoc:
    return Assoc("belongs_to", related, owner_key, related_key)


def has_one(related: str, owner_key: str, related_key: str) -> Assoc:
    return Assoc("has_one", related, owner_key, related_key)


def has_many(related: str, owner_key: str, related_key: str) -> Assoc:
    return Assoc("has_many", related, owner_key, related_key)


def has_through(*hops: str) -> Assoc:
    if len(hops) < 2:
        raise BuildError("a through association needs two hops at least")
    return Assoc("has_through", hops=hops)


def many_to_many(related: str, owner_key: str, related_key: str, link: str, link_owner_key: str, link_related_key: str) -> Assoc:
    return Assoc("many_to_many", related, owner_key, related_key, link=(link, link_owner_key, link_related_key))


Source = str | DataFrame | Callable[[SparkSession], DataFrame]


@dataclass(frozen=True)
class Schema:
    """A table: its source (a Parquet path, ``table:name``, a DataFrame or a function of the session), key and associations.

    ``casts``: per field a function that filter values go through.
    """

    name: str
    source: Source
    primary_key: tuple[str, ...] = ()
    assocs: dict[str, Assoc] = field(default_factory=dict, hash=False, compare=False)
    casts: dict[str, Callable] = field(default_factory=dict, hash=False, compare=False)

    def read(self, spark: SparkSession) -> DataFrame:
        if isinstance(self.source, DataFrame):
            return self.source
        if callable(self.source):
            return self.source(spark)
        if self.source.startswith("table:"):
            return spark.table(self.source.removeprefix("table:"))
        return spark.read.parquet(self.source)


class Registry:
    """Schemas by name. Data frames that were read are kept per session, so each table's footer is read once."""

    def __init__(self, *schemas: Schema):
        self.schemas: dict[str, Schema] = {}
        self._frames: weakref.WeakKeyDictionary[SparkSession, dict[str, DataFrame]] = weakref.WeakKeyDictionary()
        for s in schemas:
            self.add(s)

    def add(self, schema: Schema) -> Schema:
        if schema.name in self.schemas:
            raise BuildError(f"schema {schema.name} is declared twice")
        self.schemas[schema.name] = schema
        return schema

    def __getitem__(self, name: str) -> Schema:
        if name not in self.schemas:
            raise BuildError(f"no schema named {name!r}")
        return self.schemas[name]

    def frame(self, spark: SparkSession, name: str) -> DataFrame:
        frames = self._frames.setdefault(spark, {})
        if name not in frames:
            frames[name] = self[name].read(spark)
        return frames[name]

    def assoc(self, schema: Schema, name: str) -> Assoc:
        if name not in schema.assocs:
            raise BuildError(f"{schema.name} has no association {name!r}; it has {', '.join(sorted(schema.assocs)) or 'none'}")
        return schema.assocs[name]

    def hops(self, schema: Schema, name: str) -> list[tuple[Schema, Assoc]]:
        """The direct edges that an association stands for, with the schema each leads from."""
        a = self.assoc(schema, name)
        if a.kind != "has_through":
            return [(schema, a)]
        out, at = [], schema
        for hop in a.hops:
            out += self.hops(at, hop)
            at = self.related(at, hop)
        return out

    def related(self, schema: Schema, name: str) -> Schema:
        a = self.assoc(schema, name)
        if a.kind == "has_through":
            at = schema
            for hop in a.hops:
                at = self.related(at, hop)
            return at
        return self[a.related]

    def to_many(self, schema: Schema, name: str) -> bool:
        return any(a.kind in ("has_many", "many_to_many") for _, a in self.hops(schema, name))

    def query(self, name: str):
        """A query whose root is the schema."""
        from relweave.operators.query import Query

        return Query(self, self[name])

    def wrap(self, name: str, df: DataFrame, joined: dict[str, dict[str, str]] | None = None):
        """A query on a given DataFrame in the place of the schema's table; it must have the schema's key.

        ``joined``: associations whose rows the frame holds already, as names (``customer`` or ``customer.nation``) with their
        fields and the frame's columns for those. They are not joined again; the other columns are the root's.
        """
        from relweave.operators.query import Query

        schema, bound = self[name], []
        for path, fields in (joined or {}).items():
            at = schema
            for hop in path.split("."):
                at = self.related(at, hop)
            if missing := [k for k in at.primary_key if k not in fields] or [c for c in fields.values() if c not in df.columns]:
                raise BuildError(f"joined {path}: {', '.join(missing)} is missing")
            if not at.primary_key:
                raise BuildError(f"joined {path}: {at.name} has no primary key to tell rows that are there")
            bound.append((tuple(path.split(".")), tuple(fields.items()), at.primary_key))
        own = set(df.columns) - {c for _, fields, _ in bound for _, c in fields}
        if missing := [k for k in schema.primary_key if k not in own]:
            raise BuildError(f"the frame lacks {', '.join(missing)} of {name}")
        if missing := [p for p, _, _ in bound if len(p) > 1 and p[:-1] not in {x for x, _, _ in bound}]:
            raise BuildError(f"joined {'.'.join(missing[0])}: name what it hangs on, too")
        return Query(self, replace(schema, source=df), bound=tuple(bound))
