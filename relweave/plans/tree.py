"""The associations that a stage of a query uses, merged into one tree."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from relweave.errors import BuildError, QueryError
from relweave.functions.refs import split_token
from relweave.sources.schema import Assoc, Registry, Schema

#: Between the parts of flat column names: a path, then the field.
SEP = "/"
PRESENT = "?"


@dataclass
class Preload:
    how: str  # separate or through_join
    options: dict | None = None


@dataclass
class Node:
    schema: Schema
    path: tuple[str, ...] = ()
    assoc: Assoc | None = None
    parent: Node | None = None
    joined: bool = False
    qualifier: str = "any"
    on: list = field(default_factory=list)  # (filters, or-groups) of left joins
    preload: Preload | None = None
    children: dict[str, Node] = field(default_factory=dict)
    many: bool = False

    @property
    def prefix(self) -> str:
        return SEP.join(self.path) + SEP

    def column(self, name: str) -> str:
        return self.prefix + name

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children.values():
            yield from c.walk()


def parse_paths(spec: Any) -> list[tuple[str, list]]:
    """Nested association specs as (marked name, children) pairs."""
    if spec is None or spec == [] or spec == {}:
        return []
    if isinstance(spec, str):
        return [(spec, [])]
    if isinstance(spec, dict):
        return [(k, parse_paths(v)) for k, v in spec.items()]
    if isinstance(spec, list | tuple):
        return [x for s in spec for x in parse_paths(s)]
    raise BuildError(f"associations are names, lists or dicts, got {spec!r}")


def marked(name: str) -> tuple[str, str]:
    """A name and the join that its marker asks for."""
    if not isinstance(name, str) or not name.strip("?!"):
        raise BuildError(f"not an association: {name!r}")
    if name[-1] in "?!":
        return name[:-1], "left" if name[-1] == "?" else "inner"
    return name, "any"


class Tree:
    def __init__(self, registry: Registry, root: Schema):
        self.registry, self.root = registry, Node(root, joined=True)

    def child(self, node: Node, name: str) -> Node:
        if name not in node.children:
            assoc = self.registry.assoc(node.schema, name)
            node.children[name] = Node(self.registry.related(node.schema, name), (*node.path, name), assoc, node, many=self.registry.to_many(node.schema, name))
        return node.children[name]

    def join(self, spec: Any, each: str = "any", leaf: str | None = None, on: tuple | None = None) -> None:
        """Adds joins. ``each``: what every hop asks for; ``leaf``: what the last ones do instead; ``on``: filters there."""

        def add(node: Node, items: list[tuple[str, list]], locked: bool) -> None:
            for raw, below in items:
                name, wants = marked(raw)
                asked = leaf if leaf and not below else each
                if locked:
                    if wants == "inner" or asked == "inner":
                        raise BuildError(f"{name}! can't be an inner join beneath a left one")
                    wants = "left"
                if asked != "any":
                    if wants not in ("any", asked):
                        raise BuildError(f"{raw}: conflicting joins, {wants} and {asked}")
                    wants = asked
                n = self.child(node, name)
                n.joined = True
                n.qualifier = self.merge(n, wants)
                if on and not below:
                    if on not in n.on:
                        n.on.append(on)
                add(n, below, wants == "left" and asked == "any")

        add(self.root, parse_paths(spec), False)

    @staticmethod
    def merge(node: Node, wants: str) -> str:
        if "any" in (node.qualifier, wants):
            return wants if node.qualifier == "any" else node.qualifier
        if node.qualifier != wants:
            raise BuildError(f"{'.'.join(node.path)} is asked for as a left and as an inner join")
        return wants

    def add_preload(self, spec: Any, how: str, options: dict | None = None) -> None:
        def add(node: Node, items: list[tuple[str, list]]) -> None:
            for raw, below in items:
                n = self.child(node, marked(raw)[0])
                n.preload = self.merge_preload(n, Preload(how, options))
                if how == "through_join" and not n.joined:
                    raise QueryError(f"preload_through_join: {'.'.join(n.path)} is not joined")
                add(n, below)

        add(self.root, parse_paths(spec))

    @staticmethod
    def merge_preload(node: Node, new: Preload) -> Preload:
        old, where = node.preload, ".".join(node.path)
        if old is None:
            return new
        if old.options and new.options and old.options != new.options:
            raise QueryError(f"preload of {where}: two different scopes")
        options = old.options or new.options
        how = "through_join" if "through_join" in (old.how, new.how) else "separate"
        if options and how == "through_join":
            raise QueryError(f"preload of {where}: a scope can't go through a join")
        return Preload(how, options)

    def find(self, token: str) -> tuple[Node, str]:
        """A token's node and field. One association is looked for anywhere in the tree; more are a path from the root."""
        name, path = split_token(token)
        if not path:
            return self.root, name
        if len(path) == 1:
            found = [n for n in self.root.walk() if n.joined and n.path and n.path[-1] == path[0]]
            if len(found) > 1:
                raise BuildError(f"token {token!r} is ambiguous: {', '.join('@'.join(n.path) for n in found)}; give the whole path")
            node = found[0] if found else None
        else:
            node = self.root
            for p in path:
                node = node.children.get(p) if node else None
            node = node if node and node.joined else None
        if node is None:
            raise BuildError(f"token {token!r}: {'@'.join(path)} is not among this query's associations; name it in the operation's associations")
        return node, name

    def nodes(self) -> list[Node]:
        """Joined nodes, parents first."""
        return [n for n in self.root.walk() if n.joined]
