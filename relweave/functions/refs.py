"""Tokens (``field@assoc@nested``), references to fields as values, literals, packed arguments."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from relweave.errors import BuildError


@dataclass(frozen=True)
class FieldRef:
    """A token used as a value: the row's own field instead of a constant."""

    token: str


def field_ref(token: str) -> FieldRef:
    return FieldRef(token)


self_ = field_ref


@dataclass(frozen=True)
class Literal:
    value: Any


def lit_(value: Any) -> Literal:
    return Literal(value)


@dataclass(frozen=True)
class Args:
    """Several arguments of one operation, where options give one value per operation."""

    values: tuple


def args(*values: Any) -> Args:
    if len(values) < 2 or any(v is None for v in values):
        raise BuildError("args() packs two or more arguments, none of them None")
    return Args(values)


def split_token(token: str) -> tuple[str, tuple[str, ...]]:
    """A token's field and its associations."""
    if not isinstance(token, str):
        raise BuildError(f"expected a token, got {token!r}")
    name, *path = token.split("@")
    if not name or not all(path):
        raise BuildError(f"token {token!r} has an empty part")
    return name, tuple(path)


DIRECTIONS = {
    "asc": "asc_nulls_last",
    "desc": "desc_nulls_first",
    "asc_nulls_first": "asc_nulls_first",
    "asc_nulls_last": "asc_nulls_last",
    "desc_nulls_first": "desc_nulls_first",
    "desc_nulls_last": "desc_nulls_last",
}


def direction(name: str) -> str:
    """The direction with its place of nulls spelt out; bare ones put nulls after all values in ascending order."""
    if name not in DIRECTIONS:
        raise BuildError(f"unknown direction {name!r}")
    return DIRECTIONS[name]
