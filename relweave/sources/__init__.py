"""Schemas, their associations and where their rows come from."""

from relweave.sources.schema import Assoc, Registry, Schema, belongs_to, has_many, has_one, has_through, many_to_many

__all__ = ["Assoc", "Registry", "Schema", "belongs_to", "has_many", "has_one", "has_through", "many_to_many"]
