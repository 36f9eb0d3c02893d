"""Values and expressions of queries: tokens, literals, filters, aggregates."""

from relweave.functions.aggregates import Agg, array_agg, avg, count, count_distinct, max_, min_, sum_
from relweave.functions.refs import Args, FieldRef, Literal, args, field_ref, lit_, self_

__all__ = ["Agg", "Args", "FieldRef", "Literal", "args", "array_agg", "avg", "count", "count_distinct", "field_ref", "lit_", "max_", "min_", "self_", "sum_"]
