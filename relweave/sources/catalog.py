"""The schema graph over the Parquet tables that the queries run on."""

from __future__ import annotations

from relweave.sources.schema import Registry, Schema, belongs_to, has_many, has_one, has_through, many_to_many


def catalog(sf_dir: str) -> Registry:
    at = lambda name: f"{sf_dir}/{name}.parquet"
    return Registry(
        Schema("region", at("region"), ("r_regionkey",), {"nations": has_many("nation", "r_regionkey", "n_regionkey")}),
        Schema("nation", at("nation"), ("n_nationkey",), {
            "region": belongs_to("region", "n_regionkey", "r_regionkey"),
            "customers": has_many("customer", "n_nationkey", "c_nationkey"),
            "suppliers": has_many("supplier", "n_nationkey", "s_nationkey"),
            "customer_orders": has_through("customers", "orders"),
        }),
        Schema("customer", at("customer"), ("c_custkey",), {
            "nation": belongs_to("nation", "c_nationkey", "n_nationkey"),
            "orders": has_many("orders", "c_custkey", "o_custkey"),
            "events": has_many("events", "c_custkey", "user_id"),
        }),
        Schema("supplier", at("supplier"), ("s_suppkey",), {
            "nation": belongs_to("nation", "s_nationkey", "n_nationkey"),
            "lineitems": has_many("lineitem", "s_suppkey", "l_suppkey"),
            "parts": many_to_many("part", "s_suppkey", "p_partkey", "lineitem", "l_suppkey", "l_partkey"),
        }),
        Schema("part", at("part"), ("p_partkey",), {"lineitems": has_many("lineitem", "p_partkey", "l_partkey")}),
        Schema("orders", at("orders"), ("o_orderkey",), {
            "customer": belongs_to("customer", "o_custkey", "c_custkey"),
            "lineitems": has_many("lineitem", "o_orderkey", "l_orderkey"),
        }),
        Schema("lineitem", at("lineitem"), (), {
            "order": belongs_to("orders", "l_orderkey", "o_orderkey"),
            "part": belongs_to("part", "l_partkey", "p_partkey"),
            "supplier": belongs_to("supplier", "l_suppkey", "s_suppkey"),
        }),
        Schema("events", at("events"), ("event_id",), {"customer": belongs_to("customer", "user_id", "c_custkey")}),
        Schema("documents", at("documents"), ("doc_id",), {"label": has_one("labels", "doc_id", "doc_id")}),
        Schema("labels", at("labels"), ("doc_id",), {"document": belongs_to("documents", "doc_id", "doc_id")}),
        Schema("pages", at("pages"), ("page_id",)),
        Schema("benchmark", at("benchmark"), ("item_id",)),
        Schema("conversations", at("conversations"), ("conv_id", "turn")),
        Schema("embeddings", at("embeddings"), ("vec_id",)),
    )
