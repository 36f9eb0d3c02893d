"""The registered queries of the engine and the same in SQL, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.functions import array_agg, avg, count, count_distinct, lit_, max_, min_, self_, sum_
from relweave.sources.catalog import catalog

_FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None) -> Callable:
    """Registers a function of the catalog that gives a Query (or, with the session, a DataFrame) under its name."""

    def register(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            made = f(catalog(sf_dir))
            if callable(made):
                made = made(spark)
            return made if isinstance(made, DataFrame) else made.to_df(spark)

        _FOUND[f.__name__] = (run, sql)
        return f

    return register


@query("""SELECT c.c_mktsegment AS segment, count(*) AS n_orders, round(sum(o.o_totalprice), 2) AS total FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_name = 'NATION_1' GROUP BY c.c_mktsegment""")
def flagship(db):
    """Orders and their value by market segment, for one nation."""
    q = db.query("orders").inner_join({"customer": "nation"}).where({"n_name@nation": "NATION_1"}).group_by("customer", "c_mktsegment@customer")
    total = sum_("o_totalprice")
    return lambda spark: q.select({"segment": "c_mktsegment@customer", "n_orders": count(), "total": total}).to_df(spark).withColumn("total", F.round("total", 2))


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 1000 AND c_acctbal < 5000 AND c_nationkey <> 3")
def where_comparisons(db):
    return db.query("customer").where([("c_mktsegment", "BUILDING"), ("c_acctbal", "ge", 1000), ("c_acctbal", "less_than", 5000), ("c_nationkey", "ne", 3)]).select(["c_custkey", "c_name"])


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 AND o_totalprice <= 300000 AND o_orderstatus IS NOT NULL")
def where_gt_le_not_null(db):
    return db.query("orders").where([("o_totalprice", "gt", 200000), ("o_totalprice", "le", 300000), ("o_orderstatus", "ne", None)]).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
def where_in_lists(db):
    return db.query("customer").where([("c_mktsegment", "in", ["BUILDING", "MACHINERY"]), ("c_nationkey", "not_in", [1, 2, 3])]).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 100000) OR (o_orderpriority = '1-URGENT') OR (o_orderstatus = 'P')")
def where_or_groups(db):
    return db.query("orders").where([], [("o_orderstatus", "F"), ("o_totalprice", "gt", 100000)], or_=[[("o_orderpriority", "1-URGENT")], [], [("o_orderstatus", "P")]]).select("o_orderkey")


@query("SELECT c_custkey FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_name = 'NATION_5' OR (c.c_acctbal < 0 AND c.c_mktsegment = 'FURNITURE')")
def where_any_with_join(db):
    return db.query("customer").where_any("nation", [[("n_name@nation", "NATION_5")], [("c_acctbal", "lt", 0), ("c_mktsegment", "FURNITURE")]]).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 9000")
def maybe_where(db):
    return db.query("customer").maybe_where(True, ("c_acctbal", "gt", 9000)).maybe_where(False, ("c_acctbal", "lt", 0)).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE starts_with(c_name, 'Customer#00000') AND ends_with(c_name, '7') AND contains(lower(c_name), 'omer#')")
def where_text(db):
    return db.query("customer").where([("c_name", "starts_with", "Customer#00000"), ("c_name", "ends_with", "7"), ("c_name", "contains", "OMER#", {"case": "insensitive"})]).select("c_custkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name LIKE 'NATION\\_1%' ESCAPE '\\' AND n_name ILIKE 'nation%2'")
def where_like(db):
    return db.query("nation").where([("n_name", "like", "NATION\\_1%"), ("n_name", "ilike", "nation%2")]).select(["n_nationkey", "n_name"])


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal > s_suppkey AND s_nationkey <= s_suppkey")
def where_field_to_field(db):
    return db.query("supplier").where([("s_acctbal", "gt", self_("s_suppkey")), ("s_nationkey", "le", self_("s_suppkey"))]).select("s_suppkey")


@query("SELECT o.o_orderkey FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_name LIKE '%' || o.o_custkey::VARCHAR || '%' AND o.o_totalprice > c.c_acctbal")
def where_field_across_join(db):
    text = lambda resolve: resolve("c_name@customer").contains(resolve("o_custkey").cast("string"))
    return db.query("orders").where("customer", [text, ("o_totalprice", "gt", self_("c_acctbal@customer"))]).select("o_orderkey")


@query("SELECT o.o_orderkey, l.l_linenumber FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus LIKE concat(l.l_returnflag, '%') OR o.o_orderpriority ILIKE concat('%', l.l_linestatus, '%') OR o.o_orderstatus LIKE concat('%', l.l_linestatus)")
def where_field_text(db):
    starts = [("o_orderstatus", "starts_with", self_("l_returnflag@lineitems"))]
    holds = [("o_orderpriority", "contains", self_("l_linestatus@lineitems"), {"case": "insensitive"})]
    ends = [("o_orderstatus", "ends_with", self_("l_linestatus@lineitems"))]
    return db.query("orders").where_any("lineitems", [starts, holds, ends]).select({"o_orderkey": "o_orderkey", "l_linenumber": "l_linenumber@lineitems"})


@query("SELECT s.s_suppkey, n.n_name FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE lower(s.s_name) LIKE '%' || right(n.n_name, 1)")
def where_custom_function(db):
    match = lambda resolve: F.lower(resolve("s_name")).endswith(F.right(resolve("n_name@nation"), F.lit(1)))
    return db.query("supplier").where("nation", [match]).select({"s_suppkey": "s_suppkey", "n_name": "n_name@nation"})


@query("SELECT doc_id FROM documents WHERE list_contains(string_split(text, ' '), 'the') AND NOT list_contains(string_split(text, ' '), 'of')")
def where_array_include_exclude(db):
    spark_of = lambda spark: spark.read.parquet(db["documents"].source).select("doc_id", F.split("text", " ").alias("words"))
    return lambda spark: db.wrap("documents", spark_of(spark)).where([("words", "include", "the"), ("words", "exclude", "of")]).select("doc_id").to_df(spark)


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def where_in_subquery(db):
    rich = db.query("orders").where(("o_totalprice", "gt", 400000)).select("o_custkey")
    return db.query("customer").where(("c_custkey", "in", rich)).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def where_not_in_subquery(db):
    return db.query("customer").where(("c_custkey", "not_in", db.query("events").subquery({"select": "user_id"}))).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase') OR c_acctbal > 9000 AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def where_not_in_or(db):
    bought, poor = db.query("events").where(("event_type", "purchase")).select("user_id"), db.query("supplier").where(("s_acctbal", "lt", 0)).select("s_nationkey")
    return db.query("customer").where_any([[("c_custkey", "not_in", bought)], [("c_acctbal", "gt", 9000), ("c_nationkey", "not_in", poor)]]).select("c_custkey")


@query("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND (o.o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') OR o.o_totalprice > 300000)")
def join_left_on_not_in(db):
    returned = db.query("lineitem").where(("l_returnflag", "R")).select("l_orderkey")
    return db.query("customer").left_join("orders", [("o_orderkey@orders", "not_in", returned)], or_=[[("o_totalprice@orders", "gt", 300000)]]).select({"c_custkey": "c_custkey", "o_orderkey": "o_orderkey@orders"})


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P' AND o.o_totalprice > 150000)")
def where_has(db):
    return db.query("customer").where_has("orders", [("o_orderstatus@orders", "P"), ("o_totalprice@orders", "gt", 150000)]).select("c_custkey")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.c_custkey)")
def where_missing(db):
    return db.query("customer").where_missing("events").select("c_custkey")


@query("""SELECT n_nationkey FROM nation n WHERE EXISTS (SELECT 1 FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey
WHERE c.c_nationkey = n.n_nationkey AND c.c_mktsegment = 'BUILDING' AND o.o_totalprice > 100000 AND (o.o_orderstatus = 'F' OR o.o_orderpriority = '1-URGENT'))""")
def where_exists_nested(db):
    return db.query("nation").where_exists_subquery({"customers": "orders"}, scope=[("c_mktsegment@customers", "BUILDING")], where=[("o_totalprice@orders", "gt", 100000)], where_any=[[("o_orderstatus@orders", "F")], [("o_orderpriority@orders", "1-URGENT")]]).select("n_nationkey")


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice < c.c_acctbal)")
def where_exists_root_field(db):
    return db.query("customer").where_exists_subquery("orders", scope=[], where=[("o_totalprice@orders", "lt", self_("c_acctbal"))]).select("c_custkey")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_custkey = c.c_custkey AND l.l_returnflag = 'R')")
def where_not_exists_nested(db):
    return db.query("customer").where_not_exists_subquery({"orders": "lineitems"}, scope=[], where=[("l_returnflag@lineitems", "R")]).select("c_custkey")


@query("SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_acctbal < 0 AND o.o_totalprice > 200000")
def wrap_joined(db):
    """A frame that holds the orders' customers: they are not joined again, the nations are."""

    def run(spark: SparkSession) -> DataFrame:
        orders, customers = (spark.read.parquet(db[t].source) for t in ("orders", "customer"))
        frame = orders.join(customers, orders["o_custkey"] == customers["c_custkey"], "left")
        q = db.wrap("orders", frame, {"customer": {c: c for c in customers.columns}})
        return q.where("customer", [("c_acctbal@customer", "lt", 0), ("o_totalprice", "gt", 200000)]).where({"customer": "nation!"}, []).select({"o_orderkey": "o_orderkey", "c_name": "c_name@customer", "n_name": "n_name@nation"}).to_df(spark)

    return run


@query("SELECT c.c_custkey, n.n_name, r.r_name FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey WHERE c.c_acctbal > 8000")
def join_implicit_left(db):
    return db.query("customer").where(("c_acctbal", "gt", 8000)).select({"nation": "region"}, {"c_custkey": "c_custkey", "n_name": "n_name@nation", "r_name": "r_name@region"})


@query("SELECT c.c_custkey, e.event_id FROM customer c JOIN events e ON e.user_id = c.c_custkey WHERE e.event_type = 'purchase'")
def join_inner(db):
    return db.query("customer").inner_join("events").where(("event_type@events", "purchase")).select({"c_custkey": "c_custkey", "event_id": "event_id@events"})


@query("SELECT c.c_custkey, e.event_id FROM customer c LEFT JOIN events e ON e.user_id = c.c_custkey AND (e.event_type = 'error' OR e.value > 90)")
def join_left_on(db):
    return db.query("customer").left_join("events", [("event_type@events", "error")], or_=[[("value@events", "gt", 90)]]).select({"c_custkey": "c_custkey", "event_id": "event_id@events"})


@query("SELECT n.n_name, c.c_custkey, e.event_id FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey LEFT JOIN events e ON e.user_id = c.c_custkey AND e.event_type = 'view'")
def join_left_leaf(db):
    return db.query("nation").left_join_leaf({"customers": "events"}, [("event_type@events", "view")]).select({"n_name": "n_name", "c_custkey": "c_custkey@customers", "event_id": "event_id@events"})


@query("SELECT c.c_custkey, o.o_orderkey, l.l_quantity FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_quantity > 48")
def join_left_path(db):
    return db.query("customer").left_join_path({"orders": "lineitems"}, [("l_quantity@lineitems", "gt", 48)]).select({"c_custkey": "c_custkey", "o_orderkey": "o_orderkey@orders", "l_quantity": "l_quantity@lineitems"})


@query("SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_totalprice > 450000")
def join_markers(db):
    return db.query("orders").where({"customer!": "nation?"}, [("o_totalprice", "gt", 450000)]).select({"o_orderkey": "o_orderkey", "c_name": "c_name@customer", "n_name": "n_name@nation"})


@query("SELECT n.n_name, count(o.o_orderkey) AS n_orders FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY n.n_name")
def join_has_through(db):
    return db.query("nation").group_by("customer_orders", "n_name").select({"n_name": "n_name", "n_orders": count("o_orderkey@customer_orders")})


@query("SELECT s.s_suppkey, count(p.p_partkey) AS n FROM supplier s LEFT JOIN lineitem l ON l.l_suppkey = s.s_suppkey LEFT JOIN part p ON p.p_partkey = l.l_partkey GROUP BY s.s_suppkey")
def join_many_to_many(db):
    return db.query("supplier").group_by("parts", "s_suppkey").select({"s_suppkey": "s_suppkey", "n": count("p_partkey@parts")})


@query("SELECT count(DISTINCT o_custkey) AS count FROM orders")
def select_aggregate(db):
    return db.query("orders").select(count_distinct("o_custkey"))


@query("SELECT o_orderkey AS key, o_totalprice > 200000 AS dear FROM orders")
def select_function(db):
    return db.query("orders").select(lambda r: {"key": r("o_orderkey"), "dear": r("o_totalprice") > 200000})


@query("SELECT c_custkey AS _1, c_name AS _2, 7 AS _3, 'x' AS _4 FROM customer")
def select_tuple(db):
    return db.query("customer").select(("c_custkey", "c_name", 7, lit_("x")))


@query("SELECT c_custkey AS key, upper(c_mktsegment) AS segment, 1 AS one, c_acctbal AS balance FROM customer")
def select_merge(db):
    return db.query("customer").select({"key": "c_custkey", "segment": lambda r: F.upper(r("c_mktsegment"))}).select_merge({"one": lit_(1)}).select_merge({"balance": "c_acctbal"})


@query("SELECT s.*, n.n_name AS nation FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey")
def select_merge_root(db):
    return db.query("supplier").select_merge("nation", {"nation": "n_name@nation"})


@query("SELECT o_orderstatus AS status, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice), 4) AS mean, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus")
def group_aggregates(db):
    q = db.query("orders").group_by("o_orderstatus").select({"status": "o_orderstatus", "n": count(), "lo": min_("o_totalprice"), "hi": max_("o_totalprice"), "mean": avg("o_totalprice"), "customers": count_distinct("o_custkey")})
    return lambda spark: q.to_df(spark).withColumn("mean", F.round("mean", 4))


@query("SELECT count(*) AS n, count(e.event_id) AS with_event, CAST(sum(c.c_custkey) AS BIGINT) AS keys FROM customer c LEFT JOIN events e ON e.user_id = c.c_custkey")
def global_aggregates(db):
    return db.query("customer").select("events", {"n": count(), "with_event": count("event_id@events"), "keys": sum_("c_custkey")})


@query("SELECT n.n_name, c.c_mktsegment, count(*) AS n FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name, c.c_mktsegment HAVING count(*) >= 10 AND avg(c.c_acctbal) > 4000 OR min(c.c_acctbal) > 0")
def group_having_or(db):
    return db.query("customer").group_by("nation", ["n_name@nation", "c_mktsegment"]).having([(count(), "ge", 10), (avg("c_acctbal"), "gt", 4000)], or_=[[(min_("c_acctbal"), "gt", 0)]]).select({"n_name": "n_name@nation", "c_mktsegment": "c_mktsegment", "n": count()})


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15 OR max(o_totalprice) > 490000")
def group_having_any(db):
    return db.query("orders").group_by("o_custkey").having_any([[(count(), "gt", 15)], [(max_("o_totalprice"), "gt", 490000)]]).select({"o_custkey": "o_custkey", "n": count()})


@query("SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1")
def group_by_function(db):
    year = lambda r: F.year(r("o_orderdate")).cast("long")
    return db.query("orders").group_by(year).select({"year": year, "n": count()})


@query("SELECT c.c_custkey, c.c_name, c.c_nationkey, c.c_acctbal, c.c_mktsegment, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY ALL")
def group_by_primary_key(db):
    return db.query("customer").group_by("orders", "c_custkey").select({k: k for k in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")} | {"n": count("o_orderkey@orders")})


@query("""SELECT o_custkey, array_to_string(array_agg(o_orderkey ORDER BY o_totalprice DESC, o_orderkey), ',') AS keys,
array_to_string(list_sort(array_agg(DISTINCT o_orderstatus)), ',') AS statuses, array_to_string(array_agg(o_orderkey ORDER BY o_orderkey) FILTER (WHERE o_orderstatus = 'P'), ',') AS pending FROM orders GROUP BY o_custkey""")
def group_array_agg(db):
    q = db.query("orders").group_by("o_custkey").select({"o_custkey": "o_custkey", "keys": array_agg("o_orderkey", order_by=[("desc", "o_totalprice"), ("asc", "o_orderkey")]), "statuses": array_agg("o_orderstatus", distinct=True, order_by=[("asc", "o_orderstatus")]), "pending": array_agg("o_orderkey", order_by=[("asc", "o_orderkey")], filter=[("o_orderstatus", "P")])})
    return lambda spark: q.to_df(spark).select("o_custkey", *[F.when(F.col(c).isNotNull(), F.concat_ws(",", F.col(c).cast("array<string>"))).alias(c) for c in ("keys", "statuses", "pending")])


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def distinct_rows(db):
    return db.query("customer").distinct(True).select(["c_mktsegment", "c_nationkey"])


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
def distinct_on(db):
    return db.query("orders").distinct("o_custkey").order_by([("desc", "o_orderdate"), ("asc", "o_orderkey")]).select(["o_custkey", "o_orderkey", "o_totalprice"])


@query("SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000) ORDER BY c_custkey LIMIT 20 OFFSET 5")
def distinct_roots(db):
    return db.query("customer").inner_join("orders").where(("o_totalprice@orders", "gt", 300000)).distinct_roots().order_by([("asc", "c_custkey")]).limit(20).offset(5).select(["c_custkey", "c_name"])


@query("SELECT p_partkey, p_name FROM part ORDER BY p_retailprice DESC NULLS FIRST, p_partkey LIMIT 25 OFFSET 10")
def order_limit_offset(db):
    return db.query("part").order_by([("desc", "p_retailprice")]).order_by([("asc", "p_partkey")]).limit(7).limit(" 25 ").offset(10).select(["p_partkey", "p_name"])


@query("SELECT c_custkey FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey ORDER BY n.n_name DESC NULLS LAST, length(c.c_mktsegment), c.c_custkey LIMIT 40")
def order_by_assoc_and_function(db):
    return db.query("customer").order_by("nation", [("desc_nulls_last", "n_name@nation"), ("asc", lambda r: F.length(r("c_mktsegment"))), ("asc", "c_custkey")]).maybe_order_by(False, [("asc", "c_name")]).limit(40).select("c_custkey")


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def top_n_per(db):
    return db.query("orders").top_n_per(partition_by="o_custkey", order_by=[("desc", "o_totalprice"), ("asc", "o_orderkey")], n=3).select(["o_orderkey", "o_custkey"])


@query("SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus <> 'F') WHERE rn = 1 AND o_totalprice > 100000")
def first_per_then_where(db):
    return db.query("orders").where(("o_orderstatus", "ne", "F")).first_per(partition_by=["o_custkey"], order_by=[("desc", "o_orderdate"), ("desc", "o_orderkey")]).where(("o_totalprice", "gt", 100000)).select("o_orderkey")


@query("""SELECT c_custkey FROM (SELECT c.c_custkey, row_number() OVER (PARTITION BY c.c_nationkey ORDER BY count(o.o_orderkey) DESC, c.c_custkey) AS rn
FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey, c.c_nationkey) WHERE rn <= 2""")
def top_n_per_by_count(db):
    return db.query("customer").group_by("orders", "c_custkey").top_n_per(partition_by="c_nationkey", order_by=[("desc", count("o_orderkey@orders")), ("asc", "c_custkey")], n=2).select("c_custkey")


@query("""SELECT c.c_custkey, e.event_id, e.event_type FROM customer c LEFT JOIN LATERAL
(SELECT * FROM events x WHERE x.user_id = c.c_custkey AND x.value > 10 ORDER BY x.ts DESC, x.event_id DESC LIMIT 1) e ON true""")
def left_join_latest(db):
    q = db.query("customer").left_join_latest("events", order_by=[("desc", "ts"), ("desc", "event_id")], where=[("value", "gt", 10)])
    return lambda spark: q.to_df(spark).select("customer.c_custkey", "events.event_id", "events.event_type")


@query("""SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN LATERAL
(SELECT * FROM orders x WHERE x.o_custkey = c.c_custkey ORDER BY x.o_totalprice DESC, x.o_orderkey LIMIT 2) o ON true""")
def left_join_top_n(db):
    q = db.query("customer").left_join_top_n("orders", n=2, order_by=[("desc", "o_totalprice"), ("asc", "o_orderkey")])
    return lambda spark: q.to_df(spark).select("customer.c_custkey", "orders.o_orderkey")


@query("""SELECT n.n_nationkey, x.c_custkey FROM nation n LEFT JOIN LATERAL (SELECT c.c_custkey FROM customer c LEFT JOIN nation m ON c.c_nationkey = m.n_nationkey
WHERE c.c_nationkey = n.n_nationkey AND m.n_regionkey = 1 ORDER BY c.c_acctbal DESC, c.c_custkey LIMIT 3) x ON true""")
def left_join_top_n_child_scope(db):
    q = db.query("nation").left_join_top_n("customers", n=3, order_by=[("desc", "c_acctbal"), ("asc", "c_custkey")], where=[("n_regionkey@nation", 1)], child_assoc_fields="nation")
    return lambda spark: q.to_df(spark).select("nation.n_nationkey", "customers.c_custkey")


def _listed(df: DataFrame, key: str, array: str, field: str, out: str) -> DataFrame:
    return df.select(key, F.concat_ws(",", F.transform(array, lambda x: x[field].cast("string"))).alias(out))


@query("SELECT c.c_custkey, coalesce(string_agg(o.o_orderkey::VARCHAR, ',' ORDER BY o.o_orderkey), '') AS keys FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey")
def preload_separate(db):
    q = db.query("customer").preload_separate(["orders", "nation"])
    return lambda spark: _listed(q.to_df(spark), "c_custkey", "orders", "o_orderkey", "keys")


@query("SELECT c.c_custkey, coalesce(string_agg(o.o_orderkey::VARCHAR, ',' ORDER BY o.o_totalprice DESC, o.o_orderkey), '') AS keys FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O' GROUP BY c.c_custkey")
def preload_separate_scoped(db):
    q = db.query("customer").preload_separate_scoped("orders", where=[("o_orderstatus", "O")], order_by=[("desc", "o_totalprice"), ("asc", "o_orderkey")])
    return lambda spark: _listed(q.to_df(spark), "c_custkey", "orders", "o_orderkey", "keys")


@query("SELECT c.c_custkey, string_agg(o.o_orderkey::VARCHAR, ',' ORDER BY o.o_orderkey) AS keys FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 200000 GROUP BY c.c_custkey")
def preload_through_join(db):
    q = db.query("customer").inner_join("orders").where(("o_totalprice@orders", "gt", 200000)).preload_through_join("orders")
    return lambda spark: _listed(q.to_df(spark), "c_custkey", "orders", "o_orderkey", "keys")


@query("SELECT r.r_regionkey, string_agg(n.n_nationkey || ':' || k, ',' ORDER BY n.n_nationkey) AS nations FROM region r JOIN (SELECT n.n_nationkey, n.n_regionkey, count(s.s_suppkey) AS k FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY ALL) n ON n.n_regionkey = r.r_regionkey GROUP BY r.r_regionkey")
def preload_nested(db):
    q = db.query("region").preload_separate({"nations": "suppliers"})
    return lambda spark: q.to_df(spark).select("r_regionkey", F.concat_ws(",", F.transform("nations", lambda n: F.concat_ws(":", n["n_nationkey"].cast("string"), F.size(n["suppliers"]).cast("string")))).alias("nations"))


@query("""SELECT n.n_nationkey, string_agg(c.c_custkey || ':' || k, ',' ORDER BY c.c_custkey) AS customers FROM nation n
JOIN (SELECT c.c_custkey, c.c_nationkey, count(o.o_orderkey) AS k FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 5000 GROUP BY ALL) c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_nationkey""")
def preload_mixed(db):
    """The joined customers, and beneath them their orders from a query of their own."""
    q = db.query("nation").inner_join("customers").where(("c_acctbal@customers", "gt", 5000)).preload_through_join("customers").preload_separate({"customers": "orders"})
    return lambda spark: q.to_df(spark).select("n_nationkey", F.concat_ws(",", F.transform("customers", lambda c: F.concat_ws(":", c["c_custkey"].cast("string"), F.size(c["orders"]).cast("string")))).alias("customers"))


@query("""SELECT c.c_custkey, coalesce(string_agg(o.o_orderkey::VARCHAR, ',' ORDER BY o.o_orderkey), '') AS keys
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 2) c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey""")
def preload_after_top_n(db):
    q = db.query("customer").preload_separate("orders").top_n_per(partition_by="c_nationkey", order_by=[("desc", "c_acctbal"), ("asc", "c_custkey")], n=2)
    return lambda spark: _listed(q.to_df(spark), "c_custkey", "orders", "o_orderkey", "keys")


@query("SELECT s.s_suppkey, array_to_string(list_sort(array_agg(DISTINCT l.l_partkey) FILTER (l.l_partkey IS NOT NULL)), ',') AS parts FROM supplier s LEFT JOIN lineitem l ON l.l_suppkey = s.s_suppkey WHERE s.s_acctbal > 9000 GROUP BY s.s_suppkey")
def preload_many_to_many(db):
    q = db.query("supplier").where(("s_acctbal", "gt", 9000)).preload_separate("parts")
    return lambda spark: _listed(q.to_df(spark), "s_suppkey", "parts", "p_partkey", "parts")


def _page(spark: SparkSession, entries: list[dict], *columns: str) -> DataFrame:
    return spark.createDataFrame([tuple(e[c] for c in columns) for e in entries], ", ".join(f"{c} bigint" for c in columns))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def paginate_cursor(db):
    """The third page."""
    q = db.query("orders").order_by([("desc", "o_orderdate")])

    def run(spark: SparkSession) -> DataFrame:
        page = q.paginate(spark, page_size=50)
        for _ in range(2):
            page = q.paginate(spark, page_size=50, cursor=page.pagination["cursor_for_entries_after"])
        return _page(spark, page.entries, "o_orderkey", "o_custkey")

    return run


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 30 OFFSET 0")
def paginate_before(db):
    """Back to the first page from the second."""
    q = db.query("orders").order_by([("asc", "o_totalprice")])

    def run(spark: SparkSession) -> DataFrame:
        page = q.paginate(spark, page_size=30)
        page = q.paginate(spark, page_size=30, cursor=page.pagination["cursor_for_entries_after"])
        page = q.paginate(spark, page_size=30, cursor=page.pagination["cursor_for_entries_before"], direction="before")
        return _page(spark, page.entries, "o_orderkey", "o_custkey")

    return run


@query("SELECT DISTINCT c.c_custkey FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 350000 ORDER BY c.c_custkey LIMIT 15 OFFSET 30")
def paginate_keys_first(db):
    """The second page of roots that a to-many join repeats."""
    q = db.query("customer").inner_join("orders").where(("o_totalprice@orders", "gt", 350000))

    def run(spark: SparkSession) -> DataFrame:
        page = q.paginate(spark, page_size=30)
        page = q.paginate(spark, page_size=15, cursor=page.pagination["cursor_for_entries_after"])
        return _page(spark, page.entries, "c_custkey")

    return run


@query("SELECT p_partkey, nullif(p_size % 5, 0) AS k FROM part ORDER BY k DESC NULLS FIRST, p_partkey DESC LIMIT 40 OFFSET 40")
def paginate_nulls(db):
    """The second page of an order whose first field has nulls, which the keyset predicate must step over; a field that is named
    again orders nothing."""

    def run(spark: SparkSession) -> DataFrame:
        parts = spark.read.parquet(db["part"].source).withColumn("k", F.expr("cast(nullif(p_size % 5, 0) as bigint)"))
        q = db.wrap("part", parts).order_by([("desc", "k"), ("desc", "p_partkey"), ("asc", "k")])
        page = q.paginate(spark, page_size=40)
        page = q.paginate(spark, page_size=40, cursor=page.pagination["cursor_for_entries_after"])
        return _page(spark, page.entries, "p_partkey", "k")

    return run


@query("SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 100")
def paginate_default_size(db):
    return lambda spark: _page(spark, db.query("supplier").paginate(spark).entries, "s_suppkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def paginate_offset(db):
    q = db.query("customer").where(("c_mktsegment", "BUILDING")).order_by([("desc", "c_acctbal")]).offset(40)
    return lambda spark: _page(spark, q.paginate_offset(spark, page_size=20).entries, "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' AND (c_acctbal > 5000 OR c_nationkey = 1) ORDER BY c_custkey LIMIT 10 OFFSET 3")
def from_opts_boundary(db):
    options = [("where", [("c_mktsegment", "MACHINERY")]), ("where_any", [[("c_acctbal", "gt", 5000)], [("c_nationkey", 1)]]), ("order_by", [("asc", "c_custkey")]), ("limit", "10"), ("offset", 3)]
    return db.query("customer").from_opts(options).select("c_custkey")


@query("SELECT n.n_name, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_acctbal > 0 GROUP BY n.n_name HAVING count(*) > 20")
def from_opts_full(db):
    from relweave.functions import args

    options = [("inner_join", "nation"), ("where", ("c_acctbal", "gt", 0)), ("group_by", args("nation", "n_name@nation")), ("having", [(count(), "gt", 20)]), ("select", {"n_name": "n_name@nation", "n": count()})]
    return db.query("customer").from_opts(options, "full")


@query("SELECT c.c_custkey, n.n_name, count(o.o_orderkey) AS n_orders FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P' GROUP BY ALL")
def from_opts_includes(db):
    allowed = {"nation": "nation", "pending": ("orders", {"where": [("o_orderstatus", "P")]})}
    q = db.query("customer").from_opts([("include", ["pending", "nation"])], includes=allowed)
    return lambda spark: q.to_df(spark).select("c_custkey", F.col("nation.n_name").alias("n_name"), F.size("orders").cast("long").alias("n_orders"))


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1995 AND o_totalprice >= 100000")
def extension(db):
    """An operation that the caller defines, among options."""
    from relweave.operators.options import Extension

    more = Extension()

    @more.operation(boundary=True)
    def in_year(query, year):
        return query.where(lambda r: F.year(r("o_orderdate")) == year)

    return db.query("orders").from_opts([("in_year", 1995), ("where", [("o_totalprice", "ge", 100000)])], extension=more).select("o_orderkey")


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY length(text) DESC, conv_id, turn) AS rn FROM conversations) WHERE rn <= 5")
def top_n_per_composite_key(db):
    return db.query("conversations").top_n_per(partition_by="role", order_by=[("desc", lambda r: F.length(r("text"))), ("asc", "conv_id"), ("asc", "turn")], n=5).select(["conv_id", "turn"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: run for k, (run, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _FOUND.items() if sql}
