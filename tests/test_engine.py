import pytest
from demo import demo
from pyspark.sql import functions as F

from relweave.errors import BuildError, QueryError
from relweave.functions import args, array_agg, avg, count, count_distinct, field_ref, lit_, max_, min_, self_, sum_
from relweave.operators.options import Extension


@pytest.fixture(scope="module")
def db(spark):
    return demo(spark)


def names(q):
    return sorted(r[0] for r in q.select("name").to_df().collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("filters", "n"), [
    ([("name", "ne", "Teo")], 9), ([("name", "contains", "mar", {"case": "i"})], 2), ([("name", "contains", "mar")], 0), ([("name", "contains", "ra")], 3), ([("name", "starts_with", "50%", {"case": "insensitive"})], 1),
    ([("name", "in", ["Mara", "Teo"])], 2), ([("name", "not_in", ["Mara", "Teo"])], 8), ({"email": None}, 1), ([("email", "ne", None)], 9), ([("name", self_("alias"))], 4),
    ([("email", "contains", self_("name"), {"case": "i"})], 6), ([("email", "starts_with", self_("name"), {"case": "i"})], 5), ([("name", "in", [])], 0), ([("email", "not_in", [])], 10),
    # A field's backslash is literal, and no alias is like the empty string.
    ([("alias", "contains", self_("name"))], 5), ([("name", "starts_with", self_("alias"))], 7), ([("name", "ends_with", self_("alias"))], 5),
    ([("email", "not_in", ["x", None])], 0), ([("id", "greater_than_or_equal_to", 19)], 2), ([lambda r: F.length(r("name")) == 4], 4), ((("name", "  Teo ")), 1), ([], 10),
    ([("name", "like", "%\\%%")], 1), ([("name", "ilike", "MARA")], 1), ([("name", "ends_with", "a")], 4), ([("email", "ne", "x")], 9),
])
def test_filters(db, filters, n):
    assert db.query("people").where(filters).to_df().count() == n


def test_filter_groups(db):
    q = db.query("people")
    assert q.where([], [], or_=[[("name", "Teo"), ("away", False)]]).to_df().count() == 1
    assert q.where([], [], or_=[[], []]).to_df().count() == 10
    assert names(q.where_any("grown", [[("name", "Ines")], [("title@grown", "contains", "LATE")]])) == ["Ines", "Mara"]
    assert q.where_any([]).to_df().count() == 10
    a = db.query("plots")
    assert a.where(("labels", "include", "pea")).to_df().count() == a.where(("labels", "exclude", "pea")).to_df().count() == 2
    with pytest.raises(BuildError):
        q.where_any([[]])
    with pytest.raises(BuildError):
        q.where_any(("name", "Teo"))


@pytest.mark.parametrize("filters", [None, [("name",)], [("name", "huh", 1)], [("name", "eq", 1, {"case": "i"})], [("name", "contains", 3)], [("name", "contains", "a", {"case": "x"})], [("name", "gt", None)], [(count(), "gt", 1)], [("name", "in", 3)], [("name", "include", self_("alias"))], [("nope", 1)], [("name@crew", 1)], [("@crew", 1)], [3]])
def test_bad_filters(db, filters):
    with pytest.raises(BuildError):
        db.query("people").where(filters).to_df()


def test_subqueries(db):
    ids = db.query("plots").subquery({"select": "grower_id"})
    assert names(db.query("people").where(("id", "in", ids))) == ["Bruno", "Mara", "Teo"]
    assert db.query("people").where(("id", "not_in", ids)).to_df().count() == 7
    assert db.query("people").where([], [("name", "Ines")], or_=[[("id", "in", ids)]]).to_df().count() == 4
    with_null = db.query("people").select("email")
    assert db.query("people").where(("email", "not_in", with_null)).to_df().count() == 0
    nobody = db.query("people").where(("id", 0)).select("email")
    assert db.query("people").where(("email", "not_in", nobody)).to_df().count() == 10
    known = db.query("people").where([("email", "ne", None), ("id", "lt", 15)]).select("email")
    some = db.query("people").where(("email", "not_in", known))
    assert some.to_df().count() == 6 and "BroadcastNestedLoop" not in plan(some.to_df())
    # Beside others, in an ON filter and in EXISTS, each for a subquery with nulls, without, and without rows.
    for sub, n in ((known, 7), (with_null, 1), (nobody, 10)):
        other = db.query("people").where_any([[("email", "not_in", sub)], [("name", "Ines")]])
        assert other.to_df().count() == n and "BroadcastNestedLoop" not in plan(other.to_df())
        joined = db.query("plots").left_join("grower", [("email@grower", "not_in", sub)], or_=[[("id@grower", 14)]]).select({"id": "id", "who": "name@grower"})
        want = {"known": [None, None, None, "Bruno", "Bruno"], "null": [None, None, None, "Bruno", "Bruno"], "nobody": ["Mara", "Mara", "Teo", "Bruno", "Bruno"]}
        assert [r["who"] for r in joined.order_by([("asc", "id")]).to_df().collect()] == want["known" if sub is known else "null" if sub is with_null else "nobody"]
        assert "BroadcastNestedLoop" not in plan(joined.to_df())
    left = db.query("people").left_join("grown", [("id@grown", "gt", 1), ("id", "not_in", db.query("stars").select("person_id"))]).where(("id", "in", [11, 13]))
    assert left.to_df().count() == 2 and "BroadcastNestedLoop" not in plan(left.to_df())
    unseen = db.query("people").where_has("grown", [("id@grown", "not_in", db.query("visits").select("plot_id"))])
    assert names(unseen) == ["Bruno"] and "BroadcastNestedLoop" not in plan(unseen.to_df())
    with pytest.raises(BuildError, match="one field"):
        db.query("people").where(("id", "in", db.query("people").select(["id", "name"]))).to_df()


def test_exists(db):
    q = db.query("people")
    has = q.where_exists_subquery({"grown": "visits"}, scope=[])
    assert names(has) == ["Bruno", "Mara", "Teo"]
    assert q.where_not_exists_subquery({"grown": "visits"}, scope=[]).to_df().count() == 7
    assert names(q.where_has("grown", [("title@grown", "contains", "R")])) == ["Bruno", "Mara", "Teo"]
    assert q.where_missing("grown").to_df().count() == 7
    assert names(q.where_exists_subquery("crew", scope=[("name@crew", self_("alias"))])) == []
    assert names(q.where_has("starred")) == ["Ines", "Olek"]
    assert names(q.where_has("received")) == ["Bruno", "Mara", "Teo"]
    assert "LeftSemi" in plan(has.to_df()) and "Cartesian" not in plan(has.to_df())
    for bad in (lambda: q.where_exists_subquery("crew"), lambda: q.where_exists_subquery("crew", scope=[("name", "x")]), lambda: q.where_exists("crew"), lambda: db.query("keyless").where_has("people"), lambda: q.where_has("crew", [("name", "tools")]), lambda: q.where_exists_subquery("crew?", scope=[]).to_df()):
        with pytest.raises(BuildError):
            bad()
    assert q.where_not_exists_subquery("crew", scope=[("name", "Teo")]).to_df().count() == 9


def test_joins(db):
    q = db.query("people")
    assert q.where({"crew": "rights"}, ("name@rights", "sow")).to_df().count() == 5
    assert q.inner_join("grown").to_df().count() == 5
    assert q.left_join("grown", [("title@grown", "contains", "LATE")]).to_df().count() == 10
    assert q.left_join_leaf({"grown": "visits"}).to_df().count() == 10
    assert q.left_join_path({"grown": "visits"}, [("id@visits", "gt", 6)]).to_df().count() == 14
    assert q.where("crew!", ("name@crew", "ne", "x")).to_df().count() == 9
    once = q.where("crew", ("name@crew", "water")).order_by("crew", [("asc", "name@crew")]).to_df()
    assert plan(once).count("Join") == 1
    assert q.inner_join("received").to_df().count() == 9
    assert q.inner_join("starred").to_df().count() == 5
    assert "title" not in q.inner_join("grown").to_df().columns
    for bad in (lambda: q.where({"crew?": "rights!"}, []).to_df(), lambda: q.inner_join("crew").where("crew?", []).to_df(), lambda: q.left_join({"crew": "rights"}), lambda: q.inner_join("nothing").to_df()):
        with pytest.raises(BuildError):
            bad()
    later = q.where(("name@crew", "water")).inner_join("crew")  # tokens see associations named later
    assert names(later) == ["Mara", "Teo"]
    ambiguous = db.query("plots").inner_join([{"grower": "crew"}, {"steward": "crew"}])
    with pytest.raises(BuildError, match="ambiguous"):
        ambiguous.where(("name@crew", "water")).to_df()
    assert ambiguous.where(("name@grower@crew", "water")).to_df().count() == 3
    assert ambiguous.where(("name@grower@crew", field_ref("name@steward@crew"))).to_df().count() == 2


def test_select(db, spark):
    q = db.query("people").where(("id", 11))
    assert q.select("name").to_df().collect() == [("Mara",)]
    assert tuple(q.select("crew", ("name", "name@crew", 5, lit_("x"), ("id", "away"))).to_df().first()) == ("Mara", "water", 5, "x", (11, False))
    assert q.select("crew", ["name", "name@crew"]).to_df().first().asDict() == {"name": "Mara", "name@crew": "water"}
    assert q.select({"n": "name"}).select_merge({"n": "email", "one": 1}).to_df().first().asDict() == {"n": "mara@garden.test", "one": 1}
    assert q.select_merge("crew", {"crew": "name@crew"}).to_df().first()["crew"] == "water"
    assert q.select(lambda r: {"up": F.upper(r("name"))}).to_df().first()["up"] == "MARA"
    assert q.select(count()).to_df().first()[0] == 1
    for bad in (lambda: q.select("name").select("id"), lambda: q.select_merge({"a": "name"}).select("id"), lambda: q.select(["name", "name"]).to_df(), lambda: q.select_merge("crew", "name@crew").to_df(), lambda: q.select_merge(["name", "name"]), lambda: q.select(None)):
        with pytest.raises(BuildError):
            bad()


def test_groups(db):
    q = db.query("people").group_by("crew", "name@crew")
    rows = lambda x: dict(map(tuple, x.select({"r": "name@crew", "n": count()}).to_df().collect()))
    assert rows(q) == {"water": 2, "seeds": 3, "tools": 4, None: 1}
    assert rows(q.having([(count(), "gt", 2)])) == {"seeds": 3, "tools": 4}
    assert rows(q.having_any([[(count(), "gt", 3)], [(count(), 1)]])) == {"tools": 4, None: 1}
    assert rows(q.having([(count("id"), "in", [1, 2]), ("name@crew", "ne", "tools")])) == {"water": 2}
    tools = db.query("people").where("crew", ("name@crew", "tools")).select({"a": min_("id"), "b": max_("id"), "c": sum_("id"), "d": avg("id"), "e": count_distinct("crew_id"), "f": count("email", "distinct")})
    assert tuple(tools.to_df().first()) == (13, 18, 64, 16.0, 1, 2)
    ranked = q.select({"r": "name@crew", "n": count()}).order_by([("desc", n := count()), ("asc", "name@crew")])
    assert [r["r"] for r in ranked.to_df().collect()] == ["tools", "seeds", "water", None] and n
    for bad in (lambda: q.select("name").to_df(), lambda: db.query("people").group_by({"a": 1}), lambda: db.query("people").group_by(None), lambda: db.query("people").having([(count(), "gt", 1)]).where([]).to_df() and None or db.query("people").having([("name", "x")]).to_df(), lambda: q.having([(count(), "like", 1)]).to_df(), lambda: q.having([(count(), "gt", 1, {})]).to_df(), lambda: count("id", "huh"), lambda: count(None, "distinct")):
        with pytest.raises(BuildError):
            bad()


def test_array_agg(db):
    one = lambda a: db.query("people").select({"x": a}).to_df().first()["x"]
    assert one(array_agg("email", order_by=[("asc", "id")]))[2] is None
    assert one(array_agg("crew_id", distinct=True, order_by=[("desc", "crew_id")])) == [None, 3, 2, 1]
    assert one(array_agg("email", distinct=True, order_by=[("asc", "email")]))[-1] is None
    assert one(array_agg("email", distinct=True, order_by=[("desc", "email")]))[0] is None
    assert one(array_agg("id", order_by=[("desc_nulls_last", "email"), ("asc", "id")]))[-1] == 13
    assert one(array_agg("id", filter=[("name", "nobody")])) is None
    assert one(array_agg("id", order_by=[("asc", "id")], filter=[("away", True)])) == [13, 16]
    for bad in (lambda: array_agg("id", order_by=[("asc", "id")] * 6), lambda: array_agg("id", distinct=True, order_by=[("asc", "name")]), lambda: array_agg("id", order_by=[("up", "id")]), lambda: array_agg("id", distinct=1), lambda: array_agg("id", order_by=["id"])):
        with pytest.raises(BuildError):
            bad()


def test_distinct_and_order(db):
    u = db.query("people")
    assert u.select("crew_id").distinct(True).to_df().count() == 4
    first = u.distinct("crew_id").order_by([("desc", "id")]).select(["crew_id", "id"]).to_df().collect()
    assert [tuple(r) for r in first] == [(1, 12), (2, 20), (3, 18), (None, 19)]
    j = u.inner_join("grown").order_by([("asc", "id")])
    assert [r[0] for r in j.select("id").limit(2).to_df().collect()] == [11, 11]
    assert [r[0] for r in j.distinct_roots().select("id").limit(1).offset(1).to_df().collect()] == [12]
    by_mail = lambda d: [r[0] for r in u.order_by([(d, "email"), ("asc", "id")]).select("id").to_df().collect()]
    assert by_mail("desc")[0] == 13 and by_mail("asc")[-1] == 13 and by_mail("asc_nulls_first")[0] == 13
    assert u.limit(5).where(("id", 19)).to_df().count() == 1  # filters come before limits, whatever the calls' order
    assert u.limit(5).limit("2").to_df().count() == 2
    assert "TakeOrderedAndProject" in plan(u.order_by([("asc", "id")]).limit(3).to_df())
    for bad in (lambda: u.limit("x"), lambda: u.limit(1.5), lambda: u.offset(-1), lambda: u.order_by(None), lambda: u.order_by([("up", "id")]), lambda: u.distinct(None), lambda: db.query("keyless").distinct_roots(), lambda: u.distinct_roots(None), lambda: u.maybe_where(1, []), lambda: u.order_by(["id"])):
        with pytest.raises(BuildError):
            bad()


def test_top_n(db):
    a = db.query("plots")
    two = a.top_n_per(partition_by="steward_id", order_by=[("desc", "id")], n=2)
    assert sorted(r["id"] for r in two.to_df().collect()) == [2, 3, 4, 5]
    assert "WindowGroupLimit" in plan(two.to_df())
    one = a.first_per(partition_by="grower_id", order_by=[("desc", "id")])
    assert sorted(r["id"] for r in one.to_df().collect()) == [2, 3, 5]
    assert one.where(("id", "gt", 2)).to_df().count() == 2
    most = db.query("people").group_by("grown", "id").top_n_per(partition_by="away", order_by=[("desc", count("id@grown")), ("asc", "id")], n=1)
    assert sorted(r["id"] for r in most.to_df().collect()) == [11, 13]
    for bad in (lambda: a.top_n_per(partition_by="grower_id", order_by=[("asc", "title")], n=1).to_df(), lambda: a.top_n_per(partition_by="grower_id", order_by=[("asc", "id")], n=0), lambda: a.first_per(partition_by="grower_id", order_by=[("asc", "id")], n=2), lambda: a.limit(1).top_n_per(partition_by="id", order_by=[("asc", "id")], n=1).to_df(), lambda: a.inner_join("visits").top_n_per(partition_by="id", order_by=[("asc", "id")], n=1).to_df(), lambda: a.top_n_per(partition_by={"a": 1}, order_by=[("asc", "id")], n=1), lambda: a.top_n_per(partition_by=count(), order_by=[("asc", "id")], n=1), lambda: db.query("keyless").top_n_per(partition_by="x", order_by=[("asc", "x")], n=1).to_df()):
        with pytest.raises(BuildError):
            bad()


def test_lateral(db):
    u = db.query("people")
    latest = {r["people"]["id"]: r["grown"] for r in u.left_join_latest("grown", order_by=[("desc", "id")]).to_df().collect()}
    assert len(latest) == 10 and latest[11]["id"] == 2 and latest[13] is None
    rows = u.left_join_top_n("grown", n=2, order_by=[("asc", "id")], where=[("name@grower", "ne", "Teo")], child_assoc_fields="grower").to_df().collect()
    assert len(rows) == 12 and sum(r["grown"] is None for r in rows) == 8
    for bad in (lambda: u.left_join_latest("crew", order_by=[("asc", "id")]).to_df(), lambda: u.left_join_latest("received", order_by=[("asc", "id")]).to_df(), lambda: u.left_join_top_n("grown", n=0, order_by=[("asc", "id")]), lambda: u.left_join_latest("grown", order_by=[("asc", "title")]).to_df(), lambda: u.select("id").left_join_latest("grown", order_by=[("asc", "id")]), lambda: u.left_join_latest("grown", order_by=[("asc", "id")]).select("id"), lambda: u.left_join_latest("grown", order_by=[("asc", "id")], where=None)):
        with pytest.raises(BuildError):
            bad()


def test_preloads(db):
    u = db.query("people").order_by([("asc", "id")])
    rows = u.preload_separate(["crew", {"grown": "visits"}]).to_df().collect()
    assert [r["id"] for r in rows] == sorted(r["id"] for r in rows) and len(rows) == 10
    assert rows[0]["crew"]["name"] == "water" and [len(x["visits"]) for x in rows[0]["grown"]] == [3, 1] and rows[2]["grown"] == []
    assert [len(r["received"]) for r in u.preload_separate("received").to_df().collect()][:4] == [4, 2, 0, 3]
    scoped = u.preload_separate_scoped("grown", where=[("title", "contains", "PEAS")], order_by=[("desc", "id")]).to_df().collect()
    assert [len(r["grown"]) for r in scoped][:4] == [2, 0, 0, 0]
    joined = u.inner_join({"grown": "visits"}).where(("id@visits", "gt", 2)).preload_through_join({"grown": "visits"}).to_df().collect()
    assert [(r["id"], [(a["id"], len(a["visits"])) for a in r["grown"]]) for r in joined] == [(11, [(1, 1), (2, 1)]), (12, [(3, 2)]), (14, [(4, 3)])]
    mixed = u.inner_join("grown").preload_through_join("grown").preload_separate({"grown": "visits"}).to_df().collect()
    assert [[len(a["visits"]) for a in r["grown"]] for r in mixed] == [[3, 1], [2], [3, 0]]
    assert db.query("plots").where(("id", 1)).preload_separate("first_visit").to_df().first()["first_visit"]["id"] == 1
    assert u.left_join("grown").preload_through_join("grown").to_df().collect()[2]["grown"] == []
    # Narrowed roots take their own children only, at every depth and through every kind of edge.
    few = u.where(("id", "in", [12, 13, 14])).preload_separate([{"grown": "visits"}, "received", "starred"])
    assert [([len(p["visits"]) for p in r["grown"]], len(r["received"]), [p["id"] for p in r["starred"]]) for r in few.to_df().collect()] == [([2], 2, []), ([], 0, [1, 2, 3]), ([3, 0], 3, [])]
    assert "LeftSemi" in plan(few.to_df()) and "LeftSemi" not in plan(u.preload_separate("grown").to_df())
    # A limit without a settled order might take other roots the second time.
    assert "LeftSemi" in plan(u.limit(2).preload_separate("grown").to_df()) and "LeftSemi" not in plan(db.query("people").limit(2).preload_separate("grown").to_df())
    for bad in (lambda: u.preload_through_join("crew").to_df(), lambda: u.preload_separate_scoped("crew", where=[("x@y", 1)]), lambda: u.preload_separate("crew").select("id").to_df(), lambda: u.preload_separate_scoped({"a": "b"}), lambda: u.inner_join("grown").distinct_roots().preload_through_join("grown").to_df(), lambda: u.inner_join("crew").preload_through_join("crew").preload_separate_scoped("crew", where=[("id", 1)]).to_df()):
        with pytest.raises(BuildError):
            bad()


@pytest.mark.parametrize("order", [[("asc", "alias")], [("desc", "email")], [("asc_nulls_first", "email"), ("desc", "id")], []])
def test_pages_walk(db, order):
    q = db.query("people").order_by(order) if order else db.query("people")
    whole = [r["id"] for r in q.order_by([("asc", "id")]).to_df().collect()]
    page, seen = q.paginate(page_size=4), []
    while True:
        seen += [e["id"] for e in page.entries]
        if not page.pagination["has_more_entries"]:
            break
        page = q.paginate(page_size=4, cursor=page.pagination["cursor_for_entries_after"])
    assert seen == whole and page.jobs == 1 and page.strategy == "single_query"
    back = q.paginate(page_size=4, cursor=page.pagination["cursor_for_entries_before"], direction="before")
    assert [e["id"] for e in back.entries] == whole[4:8]


def test_pages(db):
    q = db.query("people")
    by_crew = q.order_by("crew", [("asc", "name@crew")]).paginate(page_size=3)
    assert by_crew.strategy == "cursor_projection" and by_crew.jobs == 1 and [e["id"] for e in by_crew.entries] == [14, 15, 20]
    many = q.inner_join("grown").preload_through_join("grown").paginate(page_size=2)
    assert many.strategy == "keys_first" and many.jobs == 2 and [len(e["grown"]) for e in many.entries] == [2, 1]
    loaded = q.preload_separate("crew").paginate(page_size=2)
    assert [e["crew"]["name"] for e in loaded.entries] == ["water", "water"]
    c = db.query("composite").order_by([("asc", "name")])
    first = c.paginate(page_size=2)
    rest = c.paginate(page_size=2, cursor=first.pagination["cursor_for_entries_after"])
    assert [(e["tenant_id"], e["user_id"]) for e in first.entries + rest.entries] == [(0, 9), (1, 1), (1, 2), (2, 1)]
    o = q.inner_join("grown").order_by([("asc", "id")]).offset(1).paginate_offset(page_size=1)
    assert [e["id"] for e in o.entries] == [12] and o.pagination["has_more_entries"] and o.strategy == "keys_first"
    assert q.paginate(page_size=50, max_page_size=2).pagination["max_page_size"] == 2
    assert q.where(("id", 0)).paginate().pagination["cursor_for_entries_after"] is None
    cursor = q.paginate(page_size=1).pagination["cursor_for_entries_after"]
    for bad in (lambda: q.paginate(page_size=0), lambda: q.paginate(direction="up"), lambda: q.paginate(cursor="!!"), lambda: q.paginate(cursor="a" * 9000), lambda: q.order_by([("asc", "name")]).paginate(cursor=cursor), lambda: q.select("id").paginate(), lambda: db.query("keyless").paginate(), lambda: q.order_by([("asc", lambda r: r("id"))]).paginate(), lambda: q.paginate_offset(cursor="x"), lambda: q.inner_join("grown").order_by([("asc", "title@grown")]).paginate(page_size=4)):
        with pytest.raises(BuildError):
            bad()


def test_options(db):
    u = db.query("people")
    assert u.from_opts(None) == u
    assert u.from_opts({"where": [("name", "Teo")], "order_by": [("asc", "id")], "limit": 1}).to_df().count() == 1
    full = u.from_opts([("where", args("crew", [("name@crew", "tools")])), ("top_n_per", {"partition_by": "crew_id", "order_by": [("asc", "id")], "n": 1})], "full")
    assert full.to_df().count() == 1
    ext = Extension()

    @ext.operation(boundary=True)
    def named(query, name):
        return query.where(("name", name))

    assert u.from_opts({"named": "Teo"}, extension=ext).to_df().count() == 1
    allowed = {"crew": "crew", "plots": ("grown", {"where": [("id", "gt", 1)]})}
    got = u.from_opts([("include", ["crew", "plots", "crew"]), ("where", {"id": 11})], includes=allowed).to_df().first()
    assert got["crew"]["id"] == 1 and len(got["grown"]) == 1
    for bad in (lambda: u.from_opts({"select": "id"}), lambda: u.from_opts({"where": [("name@crew", "x")]}), lambda: u.from_opts({"where": lambda r: r("id")}), lambda: u.from_opts({"where": [("id", "in", u.select("id"))]}), lambda: u.from_opts({"limit": -1}), lambda: u.from_opts({"limit": None}), lambda: u.from_opts({"huh": 1}, "full"), lambda: u.from_opts({"include": "x"}, includes={}), lambda: u.from_opts({"include": "x"}), lambda: u.from_opts({"where": args([], [])}), lambda: u.from_opts({"inner_join": ("crew", "x")}, "full"), lambda: u.from_opts({"where_exists": "crew"}, "full"), lambda: args(1), lambda: args(1, None), lambda: u.from_list([]), lambda: Extension({"where": print}), lambda: u.from_opts({"order_by": [("asc", "name@crew")]}), lambda: u.from_opts(3)):
        with pytest.raises(BuildError):
            bad()


def test_sources(db, spark):
    few = db.wrap("people", db["people"].source.limit(3))
    assert few.to_df().count() == 3 and few.where_has("grown").to_df().count() <= 3
    with pytest.raises(BuildError):
        db.wrap("people", spark.range(1).withColumnRenamed("id", "x"))
    with pytest.raises(BuildError):
        db["nothing"]
    with pytest.raises(QueryError):
        db.query("keyless").where_missing("people")


def test_wrapped_joins(db, spark):
    """Associations that a frame has joined are taken from its columns and not joined again."""
    people, crews = db["people"].source, db["crews"].source
    frame = people.join(crews.select(F.col("id").alias("c_id"), F.upper("name").alias("c_name")), F.col("crew_id") == F.col("c_id"), "left")
    q = db.wrap("people", frame, {"crew": {"id": "c_id", "name": "c_name"}})
    assert names(q.where("crew", ("name@crew", "WATER"))) == ["Mara", "Teo"] and plan(q.where("crew", ("name@crew", "WATER")).to_df()).count("Join") == 1
    assert q.to_df().columns == people.columns and q.to_df().count() == 10 and q.inner_join("crew").to_df().count() == 9
    assert plan(q.to_df()).count("Join") <= 1
    below = q.where({"crew": "rights"}, ("name@rights", "sow"))
    assert below.to_df().count() == 5 and plan(below.to_df()).count("Join ") == plan(db.query("people").where({"crew": "rights"}, ("name@rights", "sow")).to_df()).count("Join ")
    grouped = dict(map(tuple, q.group_by("crew", "name@crew").select({"crew": "name@crew", "n": count()}).to_df().collect()))
    assert grouped == {"WATER": 2, "SEEDS": 3, "TOOLS": 4, None: 1}
    loaded = q.inner_join("crew").order_by([("asc", "id")]).preload_through_join("crew").to_df().first()
    assert loaded["crew"].asDict() == {"id": 1, "name": "WATER"}
    first = q.first_per(partition_by="crew_id", order_by=[("asc", "id")]).where("crew", ("name@crew", "water"))  # a new stage joins by itself
    assert names(first) == ["Mara"]
    for bad in (lambda: q.left_join("crew", [("name@crew", "x")]).to_df(), lambda: db.wrap("people", frame, {"crew": {"name": "c_name"}}), lambda: db.wrap("people", frame, {"crew": {"id": "nope"}}), lambda: db.wrap("people", frame, {"crew.rights": {"id": "c_id"}}), lambda: db.wrap("people", frame, {"nope": {"id": "c_id"}})):
        with pytest.raises(BuildError):
            bad()


def test_nothing_runs_early(db, spark):
    group = "lazy"
    spark.sparkContext.setJobGroup(group, "")
    db.query("people").inner_join("crew").group_by("name@crew").select({"r": "name@crew", "n": count()}).order_by([("asc", "name@crew")]).to_df()
    assert not list(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("", "")


def test_streams(db, spark, tmp_path):
    people = db["people"].source
    people.write.parquet(str(tmp_path / "people"))
    stream = spark.readStream.schema(people.schema).parquet(str(tmp_path / "people"))
    q = db.wrap("people", stream).inner_join("crew").where([("away", False), ("name@crew", "water")])
    run = q.select({"name": "name", "crew": "name@crew"}).to_df().writeStream.format("memory").queryName("found").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(r["name"] for r in spark.sql("SELECT name FROM found").collect()) == ["Mara", "Teo"]
    with pytest.raises(QueryError, match="not for streams"):
        q.order_by([("asc", "id")]).to_df()
