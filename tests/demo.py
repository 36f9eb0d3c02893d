"""A small community garden: people in crews, plots, visits to them. With nulls, ties, wildcards and a backslash in names."""

from relweave.sources import Registry, Schema, belongs_to, has_many, has_one, has_through, many_to_many

PEOPLE = [
    (11, "Mara", "mara@garden.test", "Mara", False, 1), (12, "Teo", "teo.m@garden.test", "Teodor", False, 1), (13, "Ines", None, "Ines", True, 3), (14, "Bruno", "bruno@garden.test", "Bru", False, 2),
    (15, "Marina", "old_marina@garden.test", "Mari", False, 2), (16, "Olek", "olek@garden.test", "Olek", True, 3), (17, "50%_off Petra", "petra@shop.test", "Pet", False, 3), (18, "50_ off Petra", "petra@shop.test", None, False, 3),
    (19, "Ruth", "ruth@garden.test", "ruth", False, None), (20, "Kai\\o", "kai@garden.test", "Kai\\o", False, 2),
]
CREWS = [(1, "water"), (2, "seeds"), (3, "tools")]
RIGHTS = [(1, "open", 1), (2, "lend", 3), (3, "open", 3), (4, "sow", 2), (5, "open", 2), (6, "pump", 1), (7, "log", 3), (8, "sow", 1)]
PLOTS = [(1, "EARLY PEAS", ["pea", "north"], 11, 15), (2, "LATE PEAS", ["pea"], 11, 15), (3, "TOMATO ROW", ["fruit", "south"], 12, 15), (4, "HERB SPIRAL", ["fruit", "south"], 14, 20), (5, "COMPOST", None, 14, 20)]
VISITS = [(i, "weeded", 13, plot) for i, plot in enumerate([1, 1, 1, 2, 3, 3, 4, 4, 4], 1)]
STARS = [(1, 1, 13), (2, 2, 13), (3, 3, 13), (4, 4, 16), (5, 3, 16)]
COMPOSITE = [(1, 2, "tie"), (2, 1, "tie"), (1, 1, "tie"), (0, 9, "apart")]


def demo(spark) -> Registry:
    make = spark.createDataFrame
    return Registry(
        Schema("people", make(PEOPLE, "id long, name string, email string, alias string, away boolean, crew_id long"), ("id",), {
            "crew": belongs_to("crews", "crew_id", "id"), "grown": has_many("plots", "id", "grower_id"), "tended": has_many("plots", "id", "steward_id"),
            "received": has_through("grown", "visits"), "starred": many_to_many("plots", "id", "id", "stars", "person_id", "plot_id"),
        }, {"name": lambda v: v.strip() if isinstance(v, str) else v}),
        Schema("crews", make(CREWS, "id long, name string"), ("id",), {"people": has_many("people", "id", "crew_id"), "rights": has_many("rights", "id", "crew_id")}),
        Schema("rights", make(RIGHTS, "id long, name string, crew_id long"), ("id",), {"crew": belongs_to("crews", "crew_id", "id")}),
        Schema("plots", make(PLOTS, "id long, title string, labels array<string>, grower_id long, steward_id long"), ("id",), {
            "grower": belongs_to("people", "grower_id", "id"), "steward": belongs_to("people", "steward_id", "id"), "visits": has_many("visits", "id", "plot_id"), "first_visit": has_one("visits", "id", "plot_id"),
        }),
        Schema("visits", make(VISITS, "id long, body string, person_id long, plot_id long"), ("id",), {"person": belongs_to("people", "person_id", "id"), "plot": belongs_to("plots", "plot_id", "id")}),
        Schema("stars", make(STARS, "id long, plot_id long, person_id long"), ("id",), {}),
        Schema("composite", make(COMPOSITE, "tenant_id long, user_id long, name string"), ("tenant_id", "user_id")),
        Schema("keyless", make([(1,)], "x long"), (), {"people": has_many("people", "x", "id")}),
    )
