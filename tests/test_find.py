import pytest

from quillon.errors import QueryError
from quillon.plans.access import SelectRule, TableRules, narrowed, resolve
from tests.fixtures import small_engine


@pytest.fixture(scope="module")
def e(spark):
    return small_engine(spark)


def names(e, table, wanted, **params):
    return sorted(r["id"] for r in e.fetch(table, wanted, {"select": ["id"], **params}))


@pytest.mark.parametrize(
    "wanted, ids",
    [
        ({"name": None}, [4]),
        ({"name": {"<>": None}}, [1, 2, 3]),
        ({"name": {"$ne": "abc9"}}, [2, 3]),
        ({"name": {"$in": ["abc9", None]}}, [1, 4]),
        ({"name": {"$nin": ["abc9", None]}}, [2, 3]),
        ({"name": {"$nin": []}}, [1, 2, 3, 4]),
        ({"name": {"$in": None}}, []),
        ({"name": {"$isDistinctFrom": "abc9"}}, [2, 3, 4]),
        ({"name": {"$isNotDistinctFrom": None}}, [4]),
        ({"id": {"$gt": 1, "$lt": 3}}, [2]),
        ({"id.<=": 2, "name.$like": "abc%"}, [1, 2]),
        ({"jsn->a->>b": "3"}, [2]),
        ({"jsn->a->>b.$in": ["2"]}, [1, 3]),
        ({"jsn": {"a": {"b": 2}}}, [1]),
        ({"jsn": {"@>": {"a": {"b": 2}}}}, [1, 3]),
        ({"jsn": {"@>": {"l": [1]}}}, [3]),
        ({"jsn": {"<@": {"a": {"b": 3}, "z": 1}}}, [2]),
        ({"added": {"$between": ["06 Dec 1995 00:12:00", "03 Dec 1997 00:12:00"]}}, [2]),
        ({"added": {"$in": ["04 Dec 1996 00:12:00"]}}, [2]),
        ({"$and": [{"$filter": [{"$year": ["added"]}, "=", "1996"]}, {"$filter": [{"$Mon": ["added"]}, "=", "Dec"]}]}, [2]),
        ({"$filter": [{"$length": ["name"]}, ">", 0]}, [1, 2, 3]),
        ({"$filter": [{"$length": ["name"]}, "$between", [5, 20]]}, [3]),
        ({"name.@@.to_tsquery": ["abc81 & !nothing"]}, [3]),
        ({"name.@@.to_tsquery": ["abc:* <-> here | abc9"]}, [1]),
        ({"name.@@.phraseto_tsquery": ["abc81 here"]}, [3]),
        ({"name.@@.websearch_to_tsquery": ["abc9 or here -zzz"]}, [1, 3]),
        ({"$term_highlight": [["*"], "abc81", {"returnType": "boolean"}]}, [3]),
        ({"$term_highlight": [["added"], "Q4", {"returnType": "boolean"}]}, [1, 2, 3]),
        ({"$or": []}, [1, 2, 3, 4]),
        ({"$or": [{"id": 1}, {"$and": [{"id": 2}, {"name": "no"}]}]}, [1]),
        ({}, [1, 2, 3, 4]),
    ],
)
def test_filters(e, wanted, ids):
    assert names(e, "various", wanted) == ids


@pytest.mark.parametrize("wanted, ids", [({"h": {"@>": ["b"]}}, [3]), ({"h": {"<@": ["a", "z"]}}, [1]), ({"h": {"&&": ["a", "c"]}}, [1, 3]), ({"h": None}, [2]), ({"h": ["a"]}, [1])])
def test_array_filters(e, wanted, ids):
    assert names(e, "items", wanted) == ids


@pytest.mark.parametrize(
    "wanted",
    [{"nope": 1}, {"id": {"$nope": 1}}, {"id": {"$in": 3}}, {"$and": [], "id": 1}, {"$filter": [{"$nope": []}]}, {"$filter": [{"$upper": ["x"]}, "=", "A"]}, [1], {"$upper": ["name"]}, {"$existsJoined": {"various": {"id": 1}}}, {"name.@@.to_tsquery": ["a & "]}],
)
def test_refused_filters(e, wanted):
    with pytest.raises(QueryError):
        e.find("items", wanted)


def test_hint_for_a_misspelt_function(e):
    with pytest.raises(QueryError, match=r"\$upper"):
        e.find("items", {}, {"select": {"x": {"$uper": ["name"]}}})


@pytest.mark.parametrize(
    "wanted, ids",
    [
        ({"$existsJoined": {"items2": {"name": "a"}}}, [1]),
        ({"$notExistsJoined": {"items2": {"name": "a"}}}, [2, 3]),
        ({"$existsJoined": {"items2.items3": {"name": "a"}}}, [1]),
        ({"$existsJoined": {"**.items3": {"name": "a"}}}, [1]),
        ({"$exists": {"items3": {"name": "za123"}}}, [1, 2, 3]),
        ({"$notExists": {"items3": {"name": "za123"}}}, []),
        ({"$or": [{"id": 3}, {"$existsJoined": {"items2": {"name": "a"}}}]}, [1, 3]),
        ({"$existsJoined": {"items_multi": {"name": "m1"}}}, [1, 2]),
        ({"$existsJoined": {"path": [{"table": "items_multi", "on": [{"id": "items1_id"}]}], "filter": {"name": "m1"}}}, [2]),
    ],
)
def test_exists(e, wanted, ids):
    assert names(e, "items", wanted) == ids


def test_order_and_aggregates(e):
    assert [r["name"] for r in e.fetch("items", {}, {"select": {"name": 1}, "orderBy": [{"key": "name", "asc": False, "nulls": "first", "nullEmpty": True}]})] == ["b", "a", "a"]
    assert e.fetch("items", {}, {"select": {"uname": {"$upper": ["name"]}, "count": {"$countAll": []}}, "orderBy": {"uname": -1}}) == [{"uname": "B", "count": 1}, {"uname": "A", "count": 2}]
    assert e.fetch("items", {"uname": "B"}, {"select": {"uname": {"$upper": ["name"]}, "count": {"$countAll": []}}}) == [{"uname": "B", "count": 1}]
    assert e.count("items", {"uname": "A"}, {"select": {"uname": {"$upper": ["name"]}}}) == 2
    assert e.count("items", {"uname": "A"}, {"select": {"uname": {"$upper": ["name"]}, "count": {"$countAll": []}}}) == 1
    assert e.fetch("items", {}, {"select": {"name": {"$countAll": []}, "n": {"$left": ["name", 1]}}, "orderBy": {"name": -1}}) == [{"name": 2, "n": "a"}, {"name": 1, "n": "b"}]
    assert [r["id"] for r in e.fetch("various", {}, {"select": ["id"], "orderBy": {"name": 1}})] == [2, 3, 1, 4]
    assert [r["id"] for r in e.fetch("various", {}, {"select": ["id"], "orderBy": {"name": -1}})][0] == 4
    with pytest.raises(QueryError):
        e.find("items", {"count": 1}, {"select": {"count": {"$countAll": []}}})


def test_having(e):
    assert e.fetch("items", {}, {"select": {"name": 1, "c": {"$countAll": []}}, "having": {"c": 2}}) == [{"name": "a", "c": 2}]
    assert e.fetch("items", {}, {"select": {"name": 1, "c": {"$countAll": []}}, "having": {"$filter": [{"$countAll": []}, "=", 2]}, "orderBy": "c"}) == [{"name": "a", "c": 2}]


def test_highlight(e):
    term = "abc81"
    row = e.fetch("various", {"id": 3}, {"select": {"h": {"$term_highlight": [["name"], term, {}]}, "two": {"$term_highlight": [["name", "id"], "81", {}]}, "i": {"$term_highlight": [["name"], term, {"returnType": "index"}]}, "o": {"$term_highlight": ["*", term, {"returnType": "object"}]}, "e": {"$term_highlight": [["name"], "HERE", {"noFields": True, "edgeTruncate": 2}]}, "n": {"$term_highlight": [["name"], "zzz", {}]}}})[0]
    assert row == {"h": '["name: ",["abc81"]," here"]', "two": '["name: abc",["81"]," here, id: 3"]', "i": 6, "o": '{"name":["",["abc81"]," here"]}', "e": '["1 ",["here"],""]', "n": '["name: abc81 here"]'}
    row = e.fetch("various", {"name.@@.to_tsquery": ["abc81"]}, {"select": {"h": {"$ts_headline_simple": ["name", {"plainto_tsquery": "abc81"}]}, "added": "$year", "d": {"$date": ["added"]}}})
    assert row == [{"h": "<b>abc81</b> here", "added": "1997", "d": "1997-12-04"}]
    with pytest.raises(QueryError):
        e.find("various", {}, {"select": {"x": {"$term_highlight": [["id"], "a", {"returnType": "boolean"}]}}})


def test_template_and_rowhash(e):
    row = e.fetch("various", {"id": 4}, {"select": {"t": {"$template_string": ["{name} is {id} {x}"]}, "$rowhash": 1}})[0]
    assert row["t"] == " is 4 {x}"
    assert e.count("various", {"$rowhash": row["$rowhash"]}) == 1


def test_nested(e):
    rows = e.fetch("symbols", {}, {"select": {"id": 1, "trades": "*", "again": {"$leftJoin": "trades", "select": "*"}}, "orderBy": "id"})
    assert [len(r["trades"]) for r in rows] == [0, 3, 3] and all(sorted(r["trades"], key=str) == sorted(r["again"], key=str) for r in rows)
    rows = e.fetch("symbols", {}, {"select": {"id": 1, "up": {"$innerJoin": "trades", "select": ["price"], "orderBy": {"price": 1}}, "down": {"$innerJoin": "trades", "select": ["price"], "orderBy": {"price": -1}}}})
    assert len(rows) == 2 and all(r["up"] == r["down"][::-1] for r in rows)
    row = e.fetch("symbols", {"id": "btc"}, {"select": {"id": 1, "t": {"$leftJoin": "trades", "select": {"id": 1, "price": 1}, "orderBy": {"price": -1}, "limit": 1, "offset": 1, "filter": {"price": {">": 0}}}}})[0]
    assert row["t"] == [{"id": 3, "price": 2.0}]
    assert e.fetch("symbols", {"id": "btc"}, {"select": {"t": {"$leftJoin": "trades", "select": ["id"], "limit": 0}}})[0]["t"] == []
    assert e.fetch("items", {}, {"select": {"name": 1, "i": {"$innerJoin": "items2", "select": {"name": 1, "c": {"$countAll": []}}, "having": {"c": 1}}}}) == [{"name": "a", "i": [{"name": "a", "c": 1}]}]


def test_nested_sort(e):
    for asc, want in ((True, ["eth", "btc", "abc"]), (False, ["abc", "btc", "eth"])):
        assert [r["id"] for r in e.fetch("symbols", {}, {"select": {"id": 1, "trades": {"m": {"$max": ["price"]}}}, "orderBy": {"trades.m": asc}})] == want
    with pytest.raises(QueryError, match="orderBy"):
        e.find("symbols", {}, {"select": {"id": 1, "trades": "*"}, "orderBy": {"T\n--select 1.m": True}})


def test_several_constraints_are_or_ed(e):
    rows = e.fetch("items", {}, {"select": {"id": 1, "m": {"$leftJoin": "items_multi", "select": ["id"], "orderBy": "id"}}, "orderBy": "id"})
    assert [[x["id"] for x in r["m"]] for r in rows] == [[1, 2], [1], [3]]
    rows = e.fetch("items_multi", {}, {"select": {"id": 1, "items": {"id": 1}}, "orderBy": "id"})
    assert [sorted(x["id"] for x in r["items"]) for r in rows] == [[1, 2], [1], [3], []]
    row = e.fetch("items_multi", {"id": 1}, {"select": {"i": {"$leftJoin": [{"table": "items", "on": [{"items1_id": "id"}]}], "select": ["id"]}}})
    assert row == [{"i": [{"id": 2}]}]


def test_or_join_has_no_nested_loop(e):
    plan = e.find("items", {}, {"select": {"id": 1, "items_multi": "*"}})._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("params", [{"limit": -1}, {"limit": "x"}, {"nope": 1}, {"select": {"id": 1, "name": 0}}, {"select": {"a": {"$unnest_words": ["name"]}, "b": {"$unnest_words": ["name"]}}}, {"select": {"n": {"$countAll": []}, "items2": "*"}}, {"select": {"items2": {"items3": "*"}}}, {"orderBy": "nope"}, {"select": {"various": "*"}}])
def test_refused_params(e, params):
    with pytest.raises(QueryError):
        e.find("items", {}, params)


def test_limits_and_shapes(e, spark):
    assert e.fetch("items", {"id": 1}, {"select": ["name"], "returnType": "value"}) == "a"
    assert e.fetch("items", {"id": 9}, {"returnType": "row"}) is None
    assert e.fetch("items", {}, {"select": ["id"], "orderBy": "id", "returnType": "values"}) == [1, 2, 3]
    with pytest.raises(QueryError):
        e.fetch("items", {}, {"returnType": "row"})
    with pytest.raises(QueryError):
        e.find_one("items", {}, {"limit": 2})
    assert "id" in e.fetch("items", {"id": 1}, {"returnType": "statement-where"})
    assert e.find_one("items", {}, {"orderBy": {"id": -1}}).first().id == 3
    assert e.size("items", {"id": 1}) > 10 and e.size("items", {"id": 99}) == 0
    assert [len(b) for b in e.stream(spark.range(2500).coalesce(2), 1000)] == [1000, 1000, 500]
    assert e.find("items", {}, {"limit": 0}).count() == 0


def test_rules(e):
    c = e.as_caller({"items": TableRules(select=SelectRule(fields=["id", "name"], forced_filter={"name": "a"}, max_limit=1, filter_fields=["id"]))})
    assert c.fetch("items", {}, {"limit": None}) in ([{"id": 1, "name": "a"}], [{"id": 2, "name": "a"}])
    for wanted, params in (({"name": "a"}, {}), ({}, {"select": ["h"]}), ({}, {"limit": 2}), ({"$existsJoined": {"items2": {"name": "a"}}}, {}), ({}, {"select": {"id": 1, "items2": "*"}})):
        with pytest.raises(QueryError):
            c.find("items", wanted, params)
    with pytest.raises(QueryError):
        c.find("items2")
    with pytest.raises(QueryError):
        c.sql("SELECT 1")
    assert [x["name"] for x in c.get_columns("items") if x["select"]] == ["id", "name"]
    assert c.get_info("items")["publishInfo"] == {"select": True, "insert": False, "update": False, "delete": False}


def test_scopes_cannot_widen():
    rules = TableRules(select=SelectRule(fields=["a", "b"], max_limit=5, forced_filter={"a": 1}))
    out = narrowed(rules, TableRules(select=SelectRule(fields=["b", "c"], max_limit=9, forced_filter={"b": 2})), ["a", "b", "c"])
    assert out.select.fields == ["b"] and out.select.max_limit == 5 and out.select.forced_filter == {"$and": [{"a": 1}, {"b": 2}]}
    assert narrowed(rules, TableRules(), ["a"]).select is None
    assert set(resolve(lambda user: {"t": "*"} if user else None, {"id": 1}, ["t"])) == {"t"} and resolve("*", None, ["x"])["x"].delete is not None


def test_geometry(e):
    london = {"lat": 51.5, "lng": -0.1}
    assert e.fetch("shapes", {"$ST_DWithin": ["at", {**london, "distance": 400, "unit": "km"}]}, {"select": ["id"], "orderBy": "id"}) == [{"id": "l"}, {"id": "p"}]
    row = e.fetch("shapes", {"id": "p"}, {"select": {"s": {"$ST_DistanceSphere": ["at", london]}, "o": {"$ST_DistanceSpheroid": ["at", {"text": "POINT(-0.1 51.5)"}]}, "g": {"$ST_AsGeoJSON": ["at"]}, "t": {"$ST_AsEWKT": ["at"]}}})[0]
    assert abs(row["s"] - row["o"]) < 2500 and 340_000 < row["s"] < 345_000
    assert row["g"] == '{"type":"Point","coordinates":[2.35,48.86]}' and row["t"] == "SRID=4326;POINT(2.35 48.86)"
    assert e.fetch("shapes", {}, {"select": {"b": {"$ST_Extent": ["at"]}}}) == [{"b": "BOX(-0.1 48.86,2.35 51.5)"}]


def test_json_functions(e):
    row = e.fetch("various", {"id": 3}, {"select": {"s": {"$jsonb_set": ["jsn", ["a", "c"], [1]]}, "n": {"$jsonb_strip_nulls": ["jsn"]}, "t": {"$jsonb_typeof": ["jsn"]}, "p": {"$jsonb_pretty": ["jsn"]}}})[0]
    assert row["s"] == '{"a":{"b":2,"c":[1]},"l":[1,{"x":null}]}' and row["n"] == '{"a":{"b":2},"l":[1,{}]}' and row["t"] == "object" and row["p"].startswith('{\n    "a"')
    assert [r["v"] for r in e.fetch("various", {"id": 3}, {"select": {"v": {"$jsonb_path_query": ["jsn", "$.l[*]"]}}})] == ["1", '{"x":null}']


def test_abort(e, spark):
    import threading
    import time

    signal = threading.Event()
    threading.Timer(0.5, signal.set).start()
    start = time.time()
    with pytest.raises(QueryError, match="aborted"):
        e.run_with_abort(lambda: spark.range(10**13).selectExpr("sum(id % 7)").collect(), signal)
    assert time.time() - start < 30


def test_parents_are_cut_before_their_children_are_ranked(spark, sf_dir):
    from quillon import queries

    e = queries.engine(spark, sf_dir, "customer", "orders")
    plan = e.find(*queries.FLAGSHIP)._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("LeftOuter")
    assert "GlobalLimit 10" in plan[join:] and plan[join:].count("LeftSemi") >= 2
    # An order that leaves ties asks for the parents once only.
    loose = {**queries.FLAGSHIP[2], "orderBy": [{"c_mktsegment": 1}]}
    plan = e.find(queries.FLAGSHIP[0], {}, loose)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and len(e.find(queries.FLAGSHIP[0], {}, loose).collect()) == 10
