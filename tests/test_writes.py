import pytest

from quillon.errors import QueryError
from quillon.plans.access import DeleteRule, InsertRule, SelectRule, TableRules, UpdateRule
from tests.fixtures import small_engine


@pytest.fixture
def e(spark):
    return small_engine(spark)


def rows(e, table, *columns):
    return sorted(tuple(r) for r in e.catalog.table(table).df.select(*columns or e.catalog.table(table).columns).collect())


def test_insert_and_conflicts(e):
    assert e.write.insert("symbols", [{"id": "x"}]).first()[0] == 1
    with pytest.raises(QueryError, match="duplicate"):
        e.write.insert("symbols", [{"id": "x"}])
    with pytest.raises(QueryError, match="duplicate"):
        e.write.insert("symbols", [{"id": "y"}, {"id": "y"}])
    with pytest.raises(QueryError):
        e.write.insert("symbols", [{"nope": 1}])
    assert e.write.insert("trades", [{"id": 1, "price": 9.0}, {"id": 7, "price": 5.0}], on_conflict="DoUpdate", returning={"id": 1, "p": {"$column": ["price"]}}).orderBy("id").collect() == [(1, 9.0), (7, 5.0)]
    assert (1, "btc", 9.0) in rows(e, "trades")  # columns that were not given stay
    e.write.insert("trades", [{"id": 1, "price": 0.0}], on_conflict={"action": "DoNothing", "conflictColumns": ["id"]})
    assert (1, "btc", 9.0) in rows(e, "trades")


def test_nested_inserts(e):
    e.write.insert("symbols", {"id": "new", "trades": [{"id": 50, "price": 1.5}, {"id": 51, "price": 2.5}]})
    e.write.insert("trades", {"id": 52, "price": 3.5, "symbol": {"id": "other"}})
    assert {(50, "new", 1.5), (51, "new", 2.5), (52, "other", 3.5)} <= set(rows(e, "trades")) and ("other",) in rows(e, "symbols")


def test_update_delete_upsert(e):
    e.write.update("trades", {"symbol": "btc"}, {"price": 7.0})
    assert [r[2] for r in rows(e, "trades")][:3] == [7.0] * 3
    with pytest.raises(QueryError, match="several rows"):
        e.write.update("trades", {"symbol": "btc"}, {"price": 8.0}, multi=False)
    e.write.update("various", {"id": 1}, {"jsn": {"$merge": ['{"z": 1}']}})
    assert rows(e, "various", "id", "jsn")[0] == (1, '{"a":{"b":2},"z":1}')
    e.write.update_batch("items", [({"name": "a"}, {"name": "c"}), ({"name": "b"}, {"name": "c"})])
    assert {r[0] for r in rows(e, "items", "name")} == {"c"}
    e.write.upsert("symbols", {"id": "btc"}, {"id": "btc"})
    e.write.upsert("symbols", {"id": "up"}, {})
    assert rows(e, "symbols") == [("abc",), ("btc",), ("eth",), ("up",)]
    assert e.write.delete("symbols", {"id": {"$in": ["up", "abc"]}}, returning="*").count() == 2
    e.write.delete("trades")
    assert rows(e, "trades") == []


def test_null_conditions_keep_rows(e):
    e.write.delete("various", {"name": {"<>": "abc9"}})
    assert [r[0] for r in rows(e, "various", "id")] == [1, 4]


def test_transactions_checks_and_hooks(e):
    with pytest.raises(ZeroDivisionError), e.write.transaction():
        e.write.delete("symbols")
        1 / 0
    assert len(rows(e, "symbols")) == 3
    e.catalog.table("trades").checks["price"] = {"min": 0}
    with pytest.raises(QueryError, match="check"):
        e.write.insert("trades", {"id": 60, "price": -1.0})
    writer, seen = e.write, []
    writer.after_change("symbols", "insert", lambda before, new: seen.append(new.count()))
    writer.before["symbols.insert"] = [lambda row: {"id": row["id"].lower()}]
    writer.insert("symbols", {"id": "HOOK"})
    assert seen == [1] and ("hook",) in rows(e, "symbols")


def test_rules(e):
    rules = TableRules(SelectRule(), InsertRule(fields=["id"], forced_data={"symbol": "eth"}), UpdateRule(fields=["price"], forced_filter={"symbol": "eth"}, dynamic_fields=(({"id": 4}, ["symbol"]),)), DeleteRule(forced_filter={"symbol": "eth"}))
    c = e.as_caller({"trades": rules})
    c.write.insert("trades", {"id": 70})
    with pytest.raises(QueryError):
        c.write.insert("trades", {"id": 71, "price": 1.0})
    with pytest.raises(QueryError):
        c.write.update("trades", {}, {"price": 1.0})  # row 4 allows symbol alone
    c.write.update("trades", {"id": {">": 4}}, {"price": 1.0})
    c.write.delete("trades")
    assert {r[1] for r in rows(e, "trades")} == {"btc"} and (70, "eth", 1.0) not in rows(e, "trades")
    with pytest.raises(QueryError):
        e.as_caller({"trades": TableRules(SelectRule())}).write.delete("trades")


def test_commit_callbacks_and_gates(e):
    writer, seen = e.write, []
    with writer.transaction():
        writer.on_commit(lambda: seen.append("done"))
        with writer.transaction():
            writer.on_commit(lambda: seen.append("inner"))
        assert seen == []
    assert seen == ["done", "inner"]
    with pytest.raises(ZeroDivisionError), writer.transaction():
        writer.on_commit(lambda: seen.append("never"))
        1 / 0
    assert seen == ["done", "inner"]
    writer.after_change("trades", "update", lambda old, new: seen.append("price"), changed_fields=["price"])
    writer.update("trades", {"id": 1}, {"symbol": "eth"})
    writer.update("trades", {"id": 1}, {"price": 2.0})
    assert seen[2:] == ["price"]
    writer.instead_of_delete["symbols"] = lambda wanted: seen.append(wanted)
    writer.delete("symbols", {"id": "btc"})
    assert seen[-1] == {"id": "btc"} and len(rows(e, "symbols")) == 3


def test_nested_rules_and_nested_update(e):
    rules = {"symbols": TableRules(SelectRule(), InsertRule(required_nested={"trades": (1, 2)})), "trades": TableRules(SelectRule(), InsertRule(allowed_parents=("symbols",)))}
    c = e.as_caller(rules)
    with pytest.raises(QueryError, match="needs 1 to 2"):
        c.write.insert("symbols", {"id": "a"})
    with pytest.raises(QueryError, match="only be inserted within"):
        c.write.insert("trades", {"id": 90})
    c.write.insert("symbols", {"id": "a", "trades": [{"id": 91}]})
    assert (91, "a", None) in [tuple(r) for r in e.catalog.table("trades").df.collect()]
    e.write.update("trades", {"id": 1}, {"symbol": {"id": "fresh"}})
    assert ("fresh",) in rows(e, "symbols") and e.fetch("trades", {"id": 1}, {"select": ["symbol"], "returnType": "value"}) == "fresh"
    with pytest.raises(QueryError, match="several rows"):
        e.write.update("trades", {}, {"symbol": {"id": "other"}})


def test_server_functions():
    from quillon.functions.server import ServerFunctions

    functions = ServerFunctions()
    functions.define("double", lambda args, _: args["x"] * 2, {"x": "number"}, allowed=lambda user: user == "admin")
    assert functions.call("double", {"x": 2}, "admin") == 4 and functions.available("guest") == {}
    for args, user in (({"x": "a"}, "admin"), ({}, "admin"), ({"x": 1}, "guest")):
        with pytest.raises(QueryError):
            functions.call("double", args, user)


def caller(e, **tables):
    from quillon.plans.access import DeleteRule, SelectRule, TableRules, UpdateRule

    made = {"select": SelectRule, "update": UpdateRule, "delete": DeleteRule}
    return e.as_caller({t: TableRules(**{c: made[c](**v) for c, v in rules.items()}) for t, rules in tables.items()})


def test_filters_of_writes_keep_to_the_callers_rules(e):
    before = len(rows(e, "trades"))
    c = caller(e, trades={"select": {"fields": ["id", "symbol"]}, "update": {"fields": ["symbol"]}, "delete": {}})
    for write in (lambda w: c.write.delete("trades", w), lambda w: c.write.update("trades", w, {"symbol": "x"})):
        with pytest.raises(QueryError):
            write({"$exists": {"symbols": {"id": "btc"}}})  # no rule on symbols
        with pytest.raises(QueryError):
            write({"price": {"$gt": 0}})  # price can't be read
    assert len(rows(e, "trades")) == before
    c.write.delete("trades", {"id": 1})
    assert len(rows(e, "trades")) == before - 1


def test_forced_filter_is_not_bound_by_filter_fields(e):
    c = caller(e, trades={"select": {}, "update": {"forced_filter": {"symbol": "btc"}, "filter_fields": ["id"]}, "delete": {"forced_filter": {"symbol": "btc"}, "filter_fields": ["id"]}})
    eth = e.find("trades", {"symbol": "eth"}, {"select": ["id", "price"]}).collect()
    c.write.update("trades", {"id": {"$gt": 0}}, {"price": 3.25})
    assert {r.price for r in e.find("trades", {"symbol": "btc"}).collect()} == {3.25}
    c.write.delete("trades", {"id": {"$gt": 0}})
    assert e.count("trades", {"symbol": "btc"}) == 0 and e.find("trades", {"symbol": "eth"}, {"select": ["id", "price"]}).collect() == eth
    with pytest.raises(QueryError):
        c.write.update("trades", {"price": 1.0}, {"price": 2.0})


def test_upsert_tests_existence_under_the_forced_filter(e):
    from quillon.plans.access import InsertRule, SelectRule, TableRules, UpdateRule

    c = e.as_caller({"trades": TableRules(SelectRule(), InsertRule(), UpdateRule(forced_filter={"symbol": "btc"}))})
    n = e.count("trades", {})
    c.write.upsert("trades", {"id": 1}, {"price": 8.5})  # a btc row: updated
    assert e.count("trades", {}) == n and e.count("trades", {"price": 8.5}) == 1
    with pytest.raises(QueryError, match="duplicate"):
        c.write.upsert("trades", {"id": 4}, {"price": 8.5})  # an eth row: not one that the caller can update


def test_hooks_last(e):
    seen = []
    e.write.after_change("trades", "delete", lambda old, gone: seen.append(gone.count()))
    e.write.delete("trades", {"id": 1})
    caller(e, trades={"delete": {}}).write.delete("trades", {"id": 2})
    assert seen == [1, 1]
