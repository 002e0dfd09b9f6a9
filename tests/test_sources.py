import pytest

from quillon.engine import Engine
from quillon.errors import QueryError
from quillon.sources.catalog import Catalog, star_catalog
from quillon.sources.declare import declare
from quillon.sources.store import TableStore


def test_paths(spark, sf_dir):
    c = star_catalog(spark, sf_dir)
    assert [h.table for h in c.path("lineitem", "**.region")] in (["supplier", "nation", "region"],)
    assert c.relationship("customer", "orders") == "one-many" and c.relationship("orders", "customer") == "many-one" and c.relationship("labels", "documents") == "one-one"
    for start, path in (("region", "orders"), ("region", "**.events"), ("region", "**"), ("region", "nope"), ("nation", [{"table": "region", "on": [{"n_name": "r_name"}]}])):
        with pytest.raises(QueryError):
            c.path(start, path)
    with pytest.raises(QueryError):
        c.relate("region", "nation", {"x": "n_name"})


def test_store(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    assert store.version("t") is None
    assert store.commit("t", spark.range(3), None) == 1
    old = store.read("t")
    assert store.commit("t", spark.range(5), 1) == 2 and store.read("t").count() == 5 and old.count() == 3
    with pytest.raises(QueryError, match="another writer"):
        store.commit("t", spark.range(9), 1)
    store.commit("t", spark.range(1), 2)
    store.clean("t", keep=1)
    assert store.read("t").count() == 1 and not (tmp_path / "t" / "v2").exists()
    with pytest.raises(QueryError):
        store.read("nope")


def test_declaration(spark):
    config = {
        "orgs": {"columns": {"id": {"sql": "int", "primaryKey": True}, "members": {"joinDef": ["users"]}}},
        "users": {
            "columns": {
                "id": {"sql": "int", "primaryKey": True},
                "email": {"sql": "string", "checks": {"lowerCased": True, "trimmed": True}},
                "status": {"enum": ["active", "off"], "defaultValue": "active"},
                "level": {"enum": [1, 2.5]},
                "kind": {"lookup": {"values": {"a": "A", "b": "B"}}},
                "prefs": {"jsonbSchema": {"type": {"theme": "string"}}},
                "org": {"references": {"tableName": "orgs", "columnName": "id"}},
            }
        },
    }
    e = Engine(spark, declare(spark, Catalog(), config))
    e.write.insert("orgs", {"id": 1})
    e.write.insert("users", {"id": 1, "email": "x@y", "kind": "a", "prefs": {"theme": "dark"}, "org": 1})
    assert e.fetch("users", {}, {"select": ["status", "prefs"]}) == [{"status": "active", "prefs": '{"theme":"dark"}'}]
    assert e.fetch("orgs", {}, {"select": {"id": 1, "members": {"id": 1}}}) == [{"id": 1, "members": [{"id": 1}]}]
    for i, bad in enumerate(({"email": "X"}, {"status": "no"}, {"kind": "z"}, {"prefs": {"theme": 1}}, {"org": 9}, {"level": 3.0})):
        with pytest.raises(QueryError):
            e.write.insert("users", {"id": 10 + i, **bad})
    with pytest.raises(QueryError):
        e.write.insert("users", {"email": "a"})
    with pytest.raises(QueryError):
        declare(spark, Catalog(), {"t": {"columns": {"a": {"nope": 1}}}})


def test_a_lost_writer_leaves_the_table_as_it_was(spark, tmp_path):
    import os

    store = TableStore(spark, str(tmp_path))
    df = spark.range(3)
    assert store.commit("t", df, None) == 1
    os.makedirs(tmp_path / "t" / "tmp-dead")  # died before its rename
    assert store.version("t") == 1 and store.commit("t", spark.range(5), 1) == 2
    with pytest.raises(QueryError):
        store.commit("t", spark.range(7), 1)
    assert store.read("t").count() == 5 and store.read("t", 1).count() == 3 and store.versions("t") == [1, 2]
    assert store.read("t", 2).count() == 5
