"""Small tables with nulls, arrays, JSON, several references between two tables, and references to themselves."""

from quillon.engine import Engine
from quillon.sources.catalog import Catalog


def small_engine(spark) -> Engine:
    c = Catalog()
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    c.add("items", df([(1, ["a"], "a"), (2, None, "a"), (3, ["b", "c"], "b")], "id int, h array<string>, name string"), ["id"])
    c.add("items2", df([(1, 1, ["x"], "a"), (2, None, None, "z")], "id int, items_id int, hh array<string>, name string"), ["id"])
    c.add("items3", df([(1, None, "a", 1), (2, None, "za123", None)], "id int, h array<string>, name string, items2_id int"), ["id"])
    c.relate("items2", "items", {"items_id": "id"})
    c.relate("items3", "items2", {"items2_id": "id"})
    c.add("items_multi", df([(1, 1, 2, "m1"), (2, 1, 1, "m2"), (3, None, 3, "m3"), (4, None, None, "m4")], "id int, items0_id int, items1_id int, name string"), ["id"])
    c.relate("items_multi", "items", {"items0_id": "id"})
    c.relate("items_multi", "items", {"items1_id": "id"})
    from datetime import datetime

    rows = [(1, "abc9", '{"a":{"b":2}}', datetime(1995, 12, 4, 0, 12)), (2, "abc1", '{"a": {"b": 3}}', datetime(1996, 12, 4, 0, 12)), (3, "abc81 here", '{"a":{"b":2},"l":[1,{"x":null}]}', datetime(1997, 12, 4, 0, 12)), (4, None, None, None)]
    c.add("various", df(rows, "id int, name string, jsn string, added timestamp_ntz"), ["id"])
    c.add("symbols", df([("btc",), ("eth",), ("abc",)], "id string"), ["id"])
    c.add("trades", df([(1, "btc", 1.0), (2, "btc", 3.0), (3, "btc", 2.0), (4, "eth", 0.1), (5, "eth", 0.3), (6, "eth", 0.2)], "id int, symbol string, price double"), ["id"])
    c.relate("trades", "symbols", {"symbol": "id"})
    c.add("shapes", df([("l", (-0.1, 51.5)), ("p", (2.35, 48.86)), ("n", None)], "id string, at struct<lng: double, lat: double>"), ["id"])
    return Engine(spark, c)
