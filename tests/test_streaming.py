import pytest
from pyspark.sql import functions as F

from quillon.errors import QueryError
from quillon.functions.json_schema import is_valid, problem
from quillon.streaming.live import LiveQueries, apply_changes, changed_columns
from quillon.streaming.sync import SyncChannel, divergence, merge, newer_than, sync_stream
from tests.fixtures import small_engine

FEED = "op string, before struct<id: int, symbol: string, price: double>, after struct<id: int, symbol: string, price: double>, seq int"


def test_subscriptions(spark):
    e, got = small_engine(spark), []
    live = LiveQueries(e)
    live.subscribe("trades", {"symbol": "btc"}, {"select": ["id", "symbol"]}, lambda df: got.append(df.count()))
    assert got == [3]
    push = lambda *rows: live.push("trades", spark.createDataFrame(list(rows), FEED))
    assert push(("update", (1, "btc", 1.0), (1, "btc", 5.0), 1)) == 0  # price is not tracked
    assert push(("update", (4, "eth", 1.0), (4, "eth", 5.0), 1)) == 0
    assert push(("update", (4, "eth", 1.0), (4, "btc", 1.0), 1), ("insert", None, (9, "btc", 1.0), 2)) == 1
    live.subscribe("symbols", {}, {"select": {"id": 1, "trades": "*"}}, lambda df: got.append("nested"), skip_first=True)
    assert push(("delete", (4, "eth", 1.0), None, 1)) == 1 and got[-1] == "nested"
    with pytest.raises(QueryError):
        live.subscribe("trades", {"nope": 1}, {}, print)
    with pytest.raises(QueryError):
        live.subscribe("trades", {}, {}, print, actions={"insert": True, "update": False})


def test_stream_of_changes(spark, tmp_path):
    e, got = small_engine(spark), []
    info, live = e.catalog.table("trades"), LiveQueries(e)
    feed = spark.createDataFrame([("update", (1, "btc", 1.0), (1, "btc", 5.0), 1), ("update", (1, "btc", 5.0), (1, "btc", 6.0), 2), ("delete", (4, "eth", 0.1), None, 1), ("insert", None, (10, "eth", 9.0), 1)], FEED)
    feed.write.parquet(f"{tmp_path}/feed")
    live.subscribe("trades", {}, {"orderBy": "id"}, lambda df: got.append([r.id for r in df.collect()]), skip_first=True)

    def apply(rows):
        info.df = spark.createDataFrame(apply_changes(info.df, rows, ["id"]).collect(), info.df.schema)

    live.attach("trades", spark.readStream.schema(feed.schema).parquet(f"{tmp_path}/feed"), f"{tmp_path}/cp", apply).awaitTermination()
    assert got == [[1, 2, 3, 5, 6, 10]] and info.df.where("id = 1").first().price == 6.0


def test_changed_columns(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1.0), (3, "z", 2.0)], "id int, s string, v double")
    b = spark.createDataFrame([(1, "x", 1.0), (2, "y", 1.0), (4, "w", None)], a.schema)
    assert sorted((r.id, r.op, r.changed) for r in changed_columns(a, b, ["id"], ["s", "v"]).collect()) == [(1, "update", ["v"]), (3, "delete", ["s", "v"]), (4, "insert", ["s"])]


def test_last_writer_wins(spark, tmp_path):
    channel = SyncChannel(("id",), "t")
    server = spark.createDataFrame([(1, 10, "s"), (2, 10, "s"), (3, None, "s")], "id int, t long, v string")
    client = spark.createDataFrame([(1, 9, "c"), (2, 11, "c"), (2, 10, "old"), (3, 1, "c"), (4, 1, "c")], server.schema)
    out = merge(server, client, channel)
    assert sorted(map(tuple, out.collect())) == [(1, 10, "s"), (2, 11, "c"), (3, 1, "c"), (4, 1, "c")]
    assert [tuple(r) for r in newer_than(out, client, channel).collect()] == [(1, 10, "s")]
    assert divergence(server, server, channel).first()[0] is None and divergence(server.where("t > 0"), client.where("id < 3 AND v = 'c'"), channel).first()[0] == 9
    client.coalesce(1).write.parquet(f"{tmp_path}/in")
    state = [server]
    sync_stream(spark.readStream.schema(server.schema).parquet(f"{tmp_path}/in"), channel, lambda: state[0], lambda df: state.__setitem__(0, spark.createDataFrame(df.collect(), server.schema)), f"{tmp_path}/cp").awaitTermination()
    assert sorted(map(tuple, state[0].collect())) == sorted(map(tuple, out.collect()))


@pytest.mark.parametrize(
    "schema, value, ok",
    [
        ("string", "a", True), ("string", 1, False), ("number[]", [1, 2.5], True), ("number[]", [1, "x"], False), ("integer", 2.0, True), ("boolean", 1, False),
        ({"type": {"a": "number", "b": {"type": "string", "optional": True}}}, {"a": 1}, True), ({"type": {"a": "number"}}, {"a": 1, "z": 2}, False), ({"type": {"a": "number"}}, {}, False),
        ({"enum": ["x", 1]}, 1, True), ({"enum": ["x"]}, "y", False), ({"oneOf": ["string", {"enum": [1]}]}, 1, True), ({"oneOfType": [{"a": "string"}, {"b": "number"}]}, {"b": 2}, True),
        ({"arrayOf": {"enum": [1, 2]}}, [1, 3], False), ({"arrayOfType": {"k": "string"}}, [{"k": "v"}], True), ({"tuple": ["string", "number"]}, ["a", 1], True), ({"tuple": ["string"]}, ["a", 1], False),
        ({"record": {"keysEnum": ["a", "b"], "values": "number"}}, {"a": 1, "b": "x"}, False), ({"record": {"values": "number"}}, {"q": 1}, True),
        ({"type": "string", "nullable": True}, None, True), ("string", None, False), ({"type": "string", "allowedValues": ["a"]}, "b", False),
    ],
)
def test_json_schema(schema, value, ok):
    assert (problem(schema, value) is None) == ok


def test_json_schema_column(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('{"a": "x"}',), ("not json",), (None,)], "j string")
    assert [r[0] for r in df.select(is_valid(F.col("j"), {"type": {"a": "number"}})).collect()] == [True, False, False, False]
    with pytest.raises(QueryError):
        is_valid(F.col("j"), {"type": "nonsense"})


def test_columns_of_conditions_and_orders_are_tracked(spark):
    e, got = small_engine(spark), []
    live = LiveQueries(e)
    change = spark.createDataFrame([("update", (1, "btc", 1.0), (1, "btc", 5.0), 1)], FEED)
    for wanted, params in (
        ({"$and": [{"price": {"$gt": 0}}]}, {"select": ["id"]}),
        ({"$or": [{"id": 99}, {"price": 5.0}]}, {"select": ["id"]}),
        ({"$filter": [{"$ceil": ["price"]}, ">", 0]}, {"select": ["id"]}),
        ({}, {"select": ["id"], "orderBy": {"price": -1}, "limit": 1}),
    ):
        found = live.subscribe("trades", wanted, params, lambda df: got.append(1), skip_first=True)
        assert live.push("trades", change) == 1, (wanted, params)
        live.unsubscribe(found)
    live.subscribe("trades", {"$and": [{"symbol": "btc"}]}, {"select": ["id"]}, lambda df: got.append(1), skip_first=True)
    assert live.push("trades", change) == 0


def test_forced_filters_are_tracked(spark):
    from quillon.plans.access import SelectRule, TableRules

    e = small_engine(spark).as_caller({"trades": TableRules(SelectRule(fields=["id", "symbol"], forced_filter={"price": {"$gt": 2}}))})
    live = LiveQueries(e)
    live.subscribe("trades", {}, {"select": ["id"]}, lambda df: None, skip_first=True)
    assert live.push("trades", spark.createDataFrame([("update", (1, "btc", 1.0), (1, "btc", 5.0), 1)], FEED)) == 1


def test_one_subscribers_error_is_not_the_others(spark):
    e, got, errors = small_engine(spark), [], []
    live = LiveQueries(e)
    bad = live.subscribe("trades", {}, {}, lambda df: 1 / 0, skip_first=True, failed=errors.append)
    live.subscribe("trades", {}, {}, lambda df: got.append(1), skip_first=True)
    change = spark.createDataFrame([("insert", None, (9, "btc", 5.0), 1)], FEED)
    assert live.push("trades", change) == 2 and got == [1]
    assert isinstance(bad.error, ZeroDivisionError) and len(errors) == 1


def test_throttled_pushes_are_joined(spark):
    e, got = small_engine(spark), []
    live = LiveQueries(e)
    found = live.subscribe("trades", {}, {}, lambda df: got.append(1), skip_first=True, throttle=1000)
    change = spark.createDataFrame([("insert", None, (9, "btc", 5.0), 1)], FEED)
    assert [live.push("trades", change) for _ in range(3)] == [1, 0, 0] and live.flush() == 0
    found.throttle = 0
    assert live.flush() == 1 and got == [1, 1] and live.flush() == 0
