"""Random filters against SQL text over the same rows."""

import random

import pytest

from quillon.engine import Engine
from quillon.sources.catalog import Catalog

COLUMNS = {"a": "int", "s": "string", "d": "double"}


@pytest.fixture(scope="module")
def e(spark):
    rng = random.Random(9)
    pick = lambda make: None if rng.random() < 0.15 else make()
    rows = [(i, pick(lambda: rng.randint(0, 5)), pick(lambda: rng.choice(["x", "Xy", "a_b", "%", ""])), pick(lambda: rng.choice([-1.5, 0.0, 2.0]))) for i in range(200)]
    c = Catalog()
    c.add("t", spark.createDataFrame(rows, "id int, a int, s string, d double"), ["id"])
    c.table("t").df.createOrReplaceTempView("random_t")
    return Engine(spark, c)


def sql_value(v):
    return "NULL" if v is None else "'" + v + "'" if isinstance(v, str) else repr(v)


def value(rng, column):
    return {"a": rng.randint(0, 5), "s": rng.choice(["x", "Xy", "%", ""]), "d": rng.choice([-1.5, 0.0, 2.0])}[column]


def leaf(rng):
    c = rng.choice(list(COLUMNS))
    v, w = value(rng, c), value(rng, c)
    many = [value(rng, c) for _ in range(rng.randint(0, 3))] + ([None] if rng.random() < 0.4 else [])
    known = [x for x in many if x is not None]
    listed = f"{c} IN ({', '.join(map(sql_value, known))})" if known else "false"
    return rng.choice(
        [
            ({c: v}, f"{c} = {sql_value(v)}"),
            ({c: None}, f"{c} IS NULL"),
            ({c: {"$ne": v}}, f"{c} <> {sql_value(v)}"),
            ({f"{c}.$gt": v, f"{c}.<=": w}, f"({c} > {sql_value(v)} AND {c} <= {sql_value(w)})"),
            ({c: {"$between": [v, w]}}, f"{c} BETWEEN {sql_value(v)} AND {sql_value(w)}"),
            ({c: {"$in": many}}, f"({listed}{f' OR {c} IS NULL' if None in many else ''})"),
            ({c: {"$nin": many}}, f"(NOT {listed}{f' AND {c} IS NOT NULL' if None in many else ''})"),
            ({c: {"$isDistinctFrom": v}}, f"NOT ({c} <=> {sql_value(v)})"),
            ({"s": {"$ilike": "%x%"}}, "s ILIKE '%x%'"),
        ]
    )


def tree(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return leaf(rng)
    key = rng.choice(["$and", "$or"])
    parts = [tree(rng, depth - 1) for _ in range(rng.randint(1, 3))]
    return {key: [p for p, _ in parts]}, "(" + f" {key[1:].upper()} ".join(s for _, s in parts) + ")"


@pytest.mark.parametrize("seed", range(25))
def test_filter(e, spark, seed):
    wanted, where = tree(random.Random(seed), 3)
    got = sorted(r.id for r in e.find("t", wanted, {"select": ["id"]}).collect())
    assert got == sorted(r.id for r in spark.sql(f"SELECT id FROM random_t WHERE {where}").collect()), (wanted, where)
