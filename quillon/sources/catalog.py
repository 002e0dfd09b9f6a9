"""Tables, keys and relationships. Spark keeps none of these for Parquet, so that a catalog does."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillon.errors import QueryError

#: One way to join two tables: pairs of columns that are equal, all of them.
Constraint = tuple[tuple[str, str], ...]


@dataclass
class TableInfo:
    name: str
    df: DataFrame
    primary_key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    is_view: bool = False
    defaults: dict = field(default_factory=dict)  # column -> Column or literal
    label: str | None = None
    checks: dict = field(default_factory=dict)  # column -> {min, max, lowerCased, trimmed}

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def dtype(self, column: str) -> T.DataType:
        return self.df.schema[column].dataType

    def unique_groups(self) -> list[tuple[str, ...]]:
        return [*self.unique, *([self.primary_key] if self.primary_key else [])]


@dataclass(frozen=True)
class Hop:
    """A step of a join path: a table, and the constraints that join it to the table before (OR-ed)."""

    table: str
    on: tuple[Constraint, ...]


class Catalog:
    def __init__(self) -> None:
        self.tables: dict[str, TableInfo] = {}
        self.edges: dict[str, dict[str, list[Constraint]]] = {}
        self.named_joins: dict[tuple[str, str], list] = {}

    def add(self, name: str, df: DataFrame, primary_key: Iterable[str] = (), unique: Iterable[Iterable[str]] = (), **more) -> TableInfo:
        self.tables[name] = TableInfo(name, df, tuple(primary_key), tuple(map(tuple, unique)), **more)
        self.edges.setdefault(name, {})
        return self.tables[name]

    def table(self, name: str) -> TableInfo:
        if name not in self.tables:
            raise QueryError(f"Table {name} not found. Expecting one of: {', '.join(sorted(self.tables))}")
        return self.tables[name]

    def relate(self, table: str, other: str, on: dict[str, str]) -> None:
        """Declare that table's columns refer to other's. A second call for the pair adds a constraint."""
        for name, columns in ((table, on), (other, on.values())):
            missing = set(columns) - set(self.table(name).columns)
            if missing:
                raise QueryError(f"Invalid join: {name} has no column {', '.join(sorted(missing))}")
        pairs = tuple(on.items())
        for a, b, constraint in ((table, other, pairs), (other, table, tuple((y, x) for x, y in pairs))):
            known = self.edges.setdefault(a, {}).setdefault(b, [])
            if constraint not in known:
                known.append(constraint)

    def name_join(self, table: str, column: str, path: list) -> None:
        """A join that queries can ask for by a column-like name."""
        self.named_joins[table, column] = path

    def relationship(self, table: str, other: str) -> str:
        """one-one, many-one, one-many or many-many, by the keys that the constraints cover."""
        mine = any(set(self.table(table).primary_key) == {a for a, _ in c} for c in self.edges[table].get(other, []))
        theirs = any(set(self.table(other).primary_key) == {b for _, b in c} for c in self.edges[table].get(other, []))
        return f"{'one' if mine else 'many'}-{'one' if theirs else 'many'}"

    def shortest(self, start: str, goal: str) -> list[str]:
        """Tables after start on a shortest path to goal; equal lengths: the first declared edges win."""
        before, queue = {start: ""}, deque([start])
        while queue:
            at = queue.popleft()
            for to in self.edges.get(at, {}):
                if to not in before:
                    before[to] = at
                    queue.append(to)
                if to == goal:
                    path, step = [], at if goal == start else goal
                    if goal == start:
                        path = [goal]
                    while step != start:
                        path.append(step)
                        step = before[step]
                    return path[::-1] if goal != start else path[1:][::-1] + [goal]
        raise QueryError(f"No join path from {start} to {goal}")

    def path(self, start: str, path: str | list) -> list[Hop]:
        """Hops of "a.b", "**.b", ["a", "b"] or [{"table": "a", "on": [{"x": "y"}]}]."""
        if isinstance(path, str):
            if (start, path) in self.named_joins:
                return self.path(start, self.named_joins[start, path])
            parts: list = [path] if path in self.tables else path.split(".")
        else:
            parts = list(path)
        if not parts:
            raise QueryError("Empty join path")
        if parts[0] == "**":
            if len(parts) < 2:
                raise QueryError("A table must follow **")
            first = parts[1] if isinstance(parts[1], str) else parts[1]["table"]
            self.table(first)
            parts = [*self.shortest(start, first), *parts[2:]]
        hops, at = [], start
        for part in parts:
            name = part if isinstance(part, str) else part.get("table")
            self.table(name)
            known = self.edges.get(at, {}).get(name, [])
            if not known:
                raise QueryError(f"Joining {at} with {name} is not possible: no relationship is known")
            chosen = known
            if not isinstance(part, str) and part.get("on"):
                chosen = [c for c in known if any(dict(c) == wanted for wanted in part["on"])]
                if len(chosen) != len(part["on"]):
                    raise QueryError(f"Invalid join condition between {at} and {name}. Known: {[dict(c) for c in known]}")
            hops.append(Hop(name, tuple(chosen)))
            at = name
        return hops

    def reachable(self, start: str, name: str) -> list[Hop] | None:
        """The hops that a bare name in a select means, if it names a join; else None."""
        if (start, name) in self.named_joins:
            return self.path(start, name)
        if name not in self.tables:
            return None
        try:
            return self.path(start, [name] if name in self.edges.get(start, {}) else ["**", name])
        except QueryError:
            return None


#: Keys and references of the star schema in the test tables. lineitem has no unique key.
STAR_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "labels": "doc_id", "pages": "page_id", "embeddings": "vec_id", "benchmark": "item_id"}
STAR_EDGES = (
    ("nation", "region", {"n_regionkey": "r_regionkey"}),
    ("customer", "nation", {"c_nationkey": "n_nationkey"}),
    ("supplier", "nation", {"s_nationkey": "n_nationkey"}),
    ("orders", "customer", {"o_custkey": "c_custkey"}),
    ("lineitem", "orders", {"l_orderkey": "o_orderkey"}),
    ("lineitem", "part", {"l_partkey": "p_partkey"}),
    ("lineitem", "supplier", {"l_suppkey": "s_suppkey"}),
    ("labels", "documents", {"doc_id": "doc_id"}),
)


def star_catalog(spark: SparkSession, directory: str, tables: Iterable[str] | None = None) -> Catalog:
    """The test tables of a directory, lazily read from Parquet, with their keys and references."""
    catalog = Catalog()
    wanted = set(tables or [*STAR_KEYS, "lineitem", "conversations"])
    for name in sorted(wanted):
        key = (STAR_KEYS[name],) if name in STAR_KEYS else ()
        catalog.add(name, spark.read.parquet(f"{directory}/{name}.parquet"), key)
    for a, b, on in STAR_EDGES:
        if a in wanted and b in wanted:
            catalog.relate(a, b, on)
    return catalog
