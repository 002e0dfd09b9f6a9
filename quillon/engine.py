"""The declarative engine: find, count, size, writes and raw SQL over a catalog."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.errors import QueryError
from quillon.operators.writes import Writer
from quillon.plans.access import TableRules
from quillon.plans.fields import parse_fields
from quillon.plans.query import Planner, Query
from quillon.sources.catalog import Catalog

#: Seconds after which a query that a caller can abort ends by itself.
CALLER_TIMEOUT, OWN_TIMEOUT = 7, 120


class Engine:
    """Queries over a catalog. rules: the caller's, by table (None: everything is allowed)."""

    def __init__(self, spark: SparkSession, catalog: Catalog, rules: dict[str, TableRules] | None = None) -> None:
        self.spark, self.catalog, self.rules = spark, catalog, rules
        self.write = Writer(self)

    def as_caller(self, rules: dict[str, TableRules]) -> Engine:
        """The same tables under a caller's rules; hooks registered here run for the caller's writes as well."""
        caller = Engine(self.spark, self.catalog, rules)
        for name in ("before", "after", "instead_of_delete"):
            setattr(caller.write, name, getattr(self.write, name))
        return caller

    def planner(self) -> Planner:
        if self.rules is None:
            return Planner(self.catalog)
        return Planner(self.catalog, {t: r.select for t, r in self.rules.items() if r.select})

    def plan(self, table: str, wanted: dict | None = None, params: dict | None = None) -> Query:
        return self.planner().plan(table, wanted, params)

    # -- reads --------------------------------------------------------------------------------

    def find(self, table: str, wanted: dict | None = None, params: dict | None = None) -> DataFrame:
        """The rows, lazily. returnType is for fetch()."""
        planner = self.planner()
        return planner.rows(planner.plan(table, wanted, params))

    def fetch(self, table: str, wanted: dict | None = None, params: dict | None = None) -> object:
        """Results on the driver in the shape that returnType names; by default a list of dicts."""
        kind = (params or {}).get("returnType")
        if kind == "statement-where":
            where = self.plan(table, wanted, params).where
            return "" if where is None else where._jc.toString()
        df = self.find(table, wanted, params)
        if kind in ("statement", "statement-no-rls"):
            if self.rules is not None:
                raise QueryError("Not allowed: the statement needs SQL privileges")
            return df._jdf.queryExecution().optimizedPlan().toString()
        if kind in ("row", "value"):
            found = df.limit(2).collect()
            if len(found) > 1:
                raise QueryError("Multiple rows were not expected")
            if not found:
                return None
            return found[0].asDict(True) if kind == "row" else found[0][0]
        if kind == "values":
            return [r[0] for r in df.select(df.columns[0]).collect()]
        if kind is not None:
            raise QueryError(f"Unknown returnType {kind!r}")
        return [r.asDict(True) for r in df.collect()]

    def find_one(self, table: str, wanted: dict | None = None, params: dict | None = None) -> DataFrame:
        if "limit" in (params or {}):
            raise QueryError("limit is not allowed in find_one")
        return self.find(table, wanted, {**(params or {}), "limit": 1})

    def counted(self, table: str, wanted: dict | None = None, params: dict | None = None) -> DataFrame:
        """One row, count: of rows, or of groups where the select aggregates. limit is ignored."""
        params = {k: v for k, v in (params or {}).items() if k not in ("limit", "offset", "orderBy", "returnType")}
        planner = self.planner()
        query = planner.plan(table, wanted, params)
        query.limit = None
        return planner.rows(query).agg(F.count(F.lit(1)).alias("count"))

    def count(self, table: str, wanted: dict | None = None, params: dict | None = None) -> int:
        return self.counted(table, wanted, params).first()[0]

    def size(self, table: str, wanted: dict | None = None, params: dict | None = None) -> int:
        """Bytes of the rows as JSON text: an approximation of what they take elsewhere."""
        df = self.find(table, wanted, params)
        return df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]

    def get_info(self, table: str) -> dict:
        info = self.catalog.table(table)
        rules = self.rules.get(table, TableRules()) if self.rules is not None else None
        return {
            "name": table,
            "is_view": info.is_view,
            "label": info.label or table,
            "primary_key": list(info.primary_key),
            "uniqueColumnGroups": [list(g) for g in info.unique_groups()],
            "joins": sorted(self.catalog.edges.get(table, {})),
            "publishInfo": {c: rules is None or getattr(rules, c) is not None for c in ("select", "insert", "update", "delete")},
        }

    def get_columns(self, table: str) -> list[dict]:
        info = self.catalog.table(table)
        rules = self.rules.get(table, TableRules()) if self.rules is not None else None

        def may(command: str, attribute: str) -> set[str]:
            if rules is None:
                return set(info.columns)
            rule = getattr(rules, command)
            if rule is None:
                return set()
            fields = getattr(rule, attribute)
            return set(parse_fields(rule.fields if fields is None else fields, info.columns)) if hasattr(rule, "fields") else set(info.columns)

        read, filtered, sorted_by = may("select", "fields"), may("select", "filter_fields"), may("select", "order_by_fields")
        inserted, updated = may("insert", "fields"), may("update", "fields")
        out = []
        for field in info.df.schema.fields:
            references = [{"ftable": t, "cols": [a for a, _ in c], "fcols": [b for _, b in c]} for t, cs in self.catalog.edges.get(table, {}).items() for c in cs if field.name in [a for a, _ in c]]
            simple = field.dataType.simpleString()
            out.append({
                "name": field.name, "data_type": simple, "is_nullable": field.nullable, "is_pkey": field.name in info.primary_key, "references": references,
                "has_default": field.name in info.defaults, "select": field.name in read, "filter": field.name in filtered,
                "orderBy": field.name in sorted_by and not simple.startswith(("struct", "map", "variant")), "insert": field.name in inserted, "update": field.name in updated,
            })
        return out

    # -- SQL, streaming out, cancelling --------------------------------------------------------

    def sql(self, query: str, args: dict | list | None = None) -> DataFrame:
        """Raw SQL with bound (not pasted) parameters, over the catalog's tables as views."""
        if self.rules is not None:
            raise QueryError("Not allowed to run raw SQL")
        for name, info in self.catalog.tables.items():
            info.df.createOrReplaceTempView(f"`{name}`")
        return self.spark.sql(query, args=args)

    def sql_result(self, query: str, args: dict | list | None = None, return_type: str | None = None) -> object:
        df = self.sql(query, args)
        if return_type == "statement":
            return df._jdf.queryExecution().optimizedPlan().toString()
        if return_type in ("row", "value"):
            first = df.first()
            return first and (first.asDict(True) if return_type == "row" else first[0])
        if return_type == "values":
            return [r[0] for r in df.collect()]
        if return_type == "rows":
            return [r.asDict(True) for r in df.collect()]
        return {"rows": [tuple(r) for r in df.collect()], "fields": [{"name": f.name, "dataType": f.dataType.simpleString()} for f in df.schema.fields]}

    @staticmethod
    def stream(df: DataFrame, batch: int = 1000, limit: int | None = None) -> Iterator[list]:
        """Rows in lists of at most batch; partitions come to the driver one after the other."""
        held: list = []
        for row in (df if limit is None else df.limit(limit)).toLocalIterator(prefetchPartitions=True):
            held.append(row)
            if len(held) == batch:
                yield held
                held = []
        if held:
            yield held

    def run_with_abort(self, action, signal: threading.Event | None = None, timeout: float | None = None):
        """action() under a job tag whose jobs the signal or the timeout cancels."""
        timeout = timeout if timeout is not None else CALLER_TIMEOUT if self.rules is not None else OWN_TIMEOUT
        tag, done = f"quillon-{uuid.uuid4().hex}", threading.Event()
        signal = signal or threading.Event()
        stopped: list[str] = []
        context = self.spark.sparkContext

        def watch() -> None:
            left = timeout
            while not done.wait(0.05):
                left -= 0.05
                if signal.is_set() or left <= 0:
                    if not stopped:
                        stopped.append("aborted" if signal.is_set() else "timed out")
                    context.cancelJobsWithTag(tag)  # again and again: a query still being planned has no job yet

        context.addJobTag(tag)
        watcher = threading.Thread(target=watch, daemon=True)
        watcher.start()
        try:
            return action()
        except Exception as error:
            if stopped:
                raise QueryError(f"The query was {stopped[0]}") from error
            raise
        finally:
            done.set()
            context.removeJobTag(tag)
