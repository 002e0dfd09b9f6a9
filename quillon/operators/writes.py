"""Copy-on-write inserts, updates, upserts and deletes.

A write makes a new DataFrame for the table and swaps it into the catalog when it is known to be
allowed; until then nothing has changed. Several writes become one swap with transaction().
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from contextlib import contextmanager
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import QueryError
from quillon.functions.geo import point_of
from quillon.functions.json import rebuilt
from quillon.functions.json_schema import is_valid
from quillon.functions.registry import Scope, find_function, is_call
from quillon.operators.filters import FilterScope, compile_filter, literal
from quillon.plans.access import DeleteRule, InsertRule, UpdateRule, both
from quillon.plans.fields import parse_fields
from quillon.plans.query import ROOT, Planner
from quillon.sources.catalog import TableInfo

if TYPE_CHECKING:
    from quillon.engine import Engine

Hook = Callable[[DataFrame, DataFrame], None]
#: Functions of points that may stand in data.
POINTS = {"$ST_GeomFromText", "$ST_PointFromText", "$ST_GeomFromEWKT", "$ST_GeomFromGeoJSON", "$ST_Point", "$ST_MakePoint", "$ST_MakePointM"}


def value_column(value: object, dtype: T.DataType, column: Column | None = None) -> Column:
    """A literal, or {"$to_timestamp": [ms]}, {"$merge": [json]} (updates only) or a point function."""
    if is_call(value):
        name, args = next(iter(value.items()))
        if name == "$to_timestamp":
            return F.timestamp_millis(F.lit(int(args[0]))).cast(dtype)
        if name == "$merge":
            if column is None:
                raise QueryError("$merge is for updates only")
            return merged(column, args)
        if name in POINTS:
            if name in ("$ST_Point", "$ST_MakePoint", "$ST_MakePointM"):
                x, y = float(args[0]), float(args[1])
            elif name == "$ST_GeomFromGeoJSON":
                x, y = point_of({"geojson": args[0]})
            else:
                x, y = point_of({"text": args[0]})
            return F.struct(F.lit(x).alias("lng"), F.lit(y).alias("lat")).cast(dtype)
        raise QueryError(f"Function {name} can't be used in data")
    if value is None:
        return F.lit(None).cast(dtype)
    if isinstance(value, dict) and isinstance(dtype, T.StructType):
        return F.struct(*[F.lit(value.get(f.name)).cast(f.dataType).alias(f.name) for f in dtype.fields])
    if isinstance(value, (dict, list)) and isinstance(dtype, T.StringType):
        import json

        return F.lit(json.dumps(value, separators=(",", ":")))
    return literal(value, dtype).cast(dtype)


def merged(column: Column, args: list) -> Column:
    import json

    extra = [json.loads(a) if isinstance(a, str) else a for a in args if not (isinstance(a, str) and not a.lstrip().startswith("{"))]
    return rebuilt(F.coalesce(column, F.lit("{}")), lambda d: reduce(lambda x, y: {**x, **y}, extra, d))


class Writer:
    """The writes of an engine, which keeps one of these: hooks and open transactions hold for all of them."""

    def __init__(self, engine: Engine) -> None:
        self.engine, self.catalog, self.spark = engine, engine.catalog, engine.spark
        self.before: dict[str, list[Callable]] = {}
        self.after: dict[str, list[tuple[Hook, frozenset[str] | None]]] = {}
        self.instead_of_delete: dict[str, Callable[[dict | None], None]] = {}
        self._active: set[str] = set()
        self._committed: list[Callable[[], None]] | None = None

    # -- shared -------------------------------------------------------------------------------

    def rule(self, table: str, command: str):
        if self.engine.rules is None:
            return {"insert": InsertRule, "update": UpdateRule, "delete": DeleteRule}[command]()
        if table not in self.engine.rules:
            raise QueryError(f"Not allowed to access table {table}")
        return self.engine.rules[table].need(command)

    def condition(self, info: TableInfo, wanted: object, planner: Planner | None = None, allowed: list[str] | None = None) -> Column:
        """A filter of our own: every column and table may be tested, unless a planner and columns are given."""
        scope = Scope({c: info.dtype(c) for c in info.columns})
        planner = planner or Planner(self.catalog)
        found = compile_filter(FilterScope(scope, allowed, exists=lambda kind, value: planner.exists(info.name, kind, value)), wanted)
        return F.lit(True) if found is None else F.coalesce(found, F.lit(False))

    def hits(self, info: TableInfo, wanted: dict | None, rule: UpdateRule | DeleteRule) -> Column:
        """The caller's filter under the caller's rules, and the rule's own filter, which those don't bind."""
        found = self.condition(info, wanted, self.engine.planner(), self.filterable(info, rule))
        return found & self.condition(info, rule.forced_filter) if rule.forced_filter else found

    def filterable(self, info: TableInfo, rule: UpdateRule | DeleteRule) -> list[str] | None:
        """Columns that a caller may test in a write: filter_fields; without, what the caller may read or update."""
        if rule.filter_fields is not None:
            return parse_fields(rule.filter_fields, info.columns)
        if self.engine.rules is None:
            return None
        select = self.engine.rules[info.name].select
        named = [r.fields for r in (select, rule) if r is not None and hasattr(r, "fields")]
        known = {c for fields in named for c in parse_fields(fields, info.columns)}
        return [c for c in info.columns if c in known] if named else None

    def verify(self, info: TableInfo, rows: DataFrame, check_filter: dict | None) -> None:
        """Column checks and the rule's check filter hold for every row written."""
        tests = []
        for column, checks in info.checks.items():
            c = F.col(f"`{column}`")
            if checks.get("min") is not None:
                tests.append(c >= checks["min"])
            if checks.get("max") is not None:
                tests.append(c <= checks["max"])
            if checks.get("lowerCased"):
                tests.append(c == F.lower(c))
            if checks.get("trimmed"):
                tests.append(c == F.trim(c))
            if checks.get("enum"):
                tests.append(c.isin(*checks["enum"]))
        tests = [F.coalesce(t, F.lit(True)) for t in tests]
        for column, checks in info.checks.items():
            c = F.col(f"`{column}`")
            if checks.get("notNull"):
                tests.append(c.isNotNull())
            if checks.get("jsonSchema"):
                tests.append(is_valid(c, checks["jsonSchema"]) | c.isNull())
            if checks.get("reference"):
                target, theirs = checks["reference"]
                known = self.catalog.table(target).df.select(F.col(f"`{theirs}`").alias("known__"))
                if not rows.where(c.isNotNull()).join(known, c == F.col("known__"), "left_anti").isEmpty():
                    raise QueryError(f"Insert/update on {info.name} violates the reference of {column} to {target}")
        if check_filter:
            tests.append(self.condition(info, check_filter))
        if tests and not rows.alias(ROOT).where(~reduce(Column.__and__, tests)).isEmpty():
            raise QueryError(f"Insert/update on {info.name} violates a check")

    def returned(self, info: TableInfo, rows: DataFrame, returning: object) -> DataFrame:
        """A select over the rows written; of functions only those of a single column."""
        if returning is None:
            return rows.select(F.count(F.lit(1)).alias("count"))
        if isinstance(returning, dict):
            for value in returning.values():
                name = value if isinstance(value, str) and value.startswith("$") else next(iter(value)) if is_call(value) else None
                if name and not (find_function(name).kind == "function" and find_function(name).single):
                    raise QueryError(f"{name} can't be used in returning")
        planner = self.engine.planner()
        query = planner.plan(info.name, None, {"select": returning, "limit": None})
        query.source, query.where = rows, None
        return planner.rows(query)

    @contextmanager
    def transaction(self):
        """All tables go back to what they were if the block raises; on_commit callbacks run if it doesn't."""
        kept = {name: info.df for name, info in self.catalog.tables.items()}
        outer, self._committed = self._committed, []
        try:
            yield self
        except BaseException:
            self._committed = outer
            for name, df in kept.items():
                self.catalog.tables[name].df = df
            raise
        calls, self._committed = self._committed, outer
        for call in calls:
            self.on_commit(call)

    def on_commit(self, call: Callable[[], None]) -> None:
        """Run call once the outermost transaction has ended well; at once outside of one."""
        if self._committed is None:
            call()
        else:
            self._committed.append(call)

    def after_change(self, table: str, command: str, hook: Hook, changed_fields: Iterable[str] | None = None) -> None:
        """Run hook(old table, rows written) after a write; of updates only those that set one of changed_fields."""
        hook = (hook, None if changed_fields is None else frozenset(changed_fields))
        self.after.setdefault(f"{table}.{command}", []).append(hook)

    def swap(self, info: TableInfo, df: DataFrame, affected: DataFrame, command: str, fields: Iterable[str] = ()) -> None:
        """Take the new state, then run hooks; a hook that raises takes the table back. Hooks don't re-enter."""
        old = info.df
        info.df = df
        key = f"{info.name}.{command}"
        if key in self._active:
            return
        self._active.add(key)
        try:
            for hook, only in self.after.get(key, []):
                if only is None or only & set(fields):
                    hook(old, affected)
        except BaseException:
            info.df = old
            raise
        finally:
            self._active.discard(key)

    # -- insert -------------------------------------------------------------------------------

    def insert(self, table: str, rows: dict | Iterable[dict] | DataFrame, on_conflict: str | dict | None = None, returning: object = None, parent: str | None = None) -> DataFrame:
        """Insert rows; absent columns take their default, or null. on_conflict: DoNothing, DoUpdate or
        {"action": ..., "conflictColumns": [...]}. Nested rows: see nested()."""
        info, rule = self.catalog.table(table), self.rule(table, "insert")
        if rule.allowed_parents is not None and parent not in rule.allowed_parents:
            raise QueryError(f"Rows of {table} may only be inserted within rows of {', '.join(rule.allowed_parents)}")
        if isinstance(rows, DataFrame):
            new, given = self.typed(info, rows, rule), [c for c in rows.columns]
        else:
            data = [rows] if isinstance(rows, dict) else list(rows)
            for hook in self.before.get(f"{table}.insert", []):
                data = [hook(r) for r in data]
            if rule.validate:
                data = [rule.validate(dict(r)) for r in data]
            data = [self.nested(info, r, rule) for r in data]
            new, given = self.literal_rows(info, data, rule)
        self.verify(info, new, rule.check_filter)
        state, affected = self.conflicts(info, new, given, on_conflict)
        self.swap(info, state, affected, "insert")
        return self.returned(info, affected, returning)

    def fields(self, info: TableInfo, names: Iterable[str], rule: InsertRule | UpdateRule) -> None:
        allowed = parse_fields(rule.fields, info.columns)
        bad = [n for n in names if n not in allowed]
        if bad:
            raise QueryError(f"Disallowed/invalid columns in data for {info.name}: {', '.join(bad)}. Allowed: {', '.join(allowed)}")

    def literal_rows(self, info: TableInfo, data: list[dict], rule: InsertRule) -> tuple[DataFrame, list[str]]:
        if not data:
            return info.df.limit(0), []
        for row in data:
            self.fields(info, [k for k in row if k not in rule.forced_data], rule)
        data = [{**r, **rule.forced_data} for r in data]
        given = [c for c in info.columns if any(c in r for r in data)]
        one = self.spark.range(1)
        structs = [F.struct(*[(value_column(r[c], info.dtype(c)) if c in r else self.default(info, c)).alias(c) for c in info.columns]) for r in data]
        return one.select(F.explode(F.array(*structs)).alias("r")).select("r.*"), given

    def typed(self, info: TableInfo, rows: DataFrame, rule: InsertRule) -> DataFrame:
        self.fields(info, [c for c in rows.columns if c not in rule.forced_data], rule)
        given = {c: F.col(f"`{c}`").cast(info.dtype(c)) for c in rows.columns if c in info.columns}
        given |= {c: value_column(v, info.dtype(c)) for c, v in rule.forced_data.items()}
        return rows.select(*[given.get(c, self.default(info, c)).alias(c) for c in info.columns])

    def default(self, info: TableInfo, column: str) -> Column:
        value = info.defaults.get(column)
        return value.cast(info.dtype(column)) if isinstance(value, Column) else value_column(value, info.dtype(column))

    def conflicts(self, info: TableInfo, new: DataFrame, given: list[str], on_conflict: object) -> tuple[DataFrame, DataFrame]:
        """The table's next state and the rows that were inserted or updated."""
        groups = info.unique_groups()
        action, columns = on_conflict, None
        if isinstance(on_conflict, dict):
            action, columns = on_conflict.get("action"), on_conflict.get("conflictColumns")
        if action is None:
            for group in groups:
                self.distinct(info, new, group)
                if not new.join(info.df, list(group), "left_semi").isEmpty():
                    raise QueryError(f"duplicate key value violates unique constraint of {info.name} ({', '.join(group)})")
            return info.df.unionByName(new), new
        if action not in ("DoNothing", "DoUpdate"):
            raise QueryError(f"Invalid onConflict {action!r}. Expecting DoNothing or DoUpdate")
        group = list(columns or next((g for g in groups if set(g) & set(given)), info.primary_key))
        if not group:
            raise QueryError(f"{info.name} has no unique columns to conflict on")
        if action == "DoNothing":
            fresh = new.dropDuplicates(group).join(info.df, group, "left_anti").select(*info.columns)
            return info.df.unionByName(fresh), fresh
        self.distinct(info, new, tuple(group))
        changed = [c for c in given if c not in group]
        incoming = new.select(*[F.col(f"`{c}`").alias(f"new__{c}") for c in info.columns], F.lit(True).alias("new__"))
        match = reduce(Column.__and__, [F.col(f"`{c}`") == F.col(f"`new__{c}`") for c in group])
        both_sides = info.df.join(incoming, match, "left")
        pick = [F.when(F.col("new__"), F.col(f"`new__{c}`")).otherwise(F.col(f"`{c}`")).alias(c) if c in changed else F.col(f"`{c}`") for c in info.columns]
        updated = both_sides.where("new__").select(*pick)
        fresh = new.join(info.df, group, "left_anti").select(*info.columns)
        return both_sides.select(*pick).unionByName(fresh), updated.unionByName(fresh)

    def distinct(self, info: TableInfo, new: DataFrame, group: tuple[str, ...]) -> None:
        if not new.where(reduce(Column.__and__, [F.col(f"`{c}`").isNotNull() for c in group])).groupBy(*group).count().where("count > 1").isEmpty():
            raise QueryError(f"duplicate key value violates unique constraint of {info.name} ({', '.join(group)})")

    def nested(self, info: TableInfo, row: dict, rule: InsertRule | UpdateRule) -> dict:
        """Rows of other tables within a row: referenced ones first (their key fills the column), children after.

        A column that refers to another table may hold that table's row; a key that names a table that
        refers to this one holds its children. Keys must be given, as Parquet has no sequences.
        """
        out, children = {}, []
        for key, value in row.items():
            targets = [(t, c) for t, cs in self.catalog.edges.get(info.name, {}).items() for c in cs if c[0][0] == key and len(c) == 1]
            if key in info.columns and isinstance(value, dict) and targets and not is_call(value) and not isinstance(info.dtype(key), (T.StructType, T.MapType)):
                table, ((_, theirs),) = targets[0]
                self.insert(table, value, parent=info.name)
                out[key] = value[theirs]
            elif key not in info.columns and key in self.catalog.edges.get(info.name, {}):
                children.append((key, [value] if isinstance(value, dict) else list(value)))
            else:
                out[key] = value
        for table, (least, most) in getattr(rule, "required_nested", {}).items():
            n = sum(len(rows) for name, rows in children if name == table)
            if n < least or (most is not None and n > most):
                raise QueryError(f"{info.name} needs {least} to {most or 'any number of'} rows of {table}, got {n}")
        for table, rows in children:
            constraint = self.catalog.edges[info.name][table][0]
            self.insert(table, [{**r, **{theirs: out[mine] for mine, theirs in constraint}} for r in rows], parent=info.name)
        return out

    # -- update, upsert, delete ---------------------------------------------------------------

    def update(self, table: str, wanted: dict, data: dict, returning: object = None, multi: bool = True, remove_disallowed: bool = False) -> DataFrame:
        info, rule = self.catalog.table(table), self.rule(table, "update")
        hit = self.hits(info, wanted, rule)
        for hook in self.before.get(f"{table}.update", []):
            data = hook(data)
        if remove_disallowed:
            allowed = parse_fields(rule.fields, info.columns)
            data = {k: v for k, v in data.items() if k in allowed}
        if any(isinstance(v, dict) and not is_call(v) and isinstance(info.dtype(k), T.AtomicType) and any(c[0][0] == k for cs in self.catalog.edges[table].values() for c in cs) for k, v in data.items() if k in info.columns):
            if info.df.alias(ROOT).where(hit).limit(2).count() > 1:
                raise QueryError("An update that matches several rows can't insert nested rows")
            data = self.nested(info, data, rule)
        if not rule.dynamic_fields:
            self.fields(info, [k for k in data if k not in rule.forced_data], rule)
        data = {**data, **rule.forced_data}
        if not data:
            raise QueryError("No data to update with")
        bad = [k for k in data if k not in info.columns]
        if bad:
            raise QueryError(f"Disallowed/invalid columns in data for {table}: {', '.join(bad)}")
        marked = info.df.alias(ROOT).select(f"{ROOT}.*", hit.alias("hit__"))
        self.dynamic(info, marked, rule, data)
        new = [F.when(F.col("hit__"), value_column(data[c], info.dtype(c), F.col(f"`{c}`"))).otherwise(F.col(f"`{c}`")).alias(c) if c in data else F.col(f"`{c}`") for c in info.columns]
        affected = marked.where("hit__").select(*new)
        if not multi and affected.limit(2).count() > 1:
            raise QueryError("The update matches several rows, but multi is off")
        self.verify(info, affected, rule.check_filter)
        self.swap(info, marked.select(*new), affected, "update", data)
        return self.returned(info, affected, returning)

    def dynamic(self, info: TableInfo, marked: DataFrame, rule: UpdateRule, data: dict) -> None:
        """Rows that match a dynamic rule allow its fields alone; others the rule's own."""
        if not rule.dynamic_fields:
            return
        named = [k for k in data if k not in rule.forced_data]
        rest, overlap = F.lit(True), F.lit(0)
        for wanted, fields in rule.dynamic_fields:
            test = self.condition(info, wanted)
            overlap = overlap + test.cast("int")
            if set(named) - set(parse_fields(fields, info.columns)) and not marked.where(F.col("hit__") & test).isEmpty():
                raise QueryError(f"Disallowed fields for some rows: {', '.join(named)}")
            rest = rest & ~test
        if not marked.where(F.col("hit__") & (overlap > 1)).isEmpty():
            raise QueryError("dynamic fields overlap")
        if set(named) - set(parse_fields(rule.fields, info.columns)) and not marked.where(F.col("hit__") & rest).isEmpty():
            raise QueryError(f"Disallowed fields: {', '.join(named)}")

    def update_batch(self, table: str, changes: Iterable[tuple[dict, dict]]) -> None:
        """All of them in order, or none."""
        if self.rule(table, "update").check_filter:
            raise QueryError("update_batch is not allowed with a check filter")
        with self.transaction():
            for wanted, data in changes:
                self.update(table, wanted, data)

    def upsert(self, table: str, wanted: dict, data: dict, returning: object = None) -> DataFrame:
        """Update what the filter finds; where it finds nothing, insert data and the filter's values (which win)."""
        info = self.catalog.table(table)
        if not info.df.alias(ROOT).where(self.hits(info, wanted, self.rule(table, "update"))).isEmpty():
            return self.update(table, wanted, data, returning)
        return self.insert(table, {**data, **wanted}, returning=returning)

    def delete(self, table: str, wanted: dict | None = None, returning: object = None) -> DataFrame:
        """Delete what the filter finds; without a filter everything."""
        info, rule = self.catalog.table(table), self.rule(table, "delete")
        if table in self.instead_of_delete:
            self.instead_of_delete[table](both(wanted, rule.forced_filter))
            return self.returned(info, info.df.limit(0), returning)
        hit = self.hits(info, wanted, rule)
        marked = info.df.alias(ROOT).select(f"{ROOT}.*", hit.alias("hit__"))
        affected = marked.where("hit__").select(*[F.col(f"`{c}`") for c in info.columns])
        self.swap(info, marked.where("NOT hit__").select(*[F.col(f"`{c}`") for c in info.columns]), affected, "delete")
        return self.returned(info, affected, returning)

    remove = delete



