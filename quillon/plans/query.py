"""From (filter, params) to an intermediate representation, and from that to a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import QueryError
from quillon.functions.registry import Scope, build_call, find_function, is_call
from quillon.operators.filters import FilterScope, compile_filter
from quillon.operators.joins import exists_joined, keyed, top_rows
from quillon.operators.sorting import SortKey, parse_order
from quillon.plans.access import SelectRule
from quillon.plans.fields import check, is_on, parse_fields
from quillon.sources.catalog import Catalog, Hop

DEFAULT_LIMIT = 1000
PARAMS = {"select", "orderBy", "offset", "limit", "returnType", "groupBy", "having"}
JOIN_KEYS = {"$leftJoin", "$innerJoin", "select", "filter", "having", "orderBy", "limit", "offset"}
ROOT = "qroot"
UNSET = object()


@dataclass
class Item:
    """One item of a select."""

    alias: str
    kind: str  # column, function, aggregation, computed, rows, join
    column: Column | None = None
    dtype: T.DataType | None = None
    join: NestedJoin | None = None


@dataclass
class NestedJoin:
    hops: list[Hop]
    inner: bool
    query: Query


@dataclass
class Query:
    """What is asked of one table. Columns are of the table alone, so that a Query nests in another."""

    table: str
    source: DataFrame
    scope: Scope
    items: list[Item]
    where: Column | None = None
    group: bool = False
    having: object = None
    order: list[SortKey] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0

    @property
    def aggregated(self) -> bool:
        return any(x.kind == "aggregation" for x in self.items)

    @property
    def joins(self) -> list[Item]:
        return [x for x in self.items if x.kind == "join"]


def natural(value: object, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise QueryError(f"Unexpected {name} value: {value!r}. Expecting a non-negative integer")
    return value


class Planner:
    """Parses requests against a catalog and the caller's rules (by table; None: everything is allowed)."""

    def __init__(self, catalog: Catalog, rules: dict[str, SelectRule] | None = None) -> None:
        self.catalog, self.rules = catalog, rules

    def rule(self, table: str) -> SelectRule:
        if self.rules is None:
            return SelectRule()
        if table not in self.rules:
            raise QueryError(f"Not allowed to access table {table}")
        return self.rules[table]

    def plan(self, table: str, wanted: object = None, params: dict | None = None, nested: bool = False, prefix: str = "") -> Query:
        params = dict(params or {})
        unknown = set(params) - (PARAMS if not nested else PARAMS | JOIN_KEYS)
        if unknown:
            raise QueryError(f"Unknown params: {', '.join(sorted(unknown))}. Expecting: {', '.join(sorted(PARAMS))}")
        info, rule = self.catalog.table(table), self.rule(table)
        allowed = parse_fields(rule.fields, info.columns)
        scope = Scope({c: info.dtype(c) for c in allowed}, prefix)
        items = self.select(table, params.get("select", "*"), scope, nested)
        query = Query(table, info.df, scope, items, group=bool(params.get("groupBy")), having=params.get("having"))
        if query.aggregated and query.joins:
            raise QueryError("A select can't hold aggregates and nested joins")
        query.where = self.conditions(table, wanted, scope, items, rule, nested, prefix)
        query.order = parse_order(params.get("orderBy"))
        self.check_order(query, rule)
        query.offset = natural(params.get("offset") or 0, "offset")
        query.limit = self.row_limit(params.get("limit", UNSET), rule, nested)
        return query

    def row_limit(self, limit: object, rule: SelectRule, nested: bool) -> int | None:
        most = rule.max_limit
        if limit is UNSET:
            return None if nested else DEFAULT_LIMIT if most is None else min(DEFAULT_LIMIT, most)
        if limit is None:
            return most
        if natural(limit, "limit") > (most if most is not None else limit):
            raise QueryError(f"Unexpected limit {limit}. Must be <= {most}")
        return limit

    # -- select -------------------------------------------------------------------------------

    def select(self, table: str, wanted: object, scope: Scope, nested: bool) -> list[Item]:
        plain = lambda name: Item(name, "column", scope.col(name), scope.dtype(name))
        if wanted in ("*", None) or wanted == {}:
            return [plain(n) for n in scope.names] if wanted != {} else []
        if not isinstance(wanted, dict):
            return [plain(n) for n in parse_fields(wanted, scope.names)]
        off = [k for k, v in wanted.items() if v is False or v == 0 and not isinstance(v, (dict, str))]
        if off:
            if len(off) != len(wanted):
                raise QueryError("Cannot include and exclude fields at the same time")
            check(off, scope.names)
            return [plain(n) for n in scope.names if n not in off]
        items: list[Item] = []
        for key, value in wanted.items():
            if key == "*" and is_on(value):
                items += [plain(n) for n in scope.names]
            elif key == "$rowhash" and is_on(value):
                items.append(Item(key, "computed", find_function(key).build(scope, []), T.StringType()))
            elif key in scope.columns and is_on(value) and value != "*":
                items.append(plain(key))
            elif isinstance(value, str) and value.startswith("$"):
                function = find_function(value)
                args = [] if function.kind == "computed" else [key]
                items.append(Item(key, function.kind, function.build(scope, args)))
            elif is_call(value) and not set(value) & {"$leftJoin", "$innerJoin"}:
                function, column = build_call(scope, value)
                items.append(Item(key, function.kind, column))
            else:
                items.append(Item(key, "join", join=self.nested(table, key, value, nested)))
        names = [x.alias for x in items]
        twice = {n for n in names if names.count(n) > 1}
        if twice:
            raise QueryError(f"Duplicate select items: {', '.join(sorted(twice))}")
        if sum(x.kind == "rows" for x in items) > 1:
            raise QueryError("Only one set-returning function is allowed in a select")
        return items

    def nested(self, table: str, key: str, value: object, within: bool) -> NestedJoin:
        if within:
            raise QueryError("Nested joins of nested joins are not supported")
        inner = False
        params: dict = {"select": value}
        path: object = key
        if isinstance(value, dict) and set(value) & {"$leftJoin", "$innerJoin"}:
            if set(value) - JOIN_KEYS or {"$leftJoin", "$innerJoin"} <= set(value):
                raise QueryError(f"Invalid join {key}: {', '.join(sorted(value))}")
            inner = "$innerJoin" in value
            path = value["$innerJoin" if inner else "$leftJoin"]
            params = {k: v for k, v in value.items() if not k.startswith("$")}
        hops = self.catalog.reachable(table, path) if isinstance(path, str) and "." not in path else self.catalog.path(table, path)
        if hops is None:
            if isinstance(path, str) and path in self.catalog.tables:
                raise QueryError(f"Joining {table} with {path} is not possible")
            raise QueryError(f"Invalid or disallowed select item {key!r}")
        wanted = params.pop("filter", None)
        return NestedJoin(hops, inner, self.plan(hops[-1].table, wanted, params, nested=True))

    # -- where --------------------------------------------------------------------------------

    def conditions(self, table: str, wanted: object, scope: Scope, items: list[Item], rule: SelectRule, nested: bool, prefix: str) -> Column | None:
        aliases = {x.alias: (x.column, x.dtype) for x in items if x.kind in ("function", "computed") and x.column is not None}
        aggregates = {x.alias for x in items if x.kind in ("aggregation", "rows")} - set(scope.columns)
        filterable = parse_fields(rule.filter_fields, scope.names) if rule.filter_fields is not None else None
        exists = None if nested else lambda kind, value: self.exists(table, kind, value)
        condition = compile_filter(FilterScope(scope, filterable, aliases, aggregates, exists), wanted)
        forced = None
        if rule.forced_filter:
            info = self.catalog.table(table)
            whole = Scope({c: info.dtype(c) for c in info.columns}, prefix)
            everywhere = Planner(self.catalog)
            forced = compile_filter(FilterScope(whole, exists=lambda kind, value: everywhere.exists(table, kind, value)), rule.forced_filter)
        parts = [c for c in (condition, forced) if c is not None]
        return reduce(Column.__and__, parts) if parts else None

    def exists(self, table: str, kind: str, value: dict) -> Column:
        joined = kind.endswith("Joined")
        out = None
        entries = [(value["path"], value.get("filter") or {})] if joined and isinstance(value.get("path"), (list, tuple)) else list(value.items())
        for path, wanted in entries:
            hops = self.catalog.path(table, path) if joined else [Hop(path, ())]
            target = hops[-1].table
            inner = self.plan(target, wanted, {"limit": None}, nested=True)
            rows = inner.source if inner.where is None else inner.source.where(inner.where)
            test = exists_joined(self.catalog, ROOT, hops, rows) if joined else rows.select(F.lit(1)).exists()
            out = test if out is None else out & test
        return ~out if kind.startswith("$not") else out

    # -- order --------------------------------------------------------------------------------

    def check_order(self, query: Query, rule: SelectRule) -> None:
        aliases = {x.alias for x in query.items}
        sortable = parse_fields(rule.order_by_fields, query.scope.names) if rule.order_by_fields is not None else query.scope.names
        for key in query.order:
            if key.key in aliases:
                item = next(x for x in query.items if x.alias == key.key)
                if item.kind != "column" or key.key in sortable:
                    continue
            elif key.key in sortable and not query.aggregated and not query.group:
                continue
            elif "." in key.key:
                relation, name = key.key.split(".", 1)
                join = next((x.join for x in query.joins if x.alias == relation), None)
                if join and (name in {x.alias for x in join.query.items} or (name in join.query.scope.columns and not join.query.aggregated)):
                    continue
            raise QueryError(f"Invalid/disallowed orderBy fields or params: {key.key}")

    # -- DataFrame ----------------------------------------------------------------------------

    def rows(self, query: Query) -> DataFrame:
        """The result, lazily."""
        base = query.source.alias(ROOT)
        if query.where is not None:
            base = base.where(query.where)
        if query.aggregated or query.group:
            out = grouped(base, query, [])
            out = sort(out, query.order, {}) if query.order else out
        elif query.joins:
            return self.with_joins(base, query)
        else:
            out = plain(base, query)
        return window(out, query)

    def with_joins(self, base: DataFrame, query: Query) -> DataFrame:
        own = [x for x in query.items if x.kind != "join"]
        hidden = {key.key: f"qsort_{i}" for i, key in enumerate(query.order)}
        parents = base.select(*[F.col(f"{ROOT}.`{c}`") for c in query.source.columns])
        aliases = {x.alias: x.column for x in own if x.kind != "column"}
        # Where no join decides which parents there are nor their order, they are cut before they meet children.
        own_order = all(k.key in query.scope.columns or k.key in aliases for k in query.order)
        cut = own_order and (query.limit is not None or query.offset > 0) and not any(x.join.inner for x in query.joins)
        if cut:
            ordered = base.orderBy(*[k.order(aliases.get(k.key, query.scope.col(k.key))) for k in query.order]) if query.order else base
            parents = window(ordered, query).select(*[F.col(f"{ROOT}.`{c}`") for c in query.source.columns])
        # Which parents a limit leaves is settled, and may be asked twice, if the order tells all rows apart.
        settled = cut and any(set(g) <= {k.key for k in query.order} for g in self.catalog.table(query.table).unique_groups())
        out = parents
        for number, item in enumerate(query.joins):
            sorts = {k.key: (k.key.split(".", 1)[1], k.asc, hidden[k.key]) for k in query.order if k.key.startswith(f"{item.alias}.") and k.key not in query.scope.columns}
            side, keys = nested_side(self.catalog, parents, item, list(sorts.values()), settled)
            side = side.select(*[F.col(f"key__{k}").alias(f"k{number}__{k}") for k in keys], F.col("qnested").alias(f"n{number}"), *[s[2] for s in sorts.values()])
            tests = [F.col(f"`{k}`").eqNullSafe(F.col(f"k{number}__{k}")) if len(item.join.hops[0].on) > 1 else F.col(f"`{k}`") == F.col(f"k{number}__{k}") for k in keys]
            out = out.join(side, reduce(Column.__and__, tests), "inner" if item.join.inner else "left").drop(*[f"k{number}__{k}" for k in keys])
            empty = F.array().cast(side.schema[f"n{number}"].dataType)
            out = out.withColumn(f"n{number}", F.coalesce(F.col(f"n{number}"), empty))
        if query.order:
            order = [k.order(F.col(hidden[k.key]) if k.key not in query.scope.columns and k.key not in aliases and "." in k.key else aliases.get(k.key, F.col(f"`{k.key}`"))) for k in query.order]
            out = out.orderBy(*order)
        if not cut:
            out = window(out, query)
        places = {x.alias: i for i, x in enumerate(query.joins)}
        return out.select(*[(F.col(f"n{places[x.alias]}") if x.kind == "join" else x.column).alias(x.alias) for x in query.items])


def window(out: DataFrame, query: Query) -> DataFrame:
    if query.offset:
        out = out.offset(query.offset)
    return out if query.limit is None else out.limit(query.limit)


def sort(out: DataFrame, order: list[SortKey], named: dict[str, Column]) -> DataFrame:
    return out.orderBy(*[k.order(named.get(k.key, F.col(f"`{k.key}`"))) for k in order])


def plain(base: DataFrame, query: Query) -> DataFrame:
    aliases = {x.alias: x.column for x in query.items}
    if any(x.kind == "rows" for x in query.items):
        out = base.select(*[x.column.alias(x.alias) for x in query.items], *[query.scope.col(k.key).alias(f"qs_{k.key}") for k in query.order if k.key not in aliases])
        out = sort(out, query.order, {k.key: F.col(f"`qs_{k.key}`") for k in query.order if k.key not in aliases}) if query.order else out
        return out.select(*[F.col(f"`{x.alias}`") for x in query.items])
    if query.having is not None:
        scope = FilterScope(query.scope, aliases={x.alias: (x.column, x.dtype) for x in query.items})
        condition = compile_filter(scope, query.having)
        base = base if condition is None else base.where(condition)
    if query.order:  # before the projection, so that columns that are not selected can order
        base = sort(base, query.order, {k: c for k, c in aliases.items()} | {k.key: query.scope.col(k.key) for k in query.order if k.key not in aliases})
    return base.select(*[x.column.alias(x.alias) for x in query.items])


def grouped(base: DataFrame, query: Query, keys: list[str]) -> DataFrame:
    """GROUP BY keys and what is not an aggregate, then HAVING. Without aggregates: distinct rows."""
    inner = [x for x in query.items if x.kind == "rows"]
    if inner:  # explode first, then group by its values
        base = base.withColumn("qrows", inner[0].column)
    column = lambda x: F.col("qrows") if x.kind == "rows" else x.column
    own = [x for x in query.items if x.kind != "aggregation"]
    sums = [x.column.alias(x.alias) for x in query.items if x.kind == "aggregation"]
    extra: list[Column] = []
    condition = None
    if query.having is not None:
        aliases = {x.alias: (F.col(f"`{x.alias}`"), x.dtype) for x in query.items}

        def call(value: dict) -> Column:
            function, made = build_call(query.scope, value)
            if function.kind != "aggregation":
                return made
            name = f"qhaving_{len(extra)}"
            extra.append(made.alias(name))
            return F.col(name)

        condition = compile_filter(FilterScope(query.scope, aliases=aliases, call=call), query.having)
    by = [F.col(k).alias(k) for k in keys] + [column(x).alias(x.alias) for x in own]
    if sums or extra:
        out = base.groupBy(*by).agg(*sums, *extra)
    else:
        out = base.select(*by).distinct()
    if condition is not None:
        out = out.where(condition)
    return out.select(*[F.col(k) for k in keys], *[F.col(f"`{x.alias}`") for x in query.items])


def nested_side(catalog: Catalog, parents: DataFrame, item: Item, sorts: list[tuple[str, bool, str]], wanted_only: bool = False) -> tuple[DataFrame, list[str]]:
    """A row for each join key: the key columns, qnested (array of structs), and values to sort parents by.

    The children are aggregated once for each key, before they meet the parents. A limit becomes a
    rank filter, which Catalyst cuts to a limit in each group before the shuffle. wanted_only: the
    parents are few; children of no other keys are ranked or aggregated.
    """
    query, hops = item.join.query, item.join.hops
    last = query.source.alias(ROOT)
    if query.where is not None:
        last = last.where(query.where)
    side, keys = keyed(catalog, parents, hops, last)
    names = [f"key__{k}" for k in keys]
    side = side.select(*names, *[F.col(f"`last__{c}`").alias(c) for c in query.source.columns])
    if wanted_only:
        wanted = parents.select(*[F.col(f"`{k}`").alias(f"wanted__{k}") for k in keys])
        same = [F.col(f"key__{k}").eqNullSafe(F.col(f"wanted__{k}")) if len(hops[0].on) > 1 else F.col(f"key__{k}") == F.col(f"wanted__{k}") for k in keys]
        side = side.join(wanted, reduce(Column.__and__, same), "left_semi")
    if query.aggregated or query.group:
        side = grouped(side, query, names)
        values = {x.alias: F.col(f"`{x.alias}`") for x in query.items}
    elif any(x.kind == "rows" for x in query.items):
        side = side.select(*names, *[x.column.alias(x.alias) for x in query.items])
        values = {x.alias: F.col(f"`{x.alias}`") for x in query.items}
    else:
        values = {x.alias: x.column for x in query.items}
    sortable = lambda key: values.get(key, F.col(f"`{key}`"))
    order = [k.order(sortable(k.key)) for k in query.order]
    ranked = bool(order) or query.limit is not None or query.offset
    if query.limit is not None or query.offset:
        side = top_rows(side, [F.col(n) for n in names], order or [F.lit(0)], query.limit, query.offset)
    elif order:
        side = top_rows(side, [F.col(n) for n in names], order, None, 0)
    made = F.struct(*[c.alias(a) for a, c in values.items()])
    collected = F.transform(F.array_sort(F.collect_list(F.struct(F.col("rn"), made.alias("row")))), lambda x: x["row"]) if ranked else F.collect_list(made)
    extremes = [(F.min if asc else F.max)(sortable(name)).alias(alias) for name, asc, alias in sorts]
    return side.groupBy(*names).agg(collected.alias("qnested"), *extremes), keys
