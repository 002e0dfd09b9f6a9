"""Access rules: what a caller may select, filter, sort and write, and what is forced upon them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from quillon.errors import QueryError
from quillon.plans.fields import parse_fields


@dataclass(frozen=True)
class SelectRule:
    fields: object = "*"
    filter_fields: object = None  # None: as fields
    order_by_fields: object = None
    forced_filter: dict | None = None
    max_limit: int | None = None


@dataclass(frozen=True)
class InsertRule:
    fields: object = "*"
    forced_data: dict = field(default_factory=dict)
    validate: object = None  # row -> row
    check_filter: dict | None = None
    required_nested: dict = field(default_factory=dict)  # child table -> (least, most or None) rows
    allowed_parents: tuple | None = None  # if set: rows may only come nested in rows of these tables


@dataclass(frozen=True)
class UpdateRule:
    fields: object = "*"
    forced_data: dict = field(default_factory=dict)
    forced_filter: dict | None = None
    filter_fields: object = None
    dynamic_fields: tuple = ()  # (filter, fields): other fields for the rows that match
    check_filter: dict | None = None


@dataclass(frozen=True)
class DeleteRule:
    forced_filter: dict | None = None
    filter_fields: object = None


@dataclass(frozen=True)
class TableRules:
    select: SelectRule | None = None
    insert: InsertRule | None = None
    update: UpdateRule | None = None
    delete: DeleteRule | None = None

    def need(self, command: str):
        rule = getattr(self, command)
        if rule is None:
            raise QueryError(f"{command} is not allowed")
        return rule


ALL = TableRules(SelectRule(), InsertRule(), UpdateRule(), DeleteRule())


def resolve(publish: object, user: object, tables: list[str]) -> dict[str, TableRules]:
    """The rules of a caller. publish: "*", a function of the user, or {table: "*" | TableRules | None}."""
    if callable(publish):
        publish = publish(user)
    if publish == "*":
        return dict.fromkeys(tables, ALL)
    out = {}
    for table, rules in (publish or {}).items():
        if table not in tables:
            raise QueryError(f"Rules name an unknown table {table}")
        if callable(rules):
            rules = rules(user)
        if rules:
            out[table] = ALL if rules == "*" else rules
    return out


def both(a: dict | None, b: dict | None) -> dict | None:
    return {"$and": [a, b]} if a and b else a or b


def narrowed(rules: TableRules, scope: TableRules, columns: list[str]) -> TableRules:
    """Rules within a scope: a command that either lacks is gone, fields are those of both, forced filters AND."""
    out = {}
    for command in ("select", "insert", "update", "delete"):
        own, more = getattr(rules, command), getattr(scope, command)
        if own is None or more is None:
            continue
        changes: dict = {}
        if hasattr(own, "fields"):
            mine = parse_fields(own.fields, columns)
            changes["fields"] = [c for c in parse_fields(more.fields, columns) if c in mine] or [""]
        for name in ("filter_fields", "order_by_fields"):
            if hasattr(own, name) and getattr(more, name) is not None:
                mine = parse_fields(getattr(own, name), columns) if getattr(own, name) is not None else columns
                changes[name] = [c for c in parse_fields(getattr(more, name), columns) if c in mine]
        for name in ("forced_filter", "check_filter"):
            if hasattr(own, name):
                changes[name] = both(getattr(own, name), getattr(more, name))
        if hasattr(own, "forced_data"):
            changes["forced_data"] = {**more.forced_data, **own.forced_data}
        if command == "select" and more.max_limit is not None:
            changes["max_limit"] = more.max_limit if own.max_limit is None else min(own.max_limit, more.max_limit)
        out[command] = replace(own, **changes)
    return TableRules(**out)
