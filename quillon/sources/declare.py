"""Declared tables: columns, defaults, checks, enumerations, JSON schemas, lookups and references.

    {"users": {"columns": {"id": {"sql": "int", "primaryKey": True},
                           "status": {"enum": ["active", "disabled"], "defaultValue": "active"},
                           "kind": {"lookup": {"values": ["a", "b"]}},
                           "prefs": {"jsonbSchema": {"type": {"theme": "string"}}},
                           "org": {"references": {"tableName": "orgs", "columnName": "id"}},
                           "posts": {"joinDef": ["posts"]}}}}
"""

from __future__ import annotations

import math
from numbers import Number

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import QueryError
from quillon.functions.json_schema import check_schema
from quillon.sources.catalog import Catalog

COLUMN_KEYS = {"sql", "primaryKey", "nullable", "enum", "lookup", "jsonbSchema", "references", "joinDef", "defaultValue", "label", "checks", "unique"}


def column_type(name: str, spec: dict, catalog: Catalog) -> T.DataType:
    """Enumerations of finite numbers are doubles, others text; lookups and JSON are text; references have their target's type."""
    kinds = [k for k in ("sql", "enum", "lookup", "jsonbSchema", "references") if k in spec]
    if not kinds or len([k for k in kinds if k not in ("references", "sql")]) > 1:
        raise QueryError(f"Column {name} needs one of sql, enum, lookup, jsonbSchema, references")
    if "sql" in spec:
        return T.StructType.fromDDL(f"c {spec['sql']}")["c"].dataType
    if "enum" in spec:
        finite = all(isinstance(v, Number) and not isinstance(v, bool) and math.isfinite(v) for v in spec["enum"])
        return T.DoubleType() if finite and spec["enum"] else T.StringType()
    if "references" in spec:
        return catalog.table(spec["references"]["tableName"]).dtype(spec["references"]["columnName"])
    return T.StringType()


def declare(spark: SparkSession, catalog: Catalog, config: dict, data: dict[str, DataFrame] | None = None) -> Catalog:
    """Add the tables of a declaration, in order, with the rows in data (none: empty)."""
    for table, spec in config.items():
        columns = spec["columns"]
        for name, column in columns.items():
            unknown = set(column) - COLUMN_KEYS
            if unknown:
                raise QueryError(f"Unknown keys of column {table}.{name}: {', '.join(sorted(unknown))}")
            if "lookup" in column:
                lookup = column["lookup"].get("tableName", f"{table}_{name}")
                if lookup not in catalog.tables:
                    values = column["lookup"]["values"]
                    values = values if isinstance(values, dict) else {v: None for v in values}
                    catalog.add(lookup, spark.createDataFrame(list(values.items()), "id string, label string"), ["id"])
        stored = {n: c for n, c in columns.items() if "joinDef" not in c}
        schema = T.StructType([T.StructField(n, column_type(f"{table}.{n}", c, catalog), c.get("nullable", not c.get("primaryKey"))) for n, c in stored.items()])
        df = (data or {}).get(table)
        df = spark.createDataFrame([], schema) if df is None else df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])
        checks = {}
        for name, column in stored.items():
            found = dict(column.get("checks", {}))
            for key, of in (("enum", "enum"), ("jsonbSchema", "jsonSchema")):
                if key in column:
                    found[of] = column[key]
            if "jsonbSchema" in column:
                check_schema(column["jsonbSchema"])
            if "lookup" in column:
                found["reference"] = (column["lookup"].get("tableName", f"{table}_{name}"), "id")
            if "references" in column:
                found["reference"] = (column["references"]["tableName"], column["references"]["columnName"])
            if column.get("nullable") is False or column.get("primaryKey"):
                found["notNull"] = True
            if found:
                checks[name] = found
        key = spec.get("constraints", {}).get("primaryKey") or [n for n, c in stored.items() if c.get("primaryKey")]
        unique = [*spec.get("constraints", {}).get("unique", []), *[[n] for n, c in stored.items() if c.get("unique")]]
        catalog.add(table, df, key, unique, defaults={n: c["defaultValue"] for n, c in stored.items() if "defaultValue" in c}, label=spec.get("label"), checks=checks)
        for name, found in checks.items():
            if "reference" in found:
                catalog.relate(table, found["reference"][0], {name: found["reference"][1]})
    for table, spec in config.items():
        for name, column in spec["columns"].items():
            if "joinDef" in column:
                catalog.name_join(table, name, column["joinDef"])
    return catalog
