"""Validation of JSON documents against a declarative schema, and table declarations that use it."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.errors import QueryError

SCALARS = {
    "string": lambda v: isinstance(v, str),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "boolean": lambda v: isinstance(v, bool),
    "Date": lambda v: isinstance(v, str),
    "time": lambda v: isinstance(v, str),
    "timestamp": lambda v: isinstance(v, str),
    "any": lambda v: True,
    "Lookup": lambda v: isinstance(v, (str, int, float, dict)),
}
KEYS = {"type", "enum", "oneOf", "oneOfType", "arrayOf", "arrayOfType", "tuple", "record", "lookup", "optional", "nullable", "allowedValues", "title", "description", "defaultValue"}


def check_schema(schema: object, path: str = "$") -> dict:
    """The schema with shorthand expanded: "string" is {"type": "string"}, "string[]" an array of it."""
    if isinstance(schema, str):
        schema = {"type": schema}
    if not isinstance(schema, dict):
        raise QueryError(f"Invalid schema at {path}")
    if set(schema) - KEYS:
        raise QueryError(f"Unknown schema keys at {path}: {', '.join(sorted(set(schema) - KEYS))}")
    kind = schema.get("type")
    if isinstance(kind, str) and kind.removesuffix("[]") not in SCALARS:
        raise QueryError(f"Unknown type {kind!r} at {path}")
    if not set(schema) & {"type", "enum", "oneOf", "oneOfType", "arrayOf", "arrayOfType", "tuple", "record", "lookup"}:
        raise QueryError(f"Schema without a type at {path}")
    return schema


def problem(schema: object, value: object, path: str = "$") -> str | None:
    """What is wrong with a value, or None."""
    schema = check_schema(schema, path)
    if value is None:
        return None if schema.get("nullable") else f"{path}: null is not allowed"
    if "enum" in schema and value not in schema["enum"]:
        return f"{path}: not one of {schema['enum']}"
    if "allowedValues" in schema:
        for x in value if isinstance(value, list) else [value]:
            if x not in schema["allowedValues"]:
                return f"{path}: not one of {schema['allowedValues']}"
    if "lookup" in schema:
        return None if SCALARS["Lookup"](value) else f"{path}: expecting a lookup value"
    kind = schema.get("type")
    if isinstance(kind, str):
        if kind.endswith("[]"):
            return items({"type": kind[:-2]}, value, path)
        return None if SCALARS[kind](value) else f"{path}: expecting {kind}"
    if isinstance(kind, dict):
        return members(kind, value, path)
    for key in ("oneOf", "oneOfType"):
        if key in schema:
            choices = [{"type": x} if key == "oneOfType" else x for x in schema[key]]
            return None if any(problem(x, value, path) is None for x in choices) else f"{path}: matches none of {key}"
    for key in ("arrayOf", "arrayOfType"):
        if key in schema:
            return items({"type": schema[key]} if key == "arrayOfType" else schema[key], value, path)
    if "tuple" in schema:
        if not isinstance(value, list) or len(value) != len(schema["tuple"]):
            return f"{path}: expecting an array of {len(schema['tuple'])}"
        return next((p for i, (s, v) in enumerate(zip(schema["tuple"], value)) if (p := problem(s, v, f"{path}[{i}]"))), None)
    if "record" in schema:
        if not isinstance(value, dict):
            return f"{path}: expecting an object"
        allowed, inner = schema["record"].get("keysEnum"), schema["record"].get("values", "any")
        for key, x in value.items():
            if allowed is not None and key not in allowed:
                return f"{path}.{key}: not an allowed key"
            if found := problem(inner, x, f"{path}.{key}"):
                return found
    return None


def items(schema: object, value: object, path: str) -> str | None:
    if not isinstance(value, list):
        return f"{path}: expecting an array"
    return next((p for i, v in enumerate(value) if (p := problem(schema, v, f"{path}[{i}]"))), None)


def members(fields: dict, value: object, path: str) -> str | None:
    if not isinstance(value, dict):
        return f"{path}: expecting an object"
    extra = set(value) - set(fields)
    if extra:
        return f"{path}: unknown keys {', '.join(sorted(extra))}"
    for key, schema in fields.items():
        if key not in value:
            if not check_schema(schema, f"{path}.{key}").get("optional"):
                return f"{path}.{key}: missing"
        elif found := problem(schema, value[key], f"{path}.{key}"):
            return found
    return None


def validation_error(column: Column, schema: object) -> Column:
    """The first problem of each JSON text, null where it is valid. Null text is a null value."""
    check_schema(schema)

    def one(text: str | None) -> str | None:
        try:
            return problem(schema, None if text is None else json.loads(text))
        except ValueError:
            return "$: not valid JSON"

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action=None)

    return run(column)


def is_valid(column: Column, schema: object) -> Column:
    return validation_error(column, schema).isNull()
