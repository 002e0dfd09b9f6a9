"""JSON functions over JSON text. Expressions run in the JVM but where a document must be rebuilt."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import QueryError
from quillon.functions.registry import Scope, need, register


def canonical(text: Column) -> Column:
    """One text for equal documents: keys sorted, blanks gone."""
    return F.to_json(F.parse_json(text))


@register("$jsonb_array_length")
def array_length(scope: Scope, args: list) -> Column:
    need(args, 1, "$jsonb_array_length")
    return F.json_array_length(scope.text(args[0]))


def rebuilt(column: Column, change) -> Column:
    """Parse, change and dump each document, in Arrow batches."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(change(json.loads(t)), separators=(",", ":"), ensure_ascii=False))

    return run(column)


def put(document, path: list, value, create: bool):
    """A copy of document with value at path; missing parents leave it unchanged."""
    if not path:
        return value
    key, *rest = path
    if isinstance(document, dict):
        if key in document or (create and not rest):
            return {**document, key: put(document.get(key), rest, value, create)}
    elif isinstance(document, list):
        try:
            at = int(key)
        except ValueError as error:
            raise QueryError(f"Path element {key!r} is not an array index") from error
        place = at + len(document) if at < 0 else at
        if 0 <= place < len(document):
            return [put(x, rest, value, create) if i == place else x for i, x in enumerate(document)]
        if create and not rest:
            return [value, *document] if place < 0 else [*document, value]
    return document


@register("$jsonb_set", single=False)
def jsonb_set(scope: Scope, args: list) -> Column:
    need(args, 3, "$jsonb_set")
    path, value, create = [str(x) for x in args[1]], args[2], args[3] if len(args) > 3 else True
    return rebuilt(scope.text(args[0]), lambda d: put(d, path, value, create))


def stripped(value):
    if isinstance(value, dict):
        return {k: stripped(v) for k, v in value.items() if v is not None}
    return [stripped(x) for x in value] if isinstance(value, list) else value


@register("$jsonb_strip_nulls")
def strip_nulls(scope: Scope, args: list) -> Column:
    need(args, 1, "$jsonb_strip_nulls")
    return rebuilt(scope.text(args[0]), stripped)


@register("$jsonb_pretty")
def pretty(scope: Scope, args: list) -> Column:
    need(args, 1, "$jsonb_pretty")

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(json.loads(t), indent=4, ensure_ascii=False))

    return run(scope.text(args[0]))


PLAIN_PATH = re.compile(r"""\$((\.[A-Za-z_][\w]*)|(\."[^"]*")|(\[\d+\])|(\[\*\])|(\.\*))*""")


@register("$jsonb_path_query", kind="rows", single=False)
def path_query(scope: Scope, args: list) -> Column:
    """A row for each match, as JSON text. Paths of keys, indexes and wildcards; filters are not supported."""
    need(args, 2, "$jsonb_path_query")
    if not PLAIN_PATH.fullmatch(args[1]):
        raise QueryError(f"Unsupported JSON path {args[1]!r}")
    steps = re.findall(r"""\.([A-Za-z_]\w*)|\."([^"]*)"|\[(\d+)\]|(\[\*\]|\.\*)""", args[1])

    def walk(value, at: int):
        if at == len(steps):
            yield value
            return
        name, quoted, index, wild = steps[at]
        if wild:
            for x in value.values() if isinstance(value, dict) and wild == ".*" else value if isinstance(value, list) and wild == "[*]" else ():
                yield from walk(x, at + 1)
        elif index:
            if isinstance(value, list) and int(index) < len(value):
                yield from walk(value[int(index)], at + 1)
        elif isinstance(value, dict) and (key := name or quoted) in value:
            yield from walk(value[key], at + 1)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else [json.dumps(x, separators=(",", ":"), ensure_ascii=False) for x in walk(json.loads(t), 0)])

    return F.explode(run(scope.text(args[0])))


def pairs(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


for _name in ("$jsonb_each", "$jsonb_each_text"):

    def _each(scope: Scope, args: list, name=_name) -> Column:
        need(args, 1, name)
        made = F.from_json(scope.text(args[0]), "map<string,string>" if name.endswith("text") else "map<string,variant>")
        value = (lambda v: v) if name.endswith("text") else (lambda v: F.to_json(v))
        return F.explode(F.transform(F.map_entries(made), lambda e: F.struct(e["key"].alias("key"), value(e["value"]).alias("value"))))

    register(_name, kind="rows")(_each)


@register("$jsonb_object_keys", kind="rows")
def object_keys(scope: Scope, args: list) -> Column:
    need(args, 1, "$jsonb_object_keys")
    return F.explode(F.json_object_keys(scope.text(args[0])))


for _name in ("$jsonb_array_elements", "$jsonb_array_elements_text"):

    def _elements(scope: Scope, args: list, name=_name) -> Column:
        need(args, 1, name)
        if name.endswith("text"):
            return F.explode(F.from_json(scope.text(args[0]), "array<string>"))
        return F.explode(F.transform(F.from_json(scope.text(args[0]), "array<variant>"), F.to_json))

    register(_name, kind="rows")(_elements)


@register("$jsonb_typeof")
def typeof(scope: Scope, args: list) -> Column:
    need(args, 1, "$jsonb_typeof")
    first = F.substring(F.ltrim(scope.text(args[0])), 1, 1)
    kind = F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string")
    return F.when(scope.col(args[0]).isNotNull(), kind.when(first.isin("t", "f"), "boolean").when(first == "n", "null").otherwise("number"))


@register("$jsonb_to_record", single=False)
def to_record(scope: Scope, args: list) -> Column:
    """The second argument is the record's schema in DDL, which SQL would put after AS."""
    need(args, 2, "$jsonb_to_record")
    return F.from_json(scope.text(args[0]), T.StructType.fromDDL(args[1]))


@register("$jsonb_build_object", single=False)
def build_object(scope: Scope, args: list) -> Column:
    need(args, 1, "$jsonb_build_object")
    return F.to_json(F.struct(*[scope.col(a).alias(a) for a in args]), {"ignoreNullFields": "false"})


def contains(outer, inner) -> bool:
    """Whether a document contains another: objects by key, arrays as sets, an array contains a bare scalar."""
    if isinstance(inner, dict):
        return isinstance(outer, dict) and all(k in outer and contains(outer[k], v) for k, v in inner.items())
    if isinstance(inner, list):
        return isinstance(outer, list) and all(any(same(o, x) if not isinstance(x, (dict, list)) else contains(o, x) for o in outer) for x in inner)
    return same(outer, inner)


def same(a, b) -> bool:
    return type(a) is type(b) and a == b or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool) and a == b)


def contains_column(column: Column, value, reverse: bool = False) -> Column:
    """column @> value, or with reverse column <@ value."""

    def test(outer, inner) -> bool:
        return contains(outer, inner) or (isinstance(outer, list) and not isinstance(inner, (dict, list)) and any(same(x, inner) for x in outer))

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else test(value, json.loads(t)) if reverse else test(json.loads(t), value))

    return run(column)
