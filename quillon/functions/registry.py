"""The open registry of $functions. Each builds a Column of built-in Spark expressions."""

from __future__ import annotations

import difflib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import QueryError


@dataclass
class Scope:
    """The columns that a function may see, by name, and what they are."""

    columns: dict[str, T.DataType]
    prefix: str = ""

    def col(self, name: object) -> Column:
        if not isinstance(name, str) or name not in self.columns:
            raise QueryError(f"Invalid or disallowed column {name!r}. Allowed: {', '.join(self.columns)}")
        return F.col(f"{self.prefix}`{name}`")

    def dtype(self, name: str) -> T.DataType:
        self.col(name)
        return self.columns[name]

    def text(self, name: str) -> Column:
        return as_text(self.col(name), self.dtype(name))

    @property
    def names(self) -> list[str]:
        return list(self.columns)


def as_text(column: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column)
    return column.cast("string")


@dataclass
class Function:
    name: str
    kind: str  # function, aggregation, computed, rows
    build: Callable[[Scope, list], Column]
    filterable: bool = False
    single: bool = False  # {col: "$fn"} and returning clauses may use it


FUNCTIONS: dict[str, Function] = {}


def register(name: str, kind: str = "function", filterable: bool = False, single: bool = True):
    """Decorator: @register("$name") def build(scope, args) -> Column."""

    def add(build):
        FUNCTIONS[name] = Function(name, kind, build, filterable, single)
        return build

    return add


def find_function(name: str) -> Function:
    if name in FUNCTIONS:
        return FUNCTIONS[name]
    near = difflib.get_close_matches(name, FUNCTIONS, 3)
    raise QueryError(f"Function {name} does not exist or is not allowed." + (f" Maybe you meant: {', '.join(near)}" if near else ""))


def need(args: list, least: int, name: str) -> None:
    if not isinstance(args, (list, tuple)) or len(args) < least:
        raise QueryError(f"{name} expects at least {least} argument(s), got {args!r}")


def is_call(value: object) -> bool:
    """Whether value is {"$fn": [args]}."""
    return isinstance(value, dict) and len(value) == 1 and next(iter(value)).startswith("$")


def build_call(scope: Scope, value: dict) -> tuple[Function, Column]:
    name, args = next(iter(value.items()))
    function = find_function(name)
    if not isinstance(args, (list, tuple)):
        raise QueryError(f"Arguments of {name} must be a list")
    return function, function.build(scope, list(args))
