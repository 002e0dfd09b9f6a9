"""Functions that callers may run by name, with checked input and a group of callers each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from quillon.errors import QueryError
from quillon.functions.json_schema import check_schema, members


@dataclass(frozen=True)
class ServerFunction:
    name: str
    run: Callable
    input: dict
    allowed: Callable[[object], bool]


class ServerFunctions:
    def __init__(self) -> None:
        self._known: dict[str, ServerFunction] = {}

    def define(self, name: str, run: Callable, input: dict | None = None, allowed: Callable[[object], bool] = lambda user: True) -> None:
        """run(args, context) may be called by users that allowed() accepts, with args of the input schema."""
        for key, schema in (input or {}).items():
            check_schema(schema, key)
        self._known[name] = ServerFunction(name, run, input or {}, allowed)

    def available(self, user: object) -> dict[str, dict]:
        return {n: f.input for n, f in self._known.items() if f.allowed(user)}

    def call(self, name: str, args: dict | None, user: object = None, context: object = None) -> object:
        function = self._known.get(name)
        if function is None or not function.allowed(user):
            raise QueryError(f"Function {name} does not exist or is not allowed")
        wrong = members(function.input, args or {}, name)
        if wrong:
            raise QueryError(f"Invalid arguments: {wrong}")
        return function.run(args or {}, context)
