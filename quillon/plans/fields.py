"""The field-list grammar: "a, b", ["a"], {"a": 1}, {"a": 0}, "*", ""."""

from __future__ import annotations

from quillon.errors import QueryError


def is_on(value: object) -> bool:
    return value in (1, True, "*")


def parse_fields(wanted: object, allowed: list[str], allow_empty: bool = True) -> list[str]:
    if wanted is None or wanted == "*" or wanted is True:
        return list(allowed)
    if isinstance(wanted, str):
        wanted = [x.strip() for x in wanted.split(",")]
    if isinstance(wanted, (list, tuple)):
        names = list(wanted)
        if names in ([""], []):
            if not allow_empty:
                raise QueryError("Empty field list")
            return []
        if "*" in names:
            return list(allowed)
    elif isinstance(wanted, dict):
        off = [k for k, v in wanted.items() if v in (0, False)]
        on = [k for k, v in wanted.items() if is_on(v)]
        if len(off) + len(on) != len(wanted):
            raise QueryError(f"Invalid field filter values: {wanted}")
        if off and on:
            raise QueryError(f"Cannot mix include and exclude: {wanted}")
        check(off, allowed)
        if off:
            return [x for x in allowed if x not in off]
        names = list(allowed) if "*" in on else on
    else:
        raise QueryError(f"Invalid field filter: {wanted!r}")
    check(names, allowed)
    return names


def check(names: list[str], allowed: list[str]) -> None:
    bad = [x for x in names if x not in allowed]
    if bad:
        raise QueryError(f"Invalid or disallowed fields: {', '.join(map(str, bad))}. Allowed: {', '.join(allowed)}")
