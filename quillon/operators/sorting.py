"""orderBy grammar and null order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.errors import QueryError

UP = (True, 1, "asc")
DOWN = (False, -1, 0, "desc")


@dataclass(frozen=True)
class SortKey:
    key: str
    asc: bool = True
    nulls: str | None = None  # first, last; default: last when ascending, first when descending
    null_empty: bool = False

    def order(self, column: Column) -> Column:
        if self.null_empty:
            column = F.nullif(F.trim(column.cast("string")), F.lit(""))
        first = self.nulls == "first" if self.nulls else not self.asc
        if self.asc:
            return column.asc_nulls_first() if first else column.asc_nulls_last()
        return column.desc_nulls_first() if first else column.desc_nulls_last()


def direction(value: object) -> bool:
    if isinstance(value, bool) or value in (1, -1, 0):
        return value is True or value == 1
    if isinstance(value, str) and value.lower() in ("asc", "desc"):
        return value.lower() == "asc"
    raise QueryError(f"Invalid orderBy direction {value!r}")


def parse_order(wanted: object) -> list[SortKey]:
    if wanted is None:
        return []
    if isinstance(wanted, str):
        return [SortKey(wanted)]
    if isinstance(wanted, (list, tuple)):
        return [key for x in wanted for key in parse_order(x)]
    if not isinstance(wanted, dict):
        raise QueryError(f"Invalid orderBy: {wanted!r}")
    if "key" in wanted and isinstance(wanted["key"], str) and set(wanted) <= {"key", "asc", "nulls", "nullEmpty"}:
        if wanted.get("nulls") not in (None, "first", "last"):
            raise QueryError(f"Invalid nulls: {wanted['nulls']!r}")
        return [SortKey(wanted["key"], direction(wanted.get("asc", True)), wanted.get("nulls"), bool(wanted.get("nullEmpty")))]
    return [SortKey(k, direction(v)) for k, v in wanted.items()]
