"""Aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.registry import Scope, need, register

for _name, _make in {"$count": F.count, "$min": F.min, "$max": F.max, "$sum": F.sum, "$avg": F.avg}.items():

    def _build(scope: Scope, args: list, make=_make, name=_name) -> Column:
        need(args, 1, name)
        return make(scope.col(args[0]))

    register(_name, kind="aggregation")(_build)


@register("$countAll", kind="aggregation")
def count_all(scope: Scope, args: list) -> Column:
    return F.count(F.lit(1))


def gathered(scope: Scope, name: str) -> Column:
    """All values of a group, nulls kept, in ascending order (nulls last) so that results repeat."""
    rows = F.collect_list(F.struct(scope.col(name).isNull().alias("n"), scope.col(name).alias("v")))
    return F.transform(F.array_sort(rows), lambda x: x["v"])


@register("$array_agg", kind="aggregation")
def array_agg(scope: Scope, args: list) -> Column:
    need(args, 1, "$array_agg")
    return gathered(scope, args[0])


for _name in ("$json_agg", "$jsonb_agg"):

    def _json(scope: Scope, args: list, name=_name) -> Column:
        need(args, 1, name)
        return F.to_json(gathered(scope, args[0]), {"ignoreNullFields": "false"})

    register(_name, kind="aggregation")(_json)


@register("$string_agg", kind="aggregation", single=False)
def string_agg(scope: Scope, args: list) -> Column:
    need(args, 2, "$string_agg")
    return F.array_join(F.array_sort(F.collect_list(scope.text(args[0]))), str(args[1]))


@register("$diff_perc", kind="aggregation")
def diff_perc(scope: Scope, args: list) -> Column:
    need(args, 1, "$diff_perc")
    low, high = F.min(scope.col(args[0])).cast("double"), F.max(scope.col(args[0])).cast("double")
    return F.round((high - low) / F.nullif(low, F.lit(0.0)) * 100, 2)


def is_point(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StructType) and {"lng", "lat"} <= set(dtype.names)
