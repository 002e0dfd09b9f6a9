"""Rounding and sign."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.registry import Scope, need, register


@register("$round")
def round_half(scope: Scope, args: list) -> Column:
    """Doubles round half to even, decimals half away from zero."""
    need(args, 1, "$round")
    floating = isinstance(scope.dtype(args[0]), (T.DoubleType, T.FloatType))
    return F.rint(scope.col(args[0])) if floating else F.round(scope.col(args[0]))


for _name, _make in {"$ceil": F.ceil, "$floor": F.floor, "$sign": F.signum}.items():

    def _build(scope: Scope, args: list, make=_make, name=_name) -> Column:
        need(args, 1, name)
        out = make(scope.col(args[0]))
        return out.cast("double") if isinstance(scope.dtype(args[0]), (T.DoubleType, T.FloatType)) else out

    register(_name)(_build)
