"""Hash functions and hash aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.errors import QueryError
from quillon.functions.registry import Scope, need, register

DIGESTS = {"md5": F.md5, "sha256": lambda c: F.sha2(c, 256), "sha512": lambda c: F.sha2(c, 512)}


def joined(scope: Scope, args: list, name: str) -> Column:
    need(args, 1, name)
    return F.concat(*[F.coalesce(scope.text(a), F.lit("")) for a in args])


@register("$md5")
def md5(scope: Scope, args: list) -> Column:
    need(args, 1, "$md5")
    return F.md5(scope.text(args[0]))


for _name, _digest in DIGESTS.items():

    def _multi(scope: Scope, args: list, digest=_digest, name=_name) -> Column:
        return digest(joined(scope, args, f"${name}_multi"))

    def _multi_agg(scope: Scope, args: list, digest=_digest, name=_name) -> Column:
        """Of the group's texts in ascending order, joined by commas: the order is fixed, so that results repeat."""
        return digest(F.array_join(F.array_sort(F.collect_list(joined(scope, args, f"${name}_multi_agg"))), ","))

    register(f"${_name}_multi", single=False)(_multi)
    register(f"${_name}_multi_agg", kind="aggregation", single=False)(_multi_agg)


@register("$rowhash", kind="computed", filterable=True)
def rowhash(scope: Scope, args: list) -> Column:
    return F.md5(F.concat(*[F.md5(F.coalesce(scope.text(n), F.lit("dd"))) for n in sorted(scope.names)]))


@register("$crypt", single=False)
def crypt(scope: Scope, args: list) -> Column:
    raise QueryError("$crypt needs a password-hash library, which Spark does not have; use $sha512_multi")
