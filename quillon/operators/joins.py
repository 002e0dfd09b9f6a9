"""Join chains, existence tests and nested sides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.catalog import Catalog, Hop


def either(left: DataFrame, right: DataFrame, tests: list[Column]) -> DataFrame:
    """left joined with right where any test holds, as a union of equi-joins that exclude each other.

    A single join on an OR would be a nested loop; the union stays a union of hash or merge joins, and
    the exclusions keep each pair once, so that nothing must be deduplicated.
    """
    parts = []
    for i, test in enumerate(tests):
        for earlier in tests[:i]:
            test = test & ~F.coalesce(earlier, F.lit(False))
        parts.append(left.join(right, test))
    return reduce(DataFrame.unionAll, parts)


def chain(catalog: Catalog, hops: list[Hop], last: DataFrame) -> tuple[DataFrame, list[str]]:
    """Inner joins of the tables of hops, of which the last is given. Returns the first table's columns
    as first__c and the last's as last__c; with one hop last__c alone."""
    if len(hops) == 1:
        return last.select(*[F.col(f"`{c}`").alias(f"last__{c}") for c in last.columns]), last.columns
    names = [f"h{i}" for i in range(len(hops))]
    first = catalog.table(hops[0].table).df
    current, columns = first.select(*[F.col(f"`{c}`").alias(f"first__{c}") for c in first.columns], *[F.col(f"`{c}`").alias(f"at__{c}") for c in first.columns]), first.columns
    for i, hop in enumerate(hops[1:], 1):
        right = last if i == len(hops) - 1 else catalog.table(hop.table).df
        prefix = "last" if i == len(hops) - 1 else "at"
        renamed = right.select(*[F.col(f"`{c}`").alias(f"{names[i]}__{c}") for c in right.columns])
        tests = [reduce(Column.__and__, [F.col(f"at__{a}") == F.col(f"{names[i]}__{b}") for a, b in c]) for c in hop.on]
        joined = either(current, renamed, tests)
        current = joined.select(*[F.col(f"`first__{c}`") for c in first.columns], *[F.col(f"`{names[i]}__{c}`").alias(f"{prefix}__{c}") for c in right.columns])
    return current, first.columns


def keyed(catalog: Catalog, parent: DataFrame, hops: list[Hop], last: DataFrame) -> tuple[DataFrame, list[str]]:
    """The nested side with key columns key__c, named for the parent's columns c that they equal.

    With one constraint the keys are the child's own columns. With several, each distinct tuple of the
    parent's join columns is a key, so that parents never multiply and need no row id.
    """
    side, first = chain(catalog, hops, last)
    prefix = "last" if len(hops) == 1 else "first"
    constraints = hops[0].on
    if len(constraints) == 1:
        keys = dict(constraints[0])
        return side.select("*", *[F.col(f"`{prefix}__{b}`").alias(f"key__{a}") for a, b in keys.items()]), list(keys)
    names = list(dict.fromkeys(a for c in constraints for a, _ in c))
    tuples = parent.select(*[F.col(f"`{a}`").alias(f"key__{a}") for a in names]).distinct()
    tests = [reduce(Column.__and__, [F.col(f"key__{a}") == F.col(f"`{prefix}__{b}`") for a, b in c]) for c in constraints]
    return either(tuples, side, tests), names


def exists_joined(catalog: Catalog, root: str, hops: list[Hop], last: DataFrame) -> Column:
    """EXISTS along a path, correlated with the root's alias. Catalyst makes it a semi or anti join."""
    side, _ = chain(catalog, hops, last)
    prefix = "last" if len(hops) == 1 else "first"
    tests = [reduce(Column.__and__, [F.col(f"{root}.`{a}`").outer() == F.col(f"`{prefix}__{b}`") for a, b in c]) for c in hops[0].on]
    found = [side.where(test).exists() for test in tests]
    return reduce(Column.__or__, found)


def top_rows(side: DataFrame, keys: list[Column], order: list[Column], limit: int | None, offset: int) -> DataFrame:
    """Rows limit after offset of each key, with their place as rn."""
    numbered = side.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    if limit is not None:
        numbered = numbered.where(F.col("rn") <= limit + offset)
    return numbered.where(F.col("rn") > offset) if offset else numbered
