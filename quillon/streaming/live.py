"""Live queries: a change feed is an explicit input, and a matching change re-runs the whole query."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.engine import Engine
from quillon.errors import QueryError
from quillon.functions.registry import Scope
from quillon.operators.filters import FilterScope, compile_filter
from quillon.plans.query import ROOT, Query

ACTIONS = ("insert", "update", "delete")


@dataclass
class Subscription:
    table: str
    filter: dict
    params: dict
    deliver: Callable[[DataFrame], None]
    actions: frozenset[str] = frozenset(ACTIONS)
    columns: frozenset[str] | None = None  # tracked; None: any change counts
    skip_first: bool = False
    throttle: float = 0.0
    related: dict[str, dict] = field(default_factory=dict)
    failed: Callable[[Exception], None] | None = None
    error: Exception | None = None  # the last that a delivery raised
    last: float = float("-inf")  # when it was told last, by time.monotonic()
    waiting: bool = False  # changes came within the throttle since


def changed_rows(feed: DataFrame, condition: Column | None, columns: Iterable[str]) -> DataFrame:
    """Rows of a feed (op, before, after) whose row before or after the change meets the condition."""
    sides = [feed.where(F.col(side).isNotNull()).select("op", F.lit(side).alias("side"), f"{side}.*") for side in ("before", "after")]
    both = reduce(DataFrame.unionByName, sides)
    return both if condition is None else both.where(condition)


def changed_columns(before: DataFrame, after: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """key, op and the names of the columns whose values differ, for each row of either state that differs."""
    old = before.select(*[F.col(f"`{k}`") for k in key], F.struct(*[F.col(f"`{c}`") for c in columns]).alias("old__"))
    new = after.select(*[F.col(f"`{k}`") for k in key], F.struct(*[F.col(f"`{c}`") for c in columns]).alias("new__"))
    joined = old.join(new, key, "full")
    op = F.when(F.col("old__").isNull(), "insert").when(F.col("new__").isNull(), "delete").otherwise("update")
    tests = [F.when(~F.col("old__")[c].eqNullSafe(F.col("new__")[c]), F.lit(c)) for c in columns]
    return joined.select(*key, op.alias("op"), F.array_compact(F.array(*tests)).alias("changed")).where(F.size("changed") > 0)


def tested_columns(query: Query) -> set[str]:
    """Columns of the table that a query's condition reads, the rule's own and those within groups and paths included."""
    if query.where is None:
        return set()
    plan = query.source.alias(ROOT).where(query.where)._jdf.queryExecution().analyzed()
    names = plan.references().toSeq().mkString("\x01")
    found = {name.rsplit("#", 1)[0] for name in names.split("\x01") if name}
    return found & set(query.source.columns)


class LiveQueries:
    """Subscriptions of one engine. push() takes a batch of changes; attach() feeds it from a stream."""

    def __init__(self, engine: Engine) -> None:
        self.engine, self.subscriptions = engine, []

    def subscribe(self, table: str, wanted: dict | None, params: dict | None, deliver: Callable[[DataFrame], None], actions: dict | None = None, skip_first: bool = False, throttle: float = 0.0, skip_changed_columns_check: bool = False, failed: Callable[[Exception], None] | None = None) -> Subscription:
        """Validates at once. actions: all true or all false; deliver gets the full result, never a delta.

        An error of the query or of deliver goes to failed and keeps no other subscription from being told.
        """
        if throttle < 0:
            raise QueryError("throttle must not be negative")
        wanted, params = wanted or {}, params or {}
        query = self.engine.plan(table, wanted, params)
        chosen = set(ACTIONS)
        if actions:
            if set(actions) - set(ACTIONS) or len(set(actions.values())) != 1:
                raise QueryError("actions must name insert, update or delete, all true or all false")
            chosen = set(actions) if all(actions.values()) else chosen - set(actions)
        related = {hop.table: {} for item in query.joins for hop in item.join.hops}
        for key, value in wanted.items():
            if key in ("$existsJoined", "$notExistsJoined"):
                paths = [value["path"]] if isinstance(value.get("path"), (list, tuple)) else list(value)
                related |= {hop.table: {} for path in paths for hop in self.engine.catalog.path(table, path)}
        tracked = None
        if not skip_changed_columns_check and all(x.kind == "column" for x in query.items):
            tracked = frozenset(x.alias for x in query.items) | tested_columns(query) | {k.key for k in query.order}
        found = Subscription(table, wanted, params, deliver, frozenset(chosen), tracked, skip_first, throttle, related, failed)
        self.subscriptions.append(found)
        if not skip_first:
            deliver(self.engine.find(table, wanted, params))
        return found

    def subscribe_one(self, table: str, wanted: dict | None, params: dict | None, deliver: Callable, **options) -> Subscription:
        return self.subscribe(table, wanted, {**(params or {}), "limit": 1}, deliver, **options)

    def unsubscribe(self, subscription: Subscription) -> None:
        self.subscriptions.remove(subscription)

    def condition(self, table: str, wanted: dict) -> Column | None:
        """What a changed row alone can decide of a filter; with joins, or names of the select, everything may match."""
        info = self.engine.catalog.table(table)
        try:
            return compile_filter(FilterScope(Scope({c: info.dtype(c) for c in info.columns})), wanted)
        except QueryError:
            return None

    def concerned(self, subscription: Subscription, table: str, feed: DataFrame) -> bool:
        if table != subscription.table:
            return table in subscription.related
        feed = feed.where(F.col("op").isin(*subscription.actions))
        if subscription.columns is not None:
            known = [c for c in self.engine.catalog.table(table).columns if c in subscription.columns]
            differs = [~F.col(f"before.`{c}`").eqNullSafe(F.col(f"after.`{c}`")) for c in known]
            if differs:
                feed = feed.where((F.col("op") != "update") | reduce(Column.__or__, differs))
        return not changed_rows(feed, self.condition(table, subscription.filter), ()).isEmpty()

    def push(self, table: str, feed: DataFrame) -> int:
        """Deliver to every subscription that a batch of changes (op, before, after) concerns. Returns how many.

        A batch re-runs a query once, however many of its rows match. A subscription that was told less than
        its throttle ago waits for a later push() or flush()."""
        for subscription in self.subscriptions:
            if not subscription.waiting:
                subscription.waiting = self.concerned(subscription, table, feed)
        return self.flush()

    def flush(self) -> int:
        """Tell the subscriptions that wait and whose throttle is over. Returns how many."""
        due = [s for s in self.subscriptions if s.waiting and time.monotonic() - s.last >= s.throttle]
        for subscription in due:
            subscription.waiting, subscription.last, subscription.error = False, time.monotonic(), None
            try:
                subscription.deliver(self.engine.find(subscription.table, subscription.filter, subscription.params))
            except Exception as error:  # noqa: BLE001 one subscriber's error is not the others'
                subscription.error = error
                if subscription.failed:
                    subscription.failed(error)
        return len(due)

    def attach(self, table: str, stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame], None] | None = None, once: bool = True) -> StreamingQuery:
        """Feed push() from a stream of (op, before, after). apply changes the table first, in the same batch."""

        def batch(rows: DataFrame, number: int) -> None:
            if rows.isEmpty():
                return
            if apply:
                apply(rows)
            self.push(table, rows)

        throttle = max((s.throttle for s in self.subscriptions), default=0)
        writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{max(throttle, 0.1)} seconds")
        return writer.start()


def apply_changes(df: DataFrame, feed: DataFrame, key: list[str]) -> DataFrame:
    """The table after the feed's changes; of several for one key the one with the largest seq counts."""
    ident = F.struct(*[F.coalesce(F.col(f"after.`{k}`"), F.col(f"before.`{k}`")).alias(k) for k in key])
    last = feed.groupBy(ident.alias("id__")).agg(F.max_by(F.struct("op", "after"), "seq").alias("last"))
    kept = df.join(last.select("id__.*"), key, "left_anti")
    return kept.select(*df.columns).unionByName(last.where("last.op <> 'delete'").select("last.after.*").select(*df.columns))
