"""Two-way synchronisation: the last writer, by a numeric field, wins. Deletes are not synchronised."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


@dataclass(frozen=True)
class SyncChannel:
    id_fields: tuple[str, ...]
    synced_field: str
    batch_size: int = 50
    throttle_ms: int = 100

    @property
    def order(self) -> list[Column]:
        return [F.col(self.synced_field).asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in sorted(self.id_fields)]]


def latest(rows: DataFrame, channel: SyncChannel) -> DataFrame:
    """One row for each id, the one synced last; combined before the shuffle. Ties go to the greater row."""
    whole = F.struct(channel.synced_field, *[c for c in rows.columns if c != channel.synced_field])
    return rows.groupBy(*channel.id_fields).agg(F.max(whole).alias("last")).select(*[F.col(f"last.`{c}`") for c in rows.columns])


def merge(server: DataFrame, incoming: DataFrame, channel: SyncChannel) -> DataFrame:
    """The server's rows after the incoming ones: inserted, or taken where the server's are older."""
    new = latest(incoming, channel).select(*[F.col(f"`{c}`").alias(f"in__{c}") for c in server.columns])
    match = reduce(Column.__and__, [F.col(f"`{c}`") == F.col(f"`in__{c}`") for c in channel.id_fields])
    joined = server.join(new, match, "full")
    own, other = F.col(f"`{channel.synced_field}`"), F.col(f"`in__{channel.synced_field}`")
    take = F.col(f"in__{channel.id_fields[0]}").isNotNull() & (F.col(channel.id_fields[0]).isNull() | F.coalesce(own < other, own.isNull()))
    return joined.select(*[F.when(take, F.col(f"`in__{c}`")).otherwise(F.col(f"`{c}`")).alias(c) for c in server.columns])


def newer_than(server: DataFrame, client: DataFrame, channel: SyncChannel) -> DataFrame:
    """The server's rows that the client lacks or has an older state of, in the channel's order."""
    ids = [F.col(f"`{c}`").alias(f"id__{c}") for c in channel.id_fields]
    theirs = latest(client, channel).select(*ids, F.col(f"`{channel.synced_field}`").alias("seen__"))
    match = reduce(Column.__and__, [F.col(f"`{c}`") == F.col(f"id__{c}") for c in channel.id_fields])
    found = server.join(theirs, match, "left").where(F.col("seen__").isNull() | (F.col(f"`{channel.synced_field}`") > F.col("seen__")))
    return found.select(*server.columns).orderBy(*channel.order)


def divergence(server: DataFrame, client: DataFrame, channel: SyncChannel) -> DataFrame:
    """One row, from_synced: the least synced value at which the sides differ; null where they agree."""
    key, at = list(channel.id_fields), channel.synced_field
    a = server.select(*key, F.col(at).alias("a"))
    b = client.select(*key, F.col(at).alias("b"))
    return a.join(b, key, "full").where(~F.col("a").eqNullSafe(F.col("b"))).agg(F.min(F.least("a", "b")).alias("from_synced"))


def sync_stream(stream: DataFrame, channel: SyncChannel, read: callable, write: callable, checkpoint: str) -> StreamingQuery:
    """Merge micro-batches into a table: read() gives its state, write(df) takes the next."""

    def batch(rows: DataFrame, number: int) -> None:
        write(merge(read(), rows, channel))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
