"""Conflict-constrained best-fit packing (operator 8).

Documents become pieces of at most CAPACITY tokens and go into bins of that size. No bin holds two
pieces of one source or of one duplicate cluster. Bins are ordered by what room they have left and
carry bitmaps of the sources and clusters within. A piece's search starts at the first bin with
enough room and goes on to its successors until one is compatible: the tightest compatible bin. The
pieces of a shard are taken longest first. Shards are dealt by a hash of doc_id, so that a large
source or cluster is spread over all of them, and their number grows with the table.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, quiet_threads, small_arrow_batches, written
from quillon.llm.simhash import near_copies
from quillon.llm.token_counts import token_counter

CAPACITY = 2048
SHARD_DOCUMENTS = 2048
SCHEMA = "doc_id long, piece int, first_token long, n_tokens int, bin_id long, slot int"


class Bins:
    """Open bins of one shard."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.by_room: list[tuple[int, int]] = []  # (room left, bin), ascending
        self.sources: list[int] = []  # bitmap of each bin
        self.clusters: list[int] = []
        self.filled: list[int] = []  # pieces in each bin

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Put a piece into the tightest compatible bin, or a new one. source, cluster: bitmaps of it alone. Returns bin, slot."""
        for i in range(bisect_left(self.by_room, (size, -1)), len(self.by_room)):
            room, which = self.by_room[i]
            if not (self.sources[which] & source or self.clusters[which] & cluster):
                del self.by_room[i]
                break
        else:
            room, which = self.capacity, len(self.filled)
            self.sources.append(0)
            self.clusters.append(0)
            self.filled.append(0)
        self.sources[which] |= source
        self.clusters[which] |= cluster
        self.filled[which] += 1
        if room > size:
            insort(self.by_room, (room - size, which))
        return which, self.filled[which] - 1


def pack(rows: list[tuple[int | None, int, str | None, int]], capacity: int = CAPACITY) -> Iterator[tuple]:
    """rows: doc_id, tokens, source, cluster. Yields doc_id, piece, first token, tokens, bin, slot, longest piece first.

    A document of more than capacity tokens fills bins of its own but for its rest. A null source
    bars nothing. Ties go to the smaller doc_id, then to the smaller cluster.
    """
    pieces = []
    for doc_id, tokens, source, cluster in rows:
        for number, first in enumerate(range(0, tokens, capacity)):
            pieces.append((-min(capacity, tokens - first), doc_id is not None, doc_id or 0, cluster, number, first, source))
    pieces.sort(key=lambda x: x[:5])
    source_bit: dict[str, int] = {}
    cluster_bit: dict[int, int] = {}
    bins = Bins(capacity)
    for size, known, doc_id, cluster, number, first, source in pieces:
        bit = 0 if source is None else 1 << source_bit.setdefault(source, len(source_bit))
        which, slot = bins.place(-size, bit, 1 << cluster_bit.setdefault(cluster, len(cluster_bit)))
        yield doc_id if known else None, number, first, -size, which, slot


def token_count(text: Column) -> Column:
    """Words between ASCII white space, and one for the document's end."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1


def packed(docs: DataFrame, capacity: int = CAPACITY, tokens: Column | None = None, source: Column | None = None, cluster: Column | None = None) -> DataFrame:
    """Pack every document: doc_id, piece, first_token, n_tokens, bin_id, slot; a row for each piece.

    tokens: a document's length, its words and one by default, so that null and empty texts still
    get a place. source: the column of that name. cluster: by default a hash of the whole text, so
    that exact copies never share a bin. Repeated rows are copies of each other; a null doc_id is
    packed like any other; extra columns are ignored.
    """
    tokens = token_count(docs["text"]) if tokens is None else tokens
    source = docs["source"] if source is None else source
    cluster = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) if cluster is None else cluster
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.greatest(tokens.cast("long"), F.lit(1)).alias("tokens"), source.cast("string").alias("source"), cluster.cast("long").alias("cluster"))
    count = max(1, -(-docs.select("doc_id").count() // SHARD_DOCUMENTS))
    # By place in the input as well, so that however many rows are equal they are dealt over all shards.
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "place"), F.lit(count)).cast("long")).drop("place")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        quiet_threads()
        base = key[0].as_py() << 32
        columns = [group[x].to_pylist() for x in ("doc_id", "tokens", "source", "cluster")]
        found = [(d, p, f, n, base + b, s) for d, p, f, n, b, s in pack(list(zip(*columns)), capacity)]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
        return pa.table([pa.array(x, t) for x, t in zip(zip(*found), kinds)], ["doc_id", "piece", "first_token", "n_tokens", "bin_id", "slot"])

    return rows.groupBy("shard").applyInArrow(run, SCHEMA)


def token_lengths(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, source, cluster (a hash of the text), tokens of every row: ids of the whole text and one for its end."""
    small_arrow_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quiet_threads()
        counter = token_counter(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes = counter.counts(part.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sizes + 1)], ["doc_id", "source", "cluster", "tokens"])

    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), F.xxhash64(text).alias("cluster"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, cluster long, tokens long")


def packed_by_ids(docs: DataFrame, tokenizer_path: str, clusters: bool = True, capacity: int = CAPACITY) -> DataFrame:
    """packed(), where a document's length is its token ids' number and one, so that a bin is a training sequence.

    clusters: groups of near copies share no bin; without, only exact copies, for documents of which
    one of each group is left. Rows without doc_id have the cluster of their text.
    """
    if not clusters:
        rows = written(token_lengths(docs, tokenizer_path), "lengths")
    else:
        with Scratch(docs.sparkSession) as scratch:
            rows = scratch.written(token_lengths(docs, tokenizer_path), "lengths")
            groups = near_copies(docs).groupBy(F.col("doc_id").alias("member")).agg(F.min("component_id").alias("component"))
            rows = rows.join(groups.hint("merge"), F.col("doc_id") == F.col("member"), "left").select("doc_id", "source", F.coalesce("component", "cluster").alias("cluster"), "tokens")
            rows = written(rows, "clustered")
    return packed(rows, capacity, rows["tokens"], rows["source"], rows["cluster"])
