"""Token ids in patched frame-of-reference blocks (operator 7).

A segment holds the ids of consecutive documents. Its bytes, all little-endian:

    magic "QTS2" | u32 ids a block | u64 documents | u64 ids
    i64 document ids | u8 1 for each document without an id | u32 ids of each document
    u32 block minima | u8 block widths | u16 exceptions of each block
    u64 block starts (one more than blocks, relative to the blocks area)
    blocks: bit planes (width * BLOCK/8 bytes) | u8 exception positions | u32 exception values

A block is BLOCK ids less their minimum, packed bit plane by bit plane at the width that PERCENTILE
of them need; the others are exceptions, whose values stand whole in the exception list. The block
starts make any block readable alone. Segments are rows of a Parquet table in the shared folder
(part, seg, first: ids before it in its part), written and committed by Spark, so that a lost
executor's segments are written anew.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm.bpe import PieceTable, ragged, small_batches
from quillon.llm.common import in_doc_order, quiet_threads, written

MAGIC = b"QTS2"
BLOCK = 256
PERCENTILE = 0.95
END_ID = 0
SEGMENT_IDS = 1 << 18
SEGMENT_SCHEMA = "part int, seg long, first long, n_ids long, payload binary"


def bit_length(x: np.ndarray) -> np.ndarray:
    out = np.zeros(x.shape, np.int64)
    for shift in (16, 8, 4, 2, 1):
        big = (x >> np.uint32(shift)) > 0
        out += np.where(big, shift, 0)
        x = np.where(big, x >> np.uint32(shift), x)
    return out + (x > 0)


def pack(ids: np.ndarray, doc_ids: np.ndarray, doc_lengths: np.ndarray, unnamed: np.ndarray | None = None) -> bytes:
    """A segment's bytes. unnamed: which documents have no id."""
    unnamed = np.zeros(len(doc_ids), np.uint8) if unnamed is None else unnamed.astype(np.uint8)
    n = len(ids)
    blocks = -(-n // BLOCK)
    grid = np.zeros(blocks * BLOCK, np.uint32)
    grid[:n] = ids
    grid[n:] = ids[-1] if n else 0
    grid = grid.reshape(blocks, BLOCK)
    minima = grid.min(1) if blocks else np.zeros(0, np.uint32)
    rest = grid - minima[:, None]
    if blocks:
        at = min(BLOCK - 1, int(PERCENTILE * BLOCK))
        widths = bit_length(np.partition(rest, at, 1)[:, at])
    else:
        widths = np.zeros(0, np.int64)
    outlier = rest >= (np.uint64(1) << widths.astype(np.uint64))[:, None]
    n_out = outlier.sum(1)
    sizes = widths * (BLOCK // 8) + n_out * 5
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.uint64)
    body = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(widths[widths > 0]).tolist():
        rows = np.flatnonzero(widths == w)
        planes = ((rest[rows][:, None, :] >> np.arange(w, dtype=np.uint32)[None, :, None]) & 1).astype(np.uint8)
        packed = np.packbits(planes, axis=2, bitorder="little").reshape(len(rows), -1)
        body[starts[rows].astype(np.int64)[:, None] + np.arange(packed.shape[1])] = packed
    block, position = np.nonzero(outlier)
    if len(block):
        lists = starts[:-1].astype(np.int64) + widths * (BLOCK // 8)
        body[ragged(lists, n_out)] = position
        values = rest[block, position].astype("<u4").view(np.uint8)
        body[ragged(lists + n_out, n_out * 4)] = values
    return b"".join(
        (MAGIC, struct.pack("<IQQ", BLOCK, len(doc_ids), n), doc_ids.astype("<i8").tobytes(), unnamed.tobytes(), doc_lengths.astype("<u4").tobytes())
        + (minima.astype("<u4").tobytes(), widths.astype(np.uint8).tobytes(), n_out.astype("<u2").tobytes(), starts.astype("<u8").tobytes(), body.tobytes())
    )


class Segment:
    """A segment's parts, as views of its bytes; its blocks are read whole or one by one."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a token segment")
        self.block, n_docs, self.n = struct.unpack_from("<IQQ", data, 4)
        self.blocks, at, read = -(-self.n // self.block), 24, []
        for count, kind in ((n_docs, "<i8"), (n_docs, "<u1"), (n_docs, "<u4"), (self.blocks, "<u4"), (self.blocks, "<u1"), (self.blocks, "<u2"), (self.blocks + 1, "<u8")):
            part = np.frombuffer(data, kind, count, at)
            at += part.nbytes
            read.append(part)
        self.doc_ids, unnamed, self.lengths, self.minima, widths, n_out, starts = read
        self.unnamed = unnamed.astype(bool)
        self.body = np.frombuffer(data, np.uint8, offset=at)
        self.widths, self.n_out, self.begin = widths.astype(np.int64), n_out.astype(np.int64), starts[:-1].astype(np.int64)

    def read(self, which: np.ndarray) -> np.ndarray:
        """The ids of these blocks, a row for each, found by their starts; no other block is touched."""
        size, body, begin, widths, n_out = self.block, self.body, self.begin[which], self.widths[which], self.n_out[which]
        rest = np.zeros((len(which), size), np.uint32)
        for w in np.unique(widths[widths > 0]).tolist():
            rows = np.flatnonzero(widths == w)
            packed = body[begin[rows][:, None] + np.arange(w * size // 8)].reshape(len(rows), w, size // 8)
            planes = np.unpackbits(packed, axis=2, bitorder="little")
            value = np.zeros((len(rows), size), np.uint32)
            for b in range(w):
                value |= planes[:, b].astype(np.uint32) << np.uint32(b)
            rest[rows] = value
        if n_out.any():
            lists = begin + widths * (size // 8)
            values = body[ragged(lists + n_out, n_out * 4)].view("<u4")
            rest[np.repeat(np.arange(len(which)), n_out), body[ragged(lists, n_out)]] = values
        return rest + self.minima[which][:, None]

    def ids(self) -> np.ndarray:
        return self.read(np.arange(self.blocks)).reshape(-1)[: self.n]

    def ids_between(self, first: int, stop: int) -> np.ndarray:
        """Ids number first to stop - 1, from the blocks that hold them."""
        if stop <= first:
            return np.zeros(0, np.uint32)
        low = first // self.block
        return self.read(np.arange(low, -(-stop // self.block))).reshape(-1)[first - low * self.block : stop - low * self.block]

    def document(self, number: int) -> np.ndarray:
        """The ids of one document of the segment, its end id included."""
        first = int(self.lengths[:number].sum(dtype=np.int64))
        return self.ids_between(first, first + int(self.lengths[number]))


class LibraryEncoder:
    """Texts to ids as the tokenizers library gives them, special tokens in the text included.

    Byte-level BPE merges within pieces only, and a piece alone is one piece again, so that the ids of
    a text are those of its pieces, joined; each distinct piece is encoded by the library. Added tokens
    are cut out first, as the library does, and what lies between them is a text of its own. Added
    tokens with options of their own, or several of them, leave texts that hold one to the library.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.marks = [t.content for t in added.values()]
        plain = len(added) == 1 and not any(t.lstrip or t.rstrip or t.single_word for t in added.values())
        self.mark_id = np.array(list(added), np.int32) if plain else None
        self.table = PieceTable(self._pieces)

    def _pieces(self, some: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, "<i4").tobytes() for e in self.tokenizer.encode_batch_fast([p.decode() for p in some], add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, joined, and how many each has."""
        special = [i for i, x in enumerate(texts) if any(m in x for m in self.marks)]
        if not special:
            return self.table.encode(texts)
        if self.mark_id is None:
            rest = list(texts)
            for i in special:
                rest[i] = ""
            parts = np.split(*(lambda ids, n: (ids, np.cumsum(n)[:-1]))(*self.table.encode(rest)))
            for i in special:
                parts[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.int32)
            return np.concatenate(parts), np.array(list(map(len, parts)), np.int64)
        cut = [x.split(self.marks[0]) for x in texts]
        many = np.array(list(map(len, cut)), np.int64)
        ids, sizes = self.table.encode([y for x in cut for y in x])
        last = np.cumsum(many) - 1
        marked = np.ones(len(sizes), bool)
        marked[last] = False
        whole = np.full(len(ids) + int(marked.sum()), self.mark_id[0], np.int32)
        sizes = sizes + marked
        stay = np.ones(len(whole), bool)
        stay[np.cumsum(sizes)[marked] - 1] = False
        whole[stay] = ids
        return whole, np.add.reduceat(sizes, last - many + 1)


@lru_cache(4)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def segments(docs: DataFrame, tokenizer_path: str, partitions: int | None = None, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Encode whole texts in ascending doc_id order and pack them: rows of SEGMENT_SCHEMA.

    END_ID ends each document. A part is a range of doc_ids. A text is never cut: one that has more
    than segment_ids ids has a segment of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quiet_threads()
        encoder, part = library_encoder(tokenizer_path), TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        size = first = seg = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, first, seg
            ids, sizes, keys, unnamed = (np.concatenate(x) for x in zip(*held))
            row = [part, seg, first, size, pack(ids, keys, sizes, unnamed)]
            first, seg, held, size = first + size, seg + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], SEGMENT_SCHEMA.replace(",", "").split()[::2])

        for doc_ids, texts in small_batches(batches):
            ids, sizes = encoder.encode(texts)
            sizes = sizes + 1
            whole = np.full(len(ids) + len(sizes), END_ID, np.int32)
            stops = np.cumsum(sizes)
            stay = np.ones(len(whole), bool)
            stay[stops - 1] = False
            whole[stay] = ids
            unnamed, keys = np.array(doc_ids.is_null()), np.array(doc_ids.fill_null(0))
            at = begin = 0
            while at < len(sizes):
                stop = max(at + (not held), int(np.searchsorted(stops, begin + segment_ids - size, "right")))
                if stop > at:
                    end = int(stops[stop - 1])
                    held.append((whole[begin:end], sizes[at:stop], keys[at:stop], unnamed[at:stop]))
                    size, begin, at = size + end - begin, end, stop
                if at < len(sizes):
                    yield flush()
        if held:
            yield flush()

    return in_doc_order(docs, partitions).mapInArrow(run, SEGMENT_SCHEMA)


def read_back(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from written segments."""
    # One row for each part, of which there are as many as shuffle partitions.
    totals = sorted(stored.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before, offsets = 0, {}
    for part, n in totals:
        offsets[part] = before
        before += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, payload in zip(*batch.columns):
                segment = Segment(payload.as_py())
                ends = np.cumsum(segment.lengths.astype(np.int64))
                starts = ends - segment.lengths
                raw = memoryview(segment.ids().astype("<u4").tobytes())
                crc = [zlib.crc32(raw[a * 4 : b * 4]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(segment.doc_ids, mask=segment.unnamed), pa.array(starts + (offsets[part.as_py()] + first.as_py())), pa.array(segment.lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return stored.select("part", "first", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Encode, write segments to the shared folder, and report on the documents read back from them.

    doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32. Null or
    empty text: the end id alone. Repeated rows are documents of their own, in order of their text's
    hash; rows without doc_id stand first and have none in the result. No documents: no rows. The
    segments are the operator's output and stay in the shared folder.
    """
    return read_back(written(segments(docs, tokenizer_path), "tokens", compression="uncompressed"))
