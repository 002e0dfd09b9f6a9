"""Document fingerprints from closed syncmers (operator 2).

A K-gram of code points is chosen when the smallest of the hashes of its inner S-grams lies at its
first or last place. That depends on the K-gram alone, so an edit moves no anchor outside it. A
fingerprint is the sequence of all anchors with their places. Two fingerprints are matched by
position: the n-th occurrence of an anchor in one meets the n-th in the other, and of the anchors
that meet, the most that come in the same order on both sides count. Likeness is the Dice share of
what counts. Texts of fewer than SHORT code points have too few K-grams: a pair with such a text is
compared by SHORT_K-grams on both sides.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.bpe import small_batches
from quillon.llm.common import id_text, in_doc_order, quiet_threads, written

K = 16
SHORT, SHORT_K = 64, 4
#: Code points hashed at once.
STRIDE = 1 << 18
# Odd multipliers and shifts of a well-known 64-bit finaliser.
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def grams(x: np.ndarray, size: int) -> np.ndarray:
    """A polynomial of each run of size (a power of two), by doubling."""
    power, width = BASE, 1
    while width < size:
        x = x[: len(x) - width] * power + x[width:]
        power, width = power * power, width * 2
    return x


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def chosen_grams(cps: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first places of the closed syncmers among all k-grams, in order; S is half of k."""
    s = span = k // 2
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    with np.errstate(over="ignore"):
        for at in range(0, len(cps) - k + 1, STRIDE):
            inner = grams(cps[at : at + STRIDE + k - 1].astype(np.uint64) + np.uint64(1), s)
            ranks = mixed(inner)
            low, width = ranks, 1
            while width < span + 1:  # minimum of span + 1 neighbours; overlaps do no harm
                move = min(width, span + 1 - width)
                low = np.minimum(low[: len(low) - move], low[move:])
                width += move
            chosen = np.flatnonzero((ranks[: len(low)] == low) | (ranks[span : span + len(low)] == low))
            power = BASE
            for _ in range(s.bit_length() - 1):
                power = power * power
            hashes.append(mixed(inner[chosen] * power + inner[chosen + s]))
            places.append(chosen + at)
    return np.concatenate(hashes), np.concatenate(places)


class Anchors:
    """All anchors of a text with their places, by one k. Equal texts have equal anchors.

    A text in which no k-gram is chosen, as none can be in a shorter one, has one anchor: the hash of
    the whole. The empty text has none.
    """

    def __init__(self, cps: np.ndarray, k: int, hashes: np.ndarray, places: np.ndarray) -> None:
        if not len(hashes) and len(cps):
            hashes = np.frombuffer(hashlib.blake2b(cps.tobytes(), digest_size=8).digest(), np.uint64)
            places = np.zeros(1, np.int64)
        self.k, self.hashes, self.places = k, hashes, places
        # Hashes ascending, of equal ones the first first, each made its own by how many came before.
        order = np.argsort(hashes, kind="stable")
        same = hashes[order]
        new = np.ones(len(same), bool)
        new[1:] = same[1:] != same[:-1]
        if not new.all():
            at = np.arange(len(same))
            before = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
            with np.errstate(over="ignore"):
                same = np.where(new, same, mixed(same + before * BASE))
            again = np.argsort(same, kind="stable")
            same, order = same[again], order[again]
        self.keys, self.order = same, order

    def __len__(self) -> int:
        return len(self.hashes)

    def matched(self, other: Anchors) -> int:
        """How many anchors meet and come in the same order on both sides."""
        few, many = (self, other) if len(self) <= len(other) else (other, self)
        if not len(few):
            return 0
        at = np.minimum(np.searchsorted(many.keys, few.keys), len(many) - 1)
        hit = np.flatnonzero(many.keys[at] == few.keys)
        first = few.order[hit]
        second = many.order[at[hit]][np.argsort(first)]
        return in_order(second)

    def likeness(self, other: Anchors) -> float:
        """The Dice share of matched anchors; of two without any 1."""
        total = len(self) + len(other)
        return 2 * self.matched(other) / total if total else 1.0

    def digest(self) -> str:
        """Hex digest of all anchors and the gaps between their places."""
        gaps = np.diff(self.places, prepend=0)
        return hashlib.blake2b(self.hashes.tobytes() + gaps.astype("<i8").tobytes(), digest_size=16, salt=bytes([self.k])).hexdigest() if len(self) else ""


def in_order(x: np.ndarray) -> int:
    """Length of the longest ascending subsequence of distinct numbers."""
    if len(x) < 2 or (x[1:] > x[:-1]).all():
        return len(x)
    ends: list[int] = []
    for v in x.tolist():
        if not ends or v > ends[-1]:
            ends.append(v)
        else:
            ends[bisect_left(ends, v)] = v
    return len(ends)


class Document:
    """A text with its anchors, made for each k when first asked for."""

    def __init__(self, text: str) -> None:
        self.text, self.cps = text, code_points(text)
        self.k = K if len(self.cps) >= SHORT else SHORT_K
        self._anchors: dict[int, Anchors] = {}

    def anchors(self, k: int | None = None) -> Anchors:
        k = k or self.k
        if k not in self._anchors:
            self._anchors[k] = Anchors(self.cps, k, *self._chosen(k))
        return self._anchors[k]

    def _chosen(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        return chosen_grams(self.cps, k)

    def likeness(self, other: Document) -> float:
        k = min(self.k, other.k)
        return self.anchors(k).likeness(other.anchors(k))


class Edited(Document):
    """A document whose last quarter of code points gave way to the first as many, or all, of the following.

    Grams within what stayed are chosen as before; only those that reach beyond are looked at.
    """

    def __init__(self, old: Document, following: str) -> None:
        n = len(old.text) // 4
        self.old, self.kept = old, len(old.text) - n
        super().__init__(old.text[: self.kept] + following[:n])

    def _chosen(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        before = self.old.anchors(k)
        if self.kept < k or len(self.old.cps) < k:
            return chosen_grams(self.cps, k)
        hashes, places = (before.hashes, before.places) if self._real(before) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        stay = int(np.searchsorted(places, self.kept - k, "right"))
        start = self.kept - k + 1
        more, at = chosen_grams(self.cps[start:], k)
        return np.concatenate([hashes[:stay], more]), np.concatenate([places[:stay], at + start])

    def _real(self, found: Anchors) -> bool:
        """Whether these are chosen grams and not the hash of a whole text."""
        return len(found) > 1 or len(chosen_grams(self.old.cps, found.k)[0]) > 0


def edited(text: str, following: str) -> str:
    return Edited(Document(text), following).text


FIELDS = {"doc_id": "long", "n_chars": "long", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double", "n_anchors": "long"}
EDGES = {"part": "int", "edge": "int", "edge_text": "string"}
HEAD, TAIL = 1, 2


def ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields.items())


def batch_of(rows: list[tuple], fields: dict[str, str]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[t]) for x, t in zip(zip(*rows), fields.values())], list(fields))


def described(doc_id: int | None, now: Document, after: Document) -> tuple:
    new = Edited(now, after.text)
    if new.text == now.text:
        new = now
    sha = hashlib.sha256(new.text.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(now.cps), sha, now.anchors().digest(), new.anchors().digest(), now.likeness(new), now.likeness(after), len(now.anchors())


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint every whole text, its edited text, and how near they and the next document are.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (digests of all anchors and their
    places; see anchored() for these), near_edited, near_next, n_anchors. Next is the row of next larger
    doc_id, after the last the first; a lone row is its own next. Rows of one doc_id are in order of
    their text's hash; equal rows follow each other. Null doc_ids stand first. Null text is empty, and
    its fingerprint is the empty string; two empty fingerprints have likeness 1, an empty one and
    another 0. Extra columns are ignored.

    The text moves once, into ranges of doc_id. Each range compares its rows; its first and last text go
    to a table beside the results, where the last of one range meets the first of the next.
    """
    fields = FIELDS | EDGES
    blank = (None,) * len(FIELDS)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quiet_threads()
        part, held = TaskContext.get().partitionId(), None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some, out = batch.slice(at, 512), []
                for doc_id, text in zip(*(c.to_pylist() for c in some.columns)):
                    now = Document(text or "")
                    if held is None:
                        yield batch_of([(*blank, part, HEAD, now.text)], fields)
                    else:
                        out.append((*described(*held, now), part, 0, None))
                    held = doc_id, now
                if out:
                    yield batch_of(out, fields)
        if held is not None:
            doc_id, now = held
            yield batch_of([(doc_id, *blank[1:], part, TAIL, now.text)], fields)

    stored = written(in_doc_order(docs).mapInArrow(within, ddl(fields)), "syncmers")
    # Numbers of parts, on the driver and in the broadcast: as many as the shuffle has.
    parts = sorted(r.part for r in stored.where(F.col("edge") == HEAD).select("part").collect())
    after = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next int")
    heads = stored.where(F.col("edge") == HEAD).select(F.col("part").alias("next"), F.col("edge_text").alias("next_text"))
    tails = stored.where(F.col("edge") == TAIL).select("doc_id", "part", "edge_text").join(F.broadcast(after), "part")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quiet_threads()
        for batch in batches:
            for doc_id, text, following in zip(*(c.to_pylist() for c in batch.columns)):
                yield batch_of([described(doc_id, Document(text), Document(following))], FIELDS)

    met = tails.join(heads.hint("merge"), "next").select("doc_id", "edge_text", "next_text").mapInArrow(across, ddl(FIELDS))
    return stored.where(F.col("edge") == 0).select(*FIELDS).unionByName(met)


def anchored(docs: DataFrame) -> DataFrame:
    """All anchors of every whole text: doc_id, k, hashes (array of long), gaps (array of int).

    A gap is the distance from the anchor before, in code points; the first is the place of the first
    anchor. Null and empty texts have none. A row for each row of docs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quiet_threads()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [Document(x or "").anchors() for x in part.column(1).to_pylist()]
                ends = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
                hashes = np.concatenate([x.hashes for x in found]).view(np.int64)
                gaps = np.concatenate([np.diff(x.places, prepend=0) for x in found]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x.k for x in found], pa.int32()), pa.ListArray.from_arrays(ends, pa.array(hashes)), pa.ListArray.from_arrays(ends, pa.array(gaps))],
                    ["doc_id", "k", "hashes", "gaps"],
                )

    return id_text(docs).mapInArrow(run, "doc_id long, k int, hashes array<long>, gaps array<int>")
