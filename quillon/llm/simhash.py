"""SimHash near-duplicate groups by BK-trees (operator 10).

Fingerprints come from hashed 3-word shingles. Equal fingerprints are one vertex. Two fingerprints
that differ in at most RADIUS bits agree on one of RADIUS + 1 blocks of their bits, and the rest on
one of RADIUS + 1 blocks again, so each vertex goes to 16 shards named by block and block value.
Each shard has a BK-tree: children are keyed by their integer Hamming distance to the parent, and a
search follows only edges whose key is within the radius of the distance just measured. The tree is
built and searched in the task that holds the shard, because trees of all shards together grow with
the corpus and must not be broadcast. A task reports a spanning forest of its links, not all pairs:
subtrees that lie in the searcher's component are skipped. Star contraction joins the forests.

The pipeline's stage takes another contract: shingles of five words and Jaccard similarity of 0.8 or
more. The SimHashes of such texts differ in 10 bits on average and in 20 at times, so that its trees are
searched with WIDE_RADIUS, and what a search finds are candidates; links are those that an exact comparison
of shingle sets confirms. No agreement of blocks names shards at that radius. They are named by bands of minima:
each of BANDS keys is made of the least of ROWS orders of the shingle set, so that a pair of similarity s
shares none of them with probability (1 - s^ROWS)^BANDS, 6e-7 at 0.8. Keys that the same texts share are one
shard. A large shard is dealt into blocks, with a tree each; then each block's tree is searched by the texts of each
other block that lie in other components, so that no shard need fit a task and only links leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.bpe import small_batches
from quillon.llm.common import Scratch, id_text, quiet_threads, remove_path, unused, written, written_at

RADIUS = 3
SHINGLE_WORDS = 3
STAGE_WORDS = 5
#: Least Jaccard similarity of the stage's links, as a fraction.
SIMILAR, OF = 4, 5
#: Differing bits of candidates. At similarity 0.8 SimHashes differ in 9.7 bits, standard deviation 2.9.
WIDE_RADIUS = 26
#: Keys of a text, and minima in each.
BANDS, ROWS = 20, 3
#: Texts of a shard from which candidates are first compared by their minima.
SMALL_GROUP = 64
#: Texts and shingles of a block of a larger group, about. A cell holds two blocks.
BLOCK_TEXTS, BLOCK_HASHES = 4096, 1 << 21
#: Texts of a cell from which a text's shingles are marked for all its comparisons, and shingles up to which there is memory for that.
FEW, MARKED_HASHES = 8, 1 << 20
#: Equal minima of BANDS * ROWS that candidates of a cell must have: a pair at 0.8 has fewer with probability 2e-9.
EQUAL_MINIMA = 28
#: Bytes of text whose shingles are hashed at once; a longer text is cut between words.
STRIDE = 1 << 20
#: Sets of one id that are remembered to drop repeated rows. Repeats that stay cost time and change no result.
SEEN = 1 << 16
# Odd multipliers of well-known 64-bit mixers.
MIXERS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: One in every byte.
EIGHT_ONES = np.uint64(0x0101010101010101)
SEED = 42
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text: str, width: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles of width words, or of all words where they are fewer; in order, in parts."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()  # ASCII white space only
    n = len(words)
    if not n:
        return
    digest = xxhash.xxh64_intdigest
    if n <= width:
        yield np.array([digest(b" ".join(words), SEED)], np.uint64)
        return
    joined = memoryview(b" ".join(words))
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    total = n - width + 1
    for at in range(0, total, 1 << 15):
        yield np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts[at : min(at + (1 << 15), total)], starts[at + width :])], np.uint64)


def majority(parts: Iterable[np.ndarray]) -> int:
    """64 bits: 1 where over half of the hashes have 1. No hashes: 0."""
    ones, total = np.zeros(64, np.int64), 0
    for part in parts:
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
        total += len(part)
    return int.from_bytes(np.packbits(ones * 2 > total, bitorder="little").tobytes(), "little")


def majorities(sets: list[np.ndarray]) -> np.ndarray:
    """majority() of each set. Eight bits of every hash are summed at a time, each in a byte of its own, over 255 hashes at most."""
    out = np.zeros(len(sets), np.uint64)
    some = [i for i, x in enumerate(sets) if len(x)]
    at = 0
    for run in runs_of([sets[i] for i in some]):
        here, at = some[at : at + len(run)], at + len(run)
        if len(run[-1]) > STRIDE:
            out[here] = [majority(x[a : a + STRIDE] for a in range(0, len(x), STRIDE)) for x in run]
            continue
        every, sizes = np.concatenate(run), np.fromiter(map(len, run), np.int64, len(run))
        parts = -(-sizes // 255)
        firsts = np.cumsum(parts) - parts
        starts = np.repeat(np.cumsum(sizes) - sizes - firsts * 255, parts) + np.arange(parts.sum()) * 255
        ones = np.empty((len(starts), 8, 8), np.uint8)  # part, bit of a byte, byte
        for bit in range(8):
            ones[:, bit] = np.add.reduceat(every >> np.uint64(bit) & EIGHT_ONES, starts).astype("<u8").view(np.uint8).reshape(-1, 8)
        total = np.add.reduceat(ones.reshape(-1, 64), firsts, axis=0, dtype=np.int64).reshape(-1, 8, 8)
        out[here] = np.packbits((total * 2 > sizes[:, None, None]).transpose(0, 2, 1).reshape(-1, 64), axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprint(text: str, width: int = SHINGLE_WORDS) -> int:
    """64 bits: 1 where over half of the shingles' hashes have 1. No words: 0."""
    return majority(shingles(text, width))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint fp, as a signed long, of every whole text. Null text: no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quiet_threads()
        for doc_ids, texts in small_batches(batches):
            found = np.array([fingerprint(x) for x in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return id_text(docs).mapInArrow(run, "doc_id long, fp long")


class Forest:
    """Union-find over the vertices that have links; the root is the smallest."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


class BKTree:
    """Fingerprints with an owner each. one[i]: an owner, if all owners below node i were joined to it; else None."""

    def __init__(self, forest: Forest, radius: int = RADIUS, confirm: Callable[[int, int], bool] | None = None) -> None:
        """confirm: an exact check of two owners within the radius; without, all such are linked."""
        self.forest, self.radius, self.confirm = forest, radius, confirm
        self.values: list[int] = []
        self.owners: list[int] = []
        self.children: list[dict[int, int]] = []
        self.one: list[int | None] = []

    def link_and_add(self, value: int, owner: int) -> list[int]:
        """Join owner to every component within the radius, then add it. Returns one neighbour for each."""
        links = self.link(value, owner)
        self.add(value, owner)
        return links

    def link(self, value: int, owner: int) -> list[int]:
        """Join owner to every component within the radius. Returns one neighbour for each."""
        if not self.values:
            return []
        values, owners, children, one = self.values, self.owners, self.children, self.one
        radius, confirm, find, links = self.radius, self.confirm, self.forest.find, []
        stack, mine = [0], find(owner)
        while stack:
            at = stack.pop()
            below = children[at]
            if below and one[at] is not None and find(one[at]) == mine:
                continue
            far = (values[at] ^ value).bit_count()
            if far <= radius and find(owners[at]) != mine and (confirm is None or confirm(owner, owners[at])):
                self.forest.join(owner, owners[at])
                links.append(owners[at])
                mine = find(owner)
            if below:
                low, high = far - radius, far + radius
                stack += [child for edge, child in below.items() if low <= edge <= high]
        return links

    def add(self, value: int, owner: int) -> None:
        if not self.values:
            self._new(value, owner)
            return
        values, children, find = self.values, self.children, self.forest.find
        at, mine = 0, find(owner)
        while True:
            if self.one[at] is not None and find(self.one[at]) != mine:
                self.one[at] = None
            far = (values[at] ^ value).bit_count()
            down = children[at].get(far)
            if down is None:
                children[at][far] = self._new(value, owner)
                return
            at = down

    def _new(self, value: int, owner: int) -> int:
        self.values.append(value)
        self.owners.append(owner)
        self.children.append({})
        self.one.append(owner)
        return len(self.values) - 1


def shards(fp: Column) -> Column:
    """The 16 shards of a fingerprint: one of 4 blocks of 16 bits, then one of 4 blocks of the other 48."""
    out = []
    for first in range(4):
        low = fp.bitwiseAND(F.lit((1 << 16 * first) - 1))
        rest = F.shiftleft(F.shiftrightunsigned(fp, 16 * (first + 1)), 16 * first).bitwiseOR(low) if first < 3 else low
        major = F.shiftrightunsigned(fp, 16 * first).bitwiseAND(F.lit(0xFFFF))
        for second in range(4):
            minor = F.shiftrightunsigned(rest, 12 * second).bitwiseAND(F.lit(0xFFF))
            out.append(F.lit((first * 4 + second) << 28).bitwiseOR(F.shiftleft(major, 12)).bitwiseOR(minor))
    return F.array(*out)


def links(vertices: DataFrame) -> DataFrame:
    """Edges (a, b) between owners that connect just what fingerprints within the radius connect.

    vertices: fp (distinct) and owner (distinct). Memory: the largest shard and its links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, current = None, None
        for batch in batches:
            a, b = [], []
            for shard, value, owner in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != current:
                    tree, current = BKTree(Forest()), shard
                for other in tree.link_and_add(value & (1 << 64) - 1, owner):
                    a.append(owner)
                    b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = vertices.select(F.explode(shards(F.col("fp"))).alias("shard"), "fp", "owner").repartition("shard")
    return dealt.sortWithinPartitions("shard").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """vertex and root, the smallest vertex that it reaches, for every vertex with an edge. A table of scratch.

    Alternating large-star and small-star steps on tables in the shared folder. Minima are combined
    before the shuffle, and the joins back can be split where one vertex has very many edges.
    """
    current, path = written_at(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    scratch.paths.append(path)
    before = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        after, new_path = written_at(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        scratch.paths.append(new_path)
        mark = tuple(after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        remove_path(current.sparkSession, path)
        scratch.paths.remove(path)
        current, path = after, new_path
        if mark == before or not mark[0]:
            return current.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
        before = mark


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Fingerprint every whole text and group documents whose fingerprints differ in few bits.

    doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id reachable by links
    of at most RADIUS differing bits, itself included). Null, empty and white texts have fingerprint
    zero and link like any other. A row for each row of docs; repeated rows link to each other. Rows
    whose doc_id is null get the component of their fingerprint, null where no other row has it.
    """
    marks = written(fingerprints(docs), "fingerprints")
    vertices = marks.groupBy("fp").agg(F.min("doc_id").alias("owner"))
    with Scratch(docs.sparkSession) as scratch:
        roots = components(links(vertices.where("owner IS NOT NULL")), scratch)
        named = vertices.join(roots, vertices.owner == roots.vertex, "left").select(F.col("fp").alias("vertex_fp"), F.coalesce("root", "owner").alias("component_id"))
        # Written first: the join below then stands alone after its shuffles, so that Spark can split a
        # fingerprint that very many documents share.
        named = written(named, "components")
    return marks.join(named, marks.fp == named.vertex_fp).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


LOWER_TABLE = np.frombuffer(LOWER, np.uint8)
WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIXERS[1]
    x = (x ^ (x >> np.uint64(27))) * MIXERS[2]
    return x ^ (x >> np.uint64(31))


#: Odd numbers; each gives one order of shingle hashes.
ORDERS = mixed(np.arange(1, BANDS * ROWS + 1).astype(np.uint64) * MIXERS[0]) | np.uint64(1)
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and a hash of each word of the bytes, in order: A-Z lower-cased, eight bytes at a time."""
    white = np.ones(len(raw) + 2, bool)
    white[1:-1] = WHITE[raw]
    edges = np.flatnonzero(white[1:] != white[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    low = np.zeros(len(raw) + 8, np.uint8)
    low[:-8] = LOWER_TABLE[raw]
    eights = np.ndarray(len(raw) + 1, "<u8", low, strides=(1,))
    out = mixed(lengths.astype(np.uint64) * MIXERS[3] ^ (eights[starts] & MASKS[np.minimum(lengths, 8)]))
    long, at = np.flatnonzero(lengths > 8), 8
    while len(long):
        out[long] = mixed(out[long] * MIXERS[4] ^ (eights[starts[long] + at] & MASKS[np.minimum(lengths[long] - at, 8)]))
        at += 8
        long = long[lengths[long] > at]
    return starts, out


def combined(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width words."""
    total = np.full(len(words) - width + 1, np.uint64(width))
    for i in range(width):
        total = (total + words[i : i + len(total)]) * MIXERS[i]
        total ^= total >> np.uint64(29)
    return mixed(total)


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def sets_of(texts: list[str]) -> list[np.ndarray]:
    """For each text the distinct hashes of the stage's shingles, ascending; of all its words where they are fewer."""
    out: list[np.ndarray] = []
    raws = [x.encode("utf-8", "surrogatepass") for x in texts]
    at = 0
    while at < len(raws):
        stop, size = at, 0
        while stop < len(raws) and (stop == at or size + len(raws[stop]) <= STRIDE):
            size += len(raws[stop]) + 1
            stop += 1
        if size > STRIDE:  # one long text
            words = np.concatenate([word_hashes(part)[1] for part in cut(np.frombuffer(raws[at], np.uint8))])
            out.append(distinct(combined(words, min(len(words), STAGE_WORDS))) if len(words) else words)
        else:
            starts, words = word_hashes(np.frombuffer(b"\n".join(raws[at:stop]), np.uint8))
            begins = np.cumsum([0, *(len(x) + 1 for x in raws[at:stop])])
            first = np.searchsorted(starts, begins).tolist()
            every = combined(words, STAGE_WORDS) if len(words) >= STAGE_WORDS else words[:0]
            for a, b in zip(first, first[1:]):
                few = b - a < STAGE_WORDS
                out.append(combined(words[a:b], b - a) if few and b > a else every[:0] if few else distinct(every[a : b - STAGE_WORDS + 1]))
        at = stop
    return out


def cut(raw: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of about STRIDE bytes that end between words."""
    at = 0
    while at < len(raw):
        stop = min(at + STRIDE, len(raw))
        while stop < len(raw) and not WHITE[raw[stop]]:
            after = np.flatnonzero(WHITE[raw[stop : stop + STRIDE]])
            stop += int(after[0]) if len(after) else len(raw[stop : stop + STRIDE])
        yield raw[at:stop]
        at = stop


def shingle_set(text: str) -> np.ndarray:
    return sets_of([text])[0]


def digests(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits of each set, as two signed longs in a row."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes(), SEED) for x in sets), np.int64).reshape(-1, 2)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, low (half the set's digest), hashes (array of long) of the rows of docs, which has doc_id and text.

    Texts without words have no row: they share no shard. Of rows in succession that have one id and one set the first stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quiet_threads()
        last, seen = None, set()
        for doc_ids, texts in small_batches(batches):
            sets, stay = sets_of(texts), []
            lows = digests(sets)[:, 1]
            for i, (doc_id, low) in enumerate(zip(doc_ids.to_pylist(), lows.tolist())):
                if doc_id != last or len(seen) > SEEN:
                    last, seen = doc_id, set()
                if len(sets[i]) and low not in seen:
                    seen.add(low)
                    stay.append(i)
            yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(stay, pa.int64())), pa.array(lows[stay]), arrays([sets[i] for i in stay])], ["doc_id", "low", "hashes"])

    return docs.mapInArrow(run, "doc_id long, low long, hashes array<long>")


def arrays(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *rows]).view(np.int64)))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The least of each of BANDS * ROWS orders of each set; no set is empty. A row for each set."""
    out = np.empty((len(sets), BANDS * ROWS), np.uint64)
    done = 0
    for group in runs_of(sets):
        every, starts = np.concatenate(group), np.cumsum([0, *map(len, group[:-1])])
        order = np.empty_like(every)
        for i in range(BANDS * ROWS):
            np.multiply(every, ORDERS[i], out=order)
            order ^= order >> np.uint64(29)
            order *= MIXERS[2]
            out[done : done + len(group), i] = np.minimum.reduceat(order, starts)
        done += len(group)
    return out


def band_keys(sets: list[np.ndarray]) -> list[np.ndarray]:
    """BANDS keys of each shingle set; none of an empty one."""
    least = minima([x for x in sets if len(x)])
    keys = np.empty((len(least), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(least), np.uint64(band + 1))
        for row in range(ROWS):
            key = mixed((key + least[:, band * ROWS + row]) * MIXERS[row])
        keys[:, band] = key
    rows = iter(keys)
    return [next(rows) if len(x) else x[:0] for x in sets]


def runs_of(sets: list[np.ndarray], size: int = 1 << 15) -> Iterator[list[np.ndarray]]:
    """Runs of sets of about size hashes together, which fit a core's cache."""
    run, n = [], 0
    for x in sets:
        run.append(x)
        n += len(x)
        if n >= size:
            yield run
            run, n = [], 0
    if run:
        yield run


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, 128-bit digest (high, low) of the shingle set, its SimHash fp, its size, its keys, of rows with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quiet_threads()
        for doc_ids, texts in small_batches(batches):
            sets = sets_of(texts)
            halves = digests(sets)
            marks = majorities(sets).view(np.int64)
            yield pa.RecordBatch.from_arrays([doc_ids, *(pa.array(np.ascontiguousarray(x)) for x in (halves[:, 0], halves[:, 1], marks)), pa.array([len(x) for x in sets], pa.int64()), arrays(band_keys(sets))], ["doc_id", "high", "low", "fp", "size", "keys"])

    return id_text(docs).where("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, high long, low long, fp long, size long, keys array<long>")


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets, ascending, have the similarity."""
    if len(x) > len(y):
        x, y = y, x
    if len(x) * OF < len(y) * SIMILAR:
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
    return both * OF >= (len(x) + len(y) - both) * SIMILAR


class Overlaps:
    """alike() of many sets with one and the same: its shingles are marked once, and those of the others counted."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        known, place = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum([0, *map(len, sets)]).tolist()
        place = place.astype(np.int32)
        self.places = [place[a:b] for a, b in zip(ends, ends[1:])]
        self.seen = np.zeros(len(known), bool)
        self.at = None

    def alike(self, i: int, j: int) -> bool:
        if self.at != i:
            if self.at is not None:
                self.seen[self.places[self.at]] = False
            self.seen[self.places[i]] = True
            self.at = i
        both = int(np.count_nonzero(self.seen.take(self.places[j])))
        return both * OF >= (len(self.places[i]) + len(self.places[j]) - both) * SIMILAR


def sets_for(ids: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """shingle_sets() of the rows of docs that ids names."""
    return scratch.written(shingle_sets(id_text(docs).join(ids.hint("merge"), "doc_id", "left_semi").select("doc_id", "text")), "shingles")


def slices(column: pa.ListArray) -> list[np.ndarray]:
    """The rows of a column of shingle sets."""
    ends = column.offsets.to_numpy()
    every = column.values.to_numpy().view(np.uint64)
    return [every[a:b] for a, b in zip(ends, ends[1:])]


def searched(ids: list[int], fps: list[int], sets: list[np.ndarray], roots: list[int], blocks: list[int], first: int, second: int) -> Iterator[tuple[int, int]]:
    """Links (a, b) of one cell: a BK-tree of the SimHashes of block first, searched by the texts of block second.

    A block's own cell (first = second) searches before it adds each text. Texts of one root are joined from the start.
    """
    forest, known = Forest(), {}
    for i, root in enumerate(roots):
        forest.join(known.setdefault(root, i), i)
    least = minima(sets).astype(np.uint8) if len(ids) > SMALL_GROUP else None

    sizes = list(map(len, sets))
    overlaps = Overlaps(sets) if len(ids) > FEW and sum(sizes) <= MARKED_HASHES else None

    def confirm(i: int, j: int) -> bool:
        x, y = sizes[i], sizes[j]
        if x * OF < y * SIMILAR or y * OF < x * SIMILAR or least is not None and np.count_nonzero(least[i] == least[j]) < EQUAL_MINIMA:
            return False
        return overlaps.alike(i, j) if overlaps else alike(sets[i], sets[j])

    tree = BKTree(forest, WIDE_RADIUS, confirm)
    for i in sorted(range(len(ids)), key=lambda i: blocks[i] != first):
        value = fps[i] & (1 << 64) - 1
        if blocks[i] == second:
            for j in tree.link(value, i):
                yield ids[i], ids[j]
        if blocks[i] == first:
            tree.add(value, i)


def crossed(rows: DataFrame, sets: DataFrame, scratch: Scratch, within: bool) -> DataFrame:
    """Links (a, b) that join the components of rows that share a shard: key, doc_id, low, fp, root, many, total.

    many, total: texts and shingles of the shard. A shard is dealt into blocks by low, half the digest of a text's set, and
    a row meets the set of that digest alone, however many texts an id has. within: each block is a cell, searched by its
    own texts; else each two blocks are. sets: doc_id, low, hashes. Memory: a cell and its links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quiet_threads()
        cell, current = ([], [], [], [], []), None
        for batch in batches:
            a, b = [], []
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("key", "p", "q"))))
            columns = [*(batch.column(c).to_pylist() for c in ("doc_id", "fp")), slices(batch.column("hashes")), *(batch.column(c).to_pylist() for c in ("root", "block"))]
            for key, *row in zip(keys, *columns):
                if key != current:
                    for x, y in searched(*cell, *current[1:]) if current else ():
                        a.append(x)
                        b.append(y)
                    cell, current = ([], [], [], [], []), key
                for held, value in zip(cell, row):
                    held.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        if current:
            found = list(searched(*cell, *current[1:]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    blocks = F.expr(f"greatest(ceil(many / {BLOCK_TEXTS}), ceil(total / {BLOCK_HASHES}))").cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("block", F.expr("pmod(xxhash64(doc_id, low), blocks)").cast("int"))
    others = F.col("block") if within else F.explode(F.expr("filter(sequence(0, blocks - 1), x -> x <> block)"))
    dealt = dealt.where("within OR blocks > 1".replace("within", str(within))).withColumn("other", others)
    dealt = dealt.select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "doc_id", "low", "fp", "root")
    cells = dealt.join(sets.hint("merge"), ["doc_id", "low"]).repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return scratch.written(cells.mapInArrow(run, "a long, b long").distinct(), "links")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, component_id of every row with an id: groups by links of Jaccard similarity 0.8 or more.

    Shingles are of STAGE_WORDS words, or all words of a shorter text. component_id is the smallest
    doc_id reachable. Texts without words link to each other. Texts under one id count as one. A table
    in the shared folder. SimHashes meet in BK-trees; shards of every size are searched whole. A link is missed only if its
    texts share no shard (6e-7 at similarity 0.8, less above) or fail the tests of candidates (2e-8).
    """
    with Scratch(docs.sparkSession) as scratch:
        marks = scratch.written(marked(docs), "marks")
        owners = scratch.written(marks.groupBy("high", "low").agg(F.min("doc_id").alias("owner")), "owners")
        copies = marks.select("doc_id", "high", "low").join(owners.hint("merge"), ["high", "low"]).where("doc_id <> owner").select(F.col("doc_id").alias("a"), F.col("owner").alias("b"))
        # Of equal sets one, that of the smallest id, meets others.
        rows = marks.join(owners.select("high", "low", F.col("owner").alias("doc_id")).hint("merge"), ["high", "low", "doc_id"], "left_semi").dropDuplicates(["high", "low"])
        rows = scratch.written(rows.select("doc_id", "low", "fp", "size", F.explode("keys").alias("key")), "keys")
        # Keys that the same texts share, by 128 bits of hashes of these, are one shard.
        one, two = F.xxhash64("doc_id", "low"), F.xxhash64(F.lit(SEED), "doc_id", "low")
        bottom, top = two.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(two, 32)
        groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.sum("size").alias("total"), F.bit_xor(one).alias("x"), F.sum(bottom).alias("y"), F.sum(top).alias("z")).where("many > 1")
        shards = groups.groupBy("many", "total", "x", "y", "z").agg(F.min("key").alias("key")).select("key", "many", "total")
        met = scratch.written(rows.join(shards.hint("merge"), "key").select("key", "doc_id", "low", "fp", "many", "total", F.col("doc_id").alias("root")), "met")
        sets = sets_for(met.select("doc_id").distinct(), docs, scratch)
        roots = components(copies.union(crossed(met, sets, scratch, True)), scratch)
        large = met.where(f"many > {BLOCK_TEXTS} OR total > {BLOCK_HASHES}")
        if not large.isEmpty():
            # Of shards of several blocks, those whose texts lie in several components yet.
            named = large.drop("root").join(roots.select(F.col("vertex").alias("doc_id"), "root").hint("merge"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
            named = scratch.written(named, "rooted")
            several = named.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key")
            more = crossed(named.join(several.hint("merge"), "key", "left_semi"), sets, scratch, False)
            roots = components(more.union(roots.select(F.col("vertex").alias("a"), F.col("root").alias("b"))), scratch)
        return written(marks.select("doc_id").join(roots.hint("merge"), F.col("doc_id") == F.col("vertex"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("component_id")), "near-copies")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group by near_copies(). Of rows that share an id one stays.

    All columns of docs, in order, whatever their names. Rows without doc_id go: no decision can name them.
    """
    (kept,) = unused(docs.columns, "kept_doc_id")
    keep = near_copies(docs).where("doc_id = component_id").groupBy(F.col("doc_id").alias(kept)).count()
    keep = written(keep, "kept")
    # A merge join at every size: what stays grows with the corpus, so that no broadcast of it is bounded.
    left = docs.join(keep.select(kept).hint("merge"), docs["doc_id"].cast("long") == F.col(kept), "left_semi")
    return left if keep.where("count > 1").isEmpty() else left.dropDuplicates(["doc_id"])
