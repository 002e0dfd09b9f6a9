"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding (operator 9).

Pre-tokenisation follows the well-known pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

without a regex. Every code point gets a class from a table, and a symbol from its class and its
next characters. A small automaton reads the symbols; its transition functions form a finite
monoid, so the state before every character comes from an associative scan: prefix products inside
blocks (all blocks at once), then over the blocks' totals. Slices between boundaries are looked up
in a table of merged pieces, all at once.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.common import id_text, quiet_threads

# Symbols that the automaton reads.
L, N, O, SPACE_LAST, WHITE_LAST, WHITE, QUOTE_1, QUOTE_2, RESET = range(9)
# States: what token is open. CLOSED: the next character starts one.
CLOSED, IN_L, IN_N, IN_O, IN_SPACE, IN_WHITE, NEED_1, NEED_2 = range(8)
# Code points with the Unicode property White_Space.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
BLOCK = 64
CHUNK_CHARS = 1 << 18


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a token starts at this character."""
    if symbol == RESET:
        return CLOSED, True
    if symbol == SPACE_LAST:
        return IN_SPACE, True
    if symbol == WHITE_LAST:
        return CLOSED, True
    if symbol == WHITE:
        return IN_WHITE, state != IN_WHITE
    if symbol in (QUOTE_1, QUOTE_2):
        if state in (IN_O, IN_SPACE):
            return IN_O, False
        return (NEED_1 if symbol == QUOTE_1 else NEED_2), True
    if symbol == L and state in (NEED_1, NEED_2):
        return (CLOSED if state == NEED_1 else NEED_1), False
    run = {L: IN_L, N: IN_N, O: IN_O}[symbol]
    return run, state not in (run, IN_SPACE)


class Automaton:
    """The monoid that the symbols' transition functions generate, with its product table."""

    def __init__(self) -> None:
        states = range(8)
        gens = [tuple(step(s, x)[0] for s in states) for x in range(9)]
        found = {tuple(states): 0}
        queue = [tuple(states)]
        while queue:
            f = queue.pop()
            for g in gens:
                h = tuple(g[y] for y in f)
                if h not in found:
                    found[h] = len(found)
                    queue.append(h)
        self.size = len(found)
        fns = sorted(found, key=found.get)
        self.apply = np.array(fns, np.uint8).reshape(-1)
        self.product = np.array([[found[tuple(g[y] for y in f)] for g in fns] for f in fns], np.uint8).reshape(-1)
        self.generator = np.array([found[g] for g in gens], np.uint8)
        self.starts = np.array([[x < 9 and step(s, x)[1] for x in range(16)] for s in states], bool).reshape(-1)

    def states_before(self, symbols: np.ndarray) -> np.ndarray:
        n, k = len(symbols), self.size
        blocks = -(-n // BLOCK)
        grid = np.zeros(blocks * BLOCK, np.uint8)  # element 0 is the identity
        grid[:n] = self.generator[symbols]
        grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
        wide = np.empty(blocks, np.intp)
        for j in range(1, BLOCK):
            np.multiply(grid[j - 1], k, out=wide, casting="unsafe", dtype=np.intp)
            wide += grid[j]
            np.take(self.product, wide, out=grid[j], mode="clip")
        total = grid[-1].astype(np.intp)
        gap = 1
        while gap < blocks:
            total[gap:] = self.product[total[:-gap] * k + total[gap:]]
            gap *= 2
        entry = np.zeros(blocks, np.intp)
        entry[1:] = self.apply[total[:-1] * 8]
        after = np.take(self.apply, grid.astype(np.intp) * 8 + entry[None, :]).T.reshape(-1)[:n]
        before = np.empty(n, np.uint8)
        before[0] = CLOSED
        before[1:] = after[:-1]
        return before


@lru_cache(1)
def automaton() -> Automaton:
    return Automaton()


@lru_cache(1)
def class_table() -> np.ndarray:
    """L, N, O or WHITE of every code point. Planes 4 to 13 and above 0xE1000 hold neither letters nor numbers."""
    out = np.full(0x110000, O, np.uint8)
    for cp in chain(range(0x40000), range(0xE0000, 0xE1000)):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = L
        elif kind == "N":
            out[cp] = N
    out[list(WHITE_SPACE)] = WHITE
    return out


def boundaries(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts as UTF-8, each with a zero byte after it; first byte and length of each piece, in order; pieces of each text."""
    joined = "\0".join(texts) + "\0"
    raw = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
    ascii_only = len(raw) == len(joined)
    cps = raw if ascii_only else np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    symbols = class_table()[cps]
    symbols[ends] = WHITE  # for the lookahead only: at a text's end a white run is whole
    white = symbols == WHITE
    last = np.zeros(len(cps), bool)
    last[:-1] = white[:-1] & ~white[1:]
    symbols[last] = np.where(cps[last] == 32, SPACE_LAST, WHITE_LAST)
    quotes = np.flatnonzero(cps[:-1] == 39)
    if len(quotes):
        one = cps[quotes + 1]
        two = cps[np.minimum(quotes + 2, len(cps) - 1)]
        symbols[quotes[(one == 115) | (one == 116) | (one == 109) | (one == 100)]] = QUOTE_1
        symbols[quotes[((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)]] = QUOTE_2
    symbols[ends] = RESET
    auto = automaton()
    before = auto.states_before(symbols)
    at = np.flatnonzero(auto.starts[(before << 4) + symbols])
    counts = np.diff(np.searchsorted(at, ends), prepend=-1) - 1  # every RESET starts a piece of its own
    if ascii_only:
        first, stop = at, np.append(at[1:], len(raw))
    else:
        widths = np.ones(len(cps), np.int8)
        for bound in (0x80, 0x800, 0x10000):
            widths += cps >= bound
        place = np.cumsum(widths, dtype=np.int64) - widths
        first = place[at]
        stop = np.append(first[1:], len(raw))
    keep = symbols[at] != RESET
    first = first[keep]
    return raw, first, stop[keep] - first, counts


def pieces(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The pieces of all texts in order, and how many each text has."""
    raw, first, lengths, counts = boundaries(texts)
    data = raw.tobytes()
    return [data[a : a + n].decode("utf-8", "surrogatepass") for a, n in zip(first.tolist(), lengths.tolist())], counts


def chunks(texts: Iterable[str]) -> Iterator[list[str]]:
    """Runs of texts of about CHUNK_CHARS; a longer text is a run of its own and stays whole."""
    run, size = [], 0
    for x in texts:
        if run and size + len(x) > CHUNK_CHARS:
            yield run
            run, size = [], 0
        run.append(x)
        size += len(x) + 1
    if run:
        yield run


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (length of them) for each row, joined."""
    out = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    out += np.arange(len(out))
    return out


class PieceTable:
    """Ids of every piece seen, found for whole arrays of pieces at once.

    A piece of up to SHORT bytes is its own key: 16 bytes, its length in the last. Keys lie in an open
    addressing table and are compared whole. Longer pieces lie in a dict. Memory is bounded: past
    LIMIT pieces, the table is emptied and fills again from what comes.
    """

    SHORT, LIMIT, BITS = 15, 1_000_000, 21
    #: Pieces looked up at once: with LIMIT they fill under two thirds of the table.
    RUN = 1 << 18
    MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    # Odd multipliers of well-known 64-bit mixers.
    MIX_1, MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

    def __init__(self, encode_all) -> None:
        """encode_all: from distinct pieces (bytes) to their ids (little-endian int32 bytes)."""
        self.encode_all = encode_all
        self.clear()

    def clear(self) -> None:
        self.low = np.zeros(1 << self.BITS, np.uint64)
        self.high = np.zeros(1 << self.BITS, np.uint64)  # zero: a free slot, as no piece is empty
        self.entry = np.zeros(1 << self.BITS, np.int32)
        self.long: dict[bytes, int] = {}
        self.size, self.used = 0, 0
        self.start = np.zeros(1 << 12, np.int64)
        self.count = np.zeros(1 << 12, np.int64)
        self.ids = np.zeros(1 << 14, np.int32)

    def add(self, found: list[bytes]) -> np.ndarray:
        """New entries for distinct pieces."""
        made = self.encode_all(found)
        counts = np.fromiter(map(len, made), np.int64, len(made)) // 4
        total = int(counts.sum())
        while self.size + len(made) > len(self.start):
            self.start, self.count = np.append(self.start, np.zeros_like(self.start)), np.append(self.count, np.zeros_like(self.count))
        while self.used + total > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        mine = np.arange(self.size, self.size + len(made))
        self.start[mine] = self.used + np.cumsum(counts) - counts
        self.count[mine] = counts
        self.ids[self.used : self.used + total] = np.frombuffer(b"".join(made), "<i4")
        self.size, self.used = self.size + len(made), self.used + total
        return mine

    def slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = (low ^ (high * self.MIX_2)) * self.MIX_1
        return ((mixed ^ (mixed >> np.uint64(29))) * self.MIX_2 >> np.uint64(64 - self.BITS)).astype(np.int64)

    def lookup(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 where it has none."""
        slots = self.slot(low, high)
        out = np.where((self.low[slots] == low) & (self.high[slots] == high), self.entry[slots], -1)
        open_ = np.flatnonzero((out < 0) & (self.high[slots] != 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ((1 << self.BITS) - 1)
            at = slots[open_]
            hit = (self.low[at] == low[open_]) & (self.high[at] == high[open_])
            out[open_[hit]] = self.entry[at[hit]]
            open_ = open_[~hit & (self.high[at] != 0)]
        return out

    def insert(self, low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> None:
        """Distinct new keys."""
        slots = self.slot(low, high)
        left = np.arange(len(low))
        while len(left):
            at = slots[left]
            free = self.high[at] == 0
            mine = left[free]
            self.low[at[free]], self.high[at[free]], self.entry[at[free]] = low[mine], high[mine], entries[mine]
            # Of several that took one slot the last stands; the others go on, as do those that found it taken.
            lost = (self.entry[at] != entries[left]) | (self.low[at] != low[left]) | (self.high[at] != high[left])
            left = left[lost]
            slots[left] = (slots[left] + 1) & ((1 << self.BITS) - 1)

    def entries(self, raw: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The entry of each piece of raw, which has 16 bytes more than its pieces; at most RUN pieces."""
        if self.size > self.LIMIT:
            self.clear()
        words = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
        low = words[first] & self.MASKS[np.minimum(lengths, 8)]
        high = lengths.astype(np.uint64) << np.uint64(56)
        over = np.flatnonzero(lengths > 8)
        high[over] |= words[first[over] + 8] & self.MASKS[np.minimum(lengths[over], self.SHORT) - 8]
        out = self.lookup(low, high)
        long = np.flatnonzero(lengths > self.SHORT)
        out[long] = 0
        missing = np.flatnonzero(out < 0)
        if len(missing):
            order = missing[np.lexsort((low[missing], high[missing]))]
            new = np.ones(len(order), bool)
            new[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
            one = order[new]
            mine = self.add([raw[a : a + n].tobytes() for a, n in zip(first[one].tolist(), lengths[one].tolist())])
            self.insert(low[one], high[one], mine)
            out[order] = mine[np.cumsum(new) - 1]
        if len(long):
            data = [raw[a : a + n].tobytes() for a, n in zip(first[long].tolist(), lengths[long].tolist())]
            fresh = [x for x in dict.fromkeys(data) if x not in self.long]
            if fresh:
                self.long.update(zip(fresh, self.add(fresh).tolist()))
            out[long] = np.fromiter(map(self.long.__getitem__, data), np.int64, len(data))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, joined, and how many each text has. Memory follows the texts given, which stay whole."""
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for run in chunks(texts):
            raw, first, lengths, counts = boundaries(run)
            raw = np.append(raw, np.zeros(16, np.uint8))
            amounts = np.zeros(len(first) + 1, np.int64)
            for at in range(0, len(first), self.RUN):
                some = self.entries(raw, first[at : at + self.RUN], lengths[at : at + self.RUN])
                n = self.count[some]
                ids.append(self.ids[ragged(self.start[some], n)])
                amounts[at + 1 : at + 1 + len(some)] = n
            total, stops = np.cumsum(amounts), np.cumsum(counts)
            sizes.append(total[stops] - total[stops - counts])
        return np.concatenate(ids), np.concatenate(sizes)


class PairTable:
    """Rank of the token that two tokens make, by open addressing, for whole arrays of pairs."""

    NONE = np.int32(2**31 - 1)
    BITS = 20

    def __init__(self, ranks: dict[bytes, int]) -> None:
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        while len(pairs) * 3 > 1 << self.BITS:
            self.BITS += 1
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.values = np.full(1 << self.BITS, self.NONE, np.int32)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        slots, self.probes = self.slot(keys), 0
        while len(keys):
            free = self.keys[slots] == -1
            self.keys[slots[free]] = keys[free]
            self.values[slots[free]] = values[free]
            left = self.keys[slots] != keys  # taken before, or lost to another key of the same slot
            keys, values, slots = keys[left], values[left], (slots[left] + 1) & ((1 << self.BITS) - 1)
            self.probes += 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.intp)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 32 | b.astype(np.int64)
        slots = self.slot(keys)
        out = np.where(self.keys[slots] == keys, self.values[slots], self.NONE)
        for _ in range(self.probes - 1):
            slots = (slots + 1) & ((1 << self.BITS) - 1)
            out = np.where(self.keys[slots] == keys, self.values[slots], out)
        return out


def merge_all(words: list[bytes], ranks: dict[bytes, int], table: PairTable, byte_ids: np.ndarray) -> list[bytes]:
    """merge() for many pieces at once: words of like length are rows of one matrix."""
    out = [b""] * len(words)
    rows: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        rank = ranks.get(w)
        if rank is not None:
            out[i] = rank.to_bytes(4, "little")
        elif len(w) > 64:
            out[i] = np.array(merge(w, ranks), "<i4").tobytes()
        else:
            rows.setdefault((len(w) + 3) // 4, []).append(i)
    for quarter, index in rows.items():
        width = quarter * 4
        lens = np.fromiter((len(words[i]) for i in index), np.int64, len(index))
        raw = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in index), np.uint8).reshape(-1, width)
        ids = byte_ids[raw]
        pair = table.ranks(ids[:, :-1], ids[:, 1:])
        pair[np.arange(1, width)[None, :] >= lens[:, None]] = table.NONE
        active = np.arange(len(index))
        done: list = [None] * len(index)
        while len(active):
            where = pair.argmin(1)
            rank = pair[np.arange(len(active)), where]
            over = rank == table.NONE
            if over.any():
                rest, size = ids[over].astype("<i4").tobytes(), ids.shape[1] * 4
                for k, at, n in zip(active[over].tolist(), range(0, len(rest), size), (lens[over] * 4).tolist()):
                    done[k] = rest[at : at + n]
                go = ~over
                active, ids, pair, lens, where, rank = active[go], ids[go], pair[go], lens[go], where[go], rank[go]
                if not len(active):
                    break
            m, line = ids.shape[1], np.arange(len(active))
            ids[line, where] = rank
            shift = np.minimum(np.arange(m)[None, :] + (np.arange(m)[None, :] > where[:, None]), m - 1)
            ids = np.take_along_axis(ids, shift, 1)
            pair = np.take_along_axis(pair, np.minimum(shift[:, :-1], m - 2), 1)
            lens -= 1
            # The last column is a copy after the shift; beyond a word's end no pair counts.
            pair[line, np.minimum(lens - 1, m - 2)] = table.NONE
            left, right = np.maximum(where - 1, 0), np.minimum(where, m - 2)
            value = np.where(where + 1 < lens, table.ranks(ids[line, right], ids[line, np.minimum(right + 1, m - 1)]), table.NONE)
            pair[line, right] = value
            has = where > 0
            value = table.ranks(ids[line, left], ids[line, left + 1])
            pair[line[has], left[has]] = value[has]
        for k, i in enumerate(index):
            out[i] = done[k]
    return out


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Merge the leftmost pair of least rank until none is left. O(n log n) by a heap of pairs."""
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    n = len(piece)
    if n == 1:
        return (ranks[piece],)
    if n <= 40:
        parts = [piece[i : i + 1] for i in range(n)]
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, where = r, i
            if best is None:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return tuple(ranks[p] for p in parts)
    start, end, nxt, prv = list(range(n)), list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = nxt[i]
        if j < n and (r := ranks.get(piece[start[i] : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        offer(i)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j], end[i], nxt[i] = False, stop, nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        offer(i)
        if prv[i] >= 0:
            offer(prv[i])
    return tuple(ranks[piece[start[i] : end[i]]] for i in range(n) if alive[i])


class Codec:
    """Ranks of a vocabulary file in the tiktoken format (lines of base64 token, space, rank)."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        table, byte_ids = PairTable(self.ranks), np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.widths = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        self.table = PieceTable(lambda some: merge_all(some, self.ranks, table, byte_ids))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        ids, sizes = self.table.encode(texts)
        return np.split(ids, np.cumsum(sizes)[:-1]) if texts else []

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """First byte of each id's token in the decoded text, and the text's length."""
        return np.append(0, np.cumsum(self.widths[ids]))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(4)
def codec(path: str) -> Codec:
    return Codec(path)


def lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.zeros(0, "<i4")]), pa.int32()))


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Token ids of every whole text: doc_id, ids array<int>, offsets array<int>. Null text: no ids.

    offsets: first byte of each token in the text's UTF-8, and its length at the end, so that any run
    of ids can be decoded to a known place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quiet_threads()
        coder = codec(vocabulary)
        for doc_ids, texts in small_batches(batches):
            ids = coder.encode(texts)
            yield pa.RecordBatch.from_arrays([doc_ids, lists(ids), lists([coder.offsets(x) for x in ids])], ["doc_id", "ids", "offsets"])

    return id_text(docs).mapInArrow(run, "doc_id long, ids array<int>, offsets array<int>")


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[tuple[pa.Array, list[str]]]:
    """doc_id and text (null: empty) in slices, so that Python objects of few rows live at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column(0), [x or "" for x in part.column(1).to_pylist()]


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode every whole text, decode the ids, and digest both.

    doc_id, n_tokens (long), ids_sha256 (hex of the decimal ids joined by commas), decoded_sha256
    (hex of the decoded bytes). Null or empty text: no ids, digests of the empty string. A row for
    each row of docs: repeated rows give repeated results; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quiet_threads()
        coder = codec(vocabulary)
        for doc_ids, texts in small_batches(batches):
            counts, of_ids, of_text = [], [], []
            for ids in coder.encode(texts):
                counts.append(len(ids))
                ids = ids.tolist()
                of_ids.append(hashlib.sha256(",".join(map(coder.decimal.__getitem__, ids)).encode()).hexdigest())
                of_text.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
