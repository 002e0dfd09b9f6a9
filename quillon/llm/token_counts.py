"""How many ids a text has, without the ids (operator 8).

The numbers are those of LibraryEncoder, piece by piece. Pieces are cut by class arrays alone: but for
contractions, where one starts depends on the characters next to it. Pieces not seen before are merged
together, as rows of one matrix, by the tokenizer's own merges.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from quillon.llm.bpe import RESET, WHITE, PieceTable, O, class_table
from quillon.llm.token_blocks import library_encoder

#: Characters that are cut into pieces at once; a longer text stays whole.
RUN_CHARS = 1 << 20
#: Bytes of pieces that are merged together; longer ones are left to the library.
WIDEST = 64
NONE = np.int32(2**31 - 1)


def spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What bpe.boundaries() gives: all texts as UTF-8 with a zero byte after each; first byte and length of each piece; pieces of each text."""
    joined = "\0".join(texts) + "\0"
    data = joined.encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    if len(raw) == len(joined):
        cps, kinds = raw, np.frombuffer(bytearray(data.translate(ascii_classes())), np.uint8)
    else:
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = class_table()[cps]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    kinds[ends] = WHITE  # at a text's end a white run is whole
    white = kinds == WHITE
    kinds[ends] = RESET
    starts = np.ones(len(cps), bool)
    np.not_equal(kinds[1:], kinds[:-1], out=starts[1:])
    space = cps == 32
    starts[1:] &= ~space[:-1] | white[1:]  # a space goes with what follows
    starts[:-1] |= white[:-1] & ~white[1:]  # the last of a white run stands alone or goes with what follows
    quotes = np.flatnonzero(cps[:-1] == 39)
    if len(quotes):
        before = np.maximum(quotes - 1, 0)
        quotes = quotes[(quotes == 0) | (kinds[before] != O) & ~space[before]]
        one, two = cps[quotes + 1], cps[np.minimum(quotes + 2, len(cps) - 1)]
        short = quotes[(one == 115) | (one == 116) | (one == 109) | (one == 100)]
        long = quotes[((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)]
        starts[short + 1] = False
        starts[long + 1] = False
        starts[short + 2] = True
        starts[long + 3] = True
    starts[ends] = True
    at = np.flatnonzero(starts)
    counts = np.diff(np.searchsorted(at, ends), prepend=-1) - 1
    keep = kinds[at] != RESET
    first = at if cps is raw else np.flatnonzero((raw & 0xC0) != 0x80)[at]
    lengths = np.diff(first, append=len(raw))
    return raw, first[keep], lengths[keep], counts


@lru_cache(1)
def ascii_classes() -> bytes:
    return class_table()[:256].tobytes()


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Merges:
    """Merges of a byte-level BPE model: rank of a pair of ids, by open addressing, for whole arrays of pairs."""

    BITS = 18

    def __init__(self, vocab: dict[str, int], merges: list) -> None:
        pairs, made = {}, []
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            pairs[vocab[a] << 32 | vocab[b]] = rank
            made.append(vocab[a + b])
        while len(pairs) * 3 > 1 << self.BITS:
            self.BITS += 1
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.values = np.full(1 << self.BITS, NONE, np.int32)
        self.made = np.array(made, np.int32)
        keys, values = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        slots = self.slot(keys)
        while len(keys):
            free = self.keys[slots] == -1
            self.keys[slots[free]] = keys[free]
            self.values[slots[free]] = values[free]
            left = self.keys[slots] != keys  # taken before, or lost to another key of the same slot
            keys, values, slots = keys[left], values[left], (slots[left] + 1) & ((1 << self.BITS) - 1)
        self.bytes = np.array([vocab[x] for x in byte_letters()], np.int32)
        self.first = self.find(np.repeat(self.bytes, 256), np.tile(self.bytes, 256))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.intp)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE where it makes nothing."""
        keys = a.astype(np.int64) << 32 | b
        slots = self.slot(keys)
        held = self.keys[slots]
        out = self.values[slots]
        other = held != keys
        out[other] = NONE
        open_ = np.flatnonzero(other & (held != -1))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ((1 << self.BITS) - 1)
            held = self.keys[slots[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return out

    def counts(self, raw: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Ids of each piece of at most WIDEST bytes: the leftmost pair of least rank is merged until none is left. raw: has WIDEST bytes more than its pieces."""
        out = lengths.copy()
        quarters = (lengths + 3) // 4
        for quarter in np.unique(quarters).tolist():
            index = np.flatnonzero(quarters == quarter)
            rows = np.ndarray((len(raw) - WIDEST, quarter * 4), np.uint8, raw, strides=(1, 1))[first[index]]
            out[index] -= self.merged(rows, lengths[index])
        return out

    def merged(self, raw: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """How many merges each row of bytes takes. A row's ids stay in their columns, as a linked list between two columns of NONE."""
        n, width = raw.shape
        wide = width + 2
        inside = np.arange(width)[None, :] < lengths[:, None]
        ids = np.full((n, wide), NONE, np.int32)
        ids[:, 1:-1] = np.where(inside, self.bytes[raw], NONE)
        rank = np.full((n, wide), NONE, np.int32)
        rank[:, 1:-2] = np.where(inside[:, 1:], self.first[raw[:, :-1].astype(np.intp) << 8 | raw[:, 1:]], NONE)
        after = np.tile(np.arange(1, wide + 1, dtype=np.int8), (n, 1))
        before = np.tile(np.arange(-1, wide - 1, dtype=np.int8), (n, 1))
        done, row = np.zeros(n, np.int64), np.arange(n)
        while len(row):
            here = rank.argmin(1)
            base = np.arange(len(row)) * wide
            live = np.flatnonzero(rank.reshape(-1)[base + here] != NONE)
            if len(live) * 2 < len(row):  # rows without a pair go, now and then
                row, ids, rank, after, before = row[live], ids[live], rank[live], after[live], before[live]
                if not len(live):
                    break
                here, live = here[live], np.arange(len(live))
                base = live * wide
            base = base[live]
            ids_, rank_, after_, before_ = (x.reshape(-1) for x in (ids, rank, after, before))
            at = base + here[live]
            gone = base + after_[at]
            right, left = base + after_[gone], base + before_[at]
            new = self.made[rank_[at]]
            ids_[at] = new
            after_[at] = right - base
            before_[right] = at - base
            rank_[gone] = NONE
            both = np.concatenate((at, left))
            rank_[both] = self.find(ids_[both], np.concatenate((ids_[right], new)))
            done[row[live]] += 1
        return done


class CountTable(PieceTable):
    """PieceTable whose entries are the numbers of ids themselves."""

    def __init__(self, count_all, count_long) -> None:
        """count_all: from distinct pieces of raw to their numbers of ids; count_long: the same from bytes."""
        super().__init__(None)
        self.count_all, self.count_long = count_all, count_long

    def counts(self, raw: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """How many ids each piece of raw has; raw has WIDEST bytes more than its pieces, of which there are at most RUN."""
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
            made = self.count_all(raw, first[one], lengths[one])
            self.insert(low[one], high[one], made)
            self.size += len(one)
            out[order] = made[np.cumsum(new) - 1]
        if len(long):
            data = [raw[a : a + n].tobytes() for a, n in zip(first[long].tolist(), lengths[long].tolist())]
            at = {x: i for i, x in zip(long.tolist(), data) if x not in self.long}
            fits = {x: i for x, i in at.items() if len(x) <= WIDEST}
            index = np.fromiter(fits.values(), np.int64, len(fits))
            self.long.update(zip(fits, self.count_all(raw, first[index], lengths[index]).tolist()))
            if wide := [x for x in at if len(x) > WIDEST]:
                self.long.update(self.count_long(wide))
            self.size += len(at)
            out[long] = np.fromiter(map(self.long.__getitem__, data), np.int64, len(data))
        return out


class TokenCounter:
    """How many ids texts have by the tokenizers library. Models with options of their own, and texts that hold added tokens, are left to it."""

    def __init__(self, path: str) -> None:
        self.library = library_encoder(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
        plain = model.get("type") == "BPE" and not any(model.get(x) for x in options) and not spec.get("normalizer")
        plain = plain and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        self.merges = Merges(model["vocab"], model["merges"]) if plain and all(x in model["vocab"] for x in byte_letters()) else None
        self.table = CountTable(self.merges.counts, self._long) if self.merges else None

    def _long(self, some: list[bytes]) -> Iterator[tuple[bytes, int]]:
        return zip(some, map(len, self.library.tokenizer.encode_batch_fast([x.decode() for x in some], add_special_tokens=False)))

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of ids of each text."""
        if self.merges is None:
            return self.library.encode(texts)[1]
        marked = [i for i, x in enumerate(texts) if any(m in x for m in self.library.marks)]
        if marked:
            rest = list(texts)
            for i in marked:
                rest[i] = ""
            out = self.counts(rest)
            out[marked] = self.library.encode([texts[i] for i in marked])[1]
            return out
        out, at = np.zeros(len(texts), np.int64), 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) <= RUN_CHARS):
                size += len(texts[stop]) + 1
                stop += 1
            raw, first, lengths, pieces = spans(texts[at:stop])
            raw = np.append(raw, np.zeros(WIDEST, np.uint8))
            total = np.zeros(len(first) + 1, np.int64)
            for i in range(0, len(first), PieceTable.RUN):
                last = min(i + PieceTable.RUN, len(first))
                total[i + 1 : last + 1] = self.table.counts(raw, first[i:last], lengths[i:last])
            total, stops = np.cumsum(total), np.cumsum(pieces)
            out[at:stop] = total[stops] - total[stops - pieces]
            at = stop
        return out


@lru_cache(4)
def token_counter(path: str) -> TokenCounter:
    return TokenCounter(path)
