import random
from collections import Counter

import pytest

from quillon.llm import packing


def brute(rows, capacity):
    """Every bin is looked at for every piece."""
    pieces = [(-min(capacity, n - at), d is not None, d or 0, c, i, at, s) for d, n, s, c in rows for i, at in enumerate(range(0, n, capacity))]
    bins, out = [], []
    for size, known, d, c, i, at, s in sorted(pieces, key=lambda p: p[:5]):
        fits = [(capacity - sum(x[0] for x in b), j) for j, b in enumerate(bins) if sum(x[0] for x in b) - size <= capacity and all(x[2] != c and (s is None or x[1] != s) for x in b)]
        if not fits:
            bins.append([])
        j = min(fits)[1] if fits else len(bins) - 1
        bins[j].append((-size, s, c))
        out.append((d if known else None, i, at, -size, j, len(bins[j]) - 1))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_against_brute_force(seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, i, 3]), rng.randint(1, 260), rng.choice(["a", "a", "b", "c", "d", None]), rng.randint(0, 60)) for i in range(150)]
    assert list(packing.pack(rows, 100)) == brute(rows, 100)


def test_no_conflict_and_all_tokens(odd, none, odd_rows):
    got = packing.packed(odd, capacity=64).collect()
    assert sum(r.n_tokens for r in got) == sum(len((t or "").encode().split()) + 1 for _, t, *_ in odd_rows)
    load = Counter()
    for r in got:
        load[r.bin_id] += r.n_tokens
    assert max(load.values()) <= 64
    source = {d: s for d, _, _, s, _ in odd_rows}
    inside = {}
    for r in got:
        if r.doc_id is not None and source[r.doc_id] is not None:
            assert source[r.doc_id] not in inside.setdefault(r.bin_id, set())
            inside[r.bin_id].add(source[r.doc_id])
    assert len({r.bin_id for r in got if r.doc_id in (5, 6)}) >= 3
    assert packing.packed(none).count() == 0


def test_shards_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCUMENTS", 10)
    docs = spark.createDataFrame([(i, "w " * (i % 9), f"s{i % 40}") for i in range(300)], "doc_id long, text string, source string")
    assert packing.packed(docs).selectExpr("shiftright(bin_id, 32) AS shard").distinct().count() > 20


def test_equal_rows_are_dealt_over_all_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCUMENTS", 10)
    docs = spark.createDataFrame([(1, "the same", "s")] * 300, "doc_id long, text string, source string").repartition(3)
    got = packing.packed(docs).collect()
    assert len(got) == 300 == len({r.bin_id for r in got}) and len({r.bin_id >> 32 for r in got}) > 20


def test_bins_bound_token_ids_and_hold_no_near_copies(spark, odd, none, odd_rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    count = lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
    got = packing.packed_by_ids(odd, path, capacity=64).collect()
    assert sum(r.n_tokens for r in got) == sum(count(t) for _, t, *_ in odd_rows)
    assert packing.packed_by_ids(none, path).count() == 0
    words = [f"w{i * 37 % 101}" for i in range(100)]
    rows = [(1, " ".join(words), None), (2, " ".join(words + ["more"]), None), (3, "漢字" * 4000, "s")]
    rows += [(10 + i, f"other {i}", None) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed = packing.packed_by_ids(docs, path).collect()
    assert {i: sum(r.n_tokens for r in placed if r.doc_id == i) for i, *_ in rows} == {i: count(t) for i, t, _ in rows}
    assert len([r for r in placed if r.doc_id == 3]) > 1
    load = Counter()
    for r in placed:
        load[r.bin_id] += r.n_tokens
    assert max(load.values()) <= packing.CAPACITY
    assert not {r.bin_id for r in placed if r.doc_id == 1} & {r.bin_id for r in placed if r.doc_id == 2}
