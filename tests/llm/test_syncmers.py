import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import syncmers as s

MASK = 2**64 - 1


def mix(x):
    x = (x ^ (x >> 30)) * int(s.MIX_1) & MASK
    x = (x ^ (x >> 27)) * int(s.MIX_2) & MASK
    return x ^ (x >> 31)


def poly(part):
    x, power, width = [ord(c) + 1 for c in part], int(s.BASE), 1
    while width < len(part):
        x = [(a * power + b) & MASK for a, b in zip(x, x[width:])]
        power, width = power * power & MASK, width * 2
    return x[0]


def brute_anchors(text, k=None):
    """Closed syncmers with their places, one K-gram at a time."""
    k = k or (s.K if len(text) >= s.SHORT else s.SHORT_K)
    size, out = k // 2, []
    for i in range(len(text) - k + 1):
        inner = [mix(poly(text[j : j + size])) for j in range(i, i + k - size + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((mix(poly(text[i : i + k])), i))
    return out or ([(text, 0)] if text else [])


def brute_likeness(a, b):
    """From raw anchors: n-th occurrences meet, the longest ascending run of meetings counts, by quadratic search."""
    k = s.K if min(len(a), len(b)) >= s.SHORT else s.SHORT_K
    sides = []
    for text in (a, b):
        seen, numbered = {}, []
        for h, _ in brute_anchors(text, k):
            numbered.append((h, seen.get(h, 0)))
            seen[h] = seen.get(h, 0) + 1
        sides.append(numbered)
    x, y = sides
    if not x and not y:
        return 1.0
    place = {key: i for i, key in enumerate(y)}
    meets = [place[key] for key in x if key in place]
    best = []
    for i, v in enumerate(meets):
        best.append(1 + max((best[j] for j in range(i) if meets[j] < v), default=0))
    return 2 * max(best, default=0) / (len(x) + len(y))


def edit(text, following):
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def letters(seed, n, low=97, high=120):
    return "".join(map(chr, np.random.default_rng(seed).integers(low, high, n)))


def test_anchors_and_places():
    for text in ("abcd", "That it.", "to " * 60, letters(1, 500), "Ünï 😀 " * 20):
        for k in (s.K, s.SHORT_K):
            found = s.Document(text).anchors(k)
            if len(text) >= k:
                assert list(zip(found.hashes.tolist(), found.places.tolist())) == brute_anchors(text, k), text
    assert len(s.Document("").anchors()) == 0 and len(s.Document("ab").anchors()) == 1


def test_strides_do_not_matter(monkeypatch):
    text = letters(2, 3000)
    whole = s.Document(text).anchors().digest()
    monkeypatch.setattr(s, "STRIDE", 100)
    assert s.Document(text).anchors().digest() == whole


@settings(max_examples=150, deadline=None)
@given(st.text("ab ", max_size=200), st.text("abc ", max_size=150), st.booleans())
def test_likeness_and_edits_by_brute_force(a, b, long):
    a = a * 3 if long else a
    one, two = s.Document(a), s.Document(b)
    new = s.Edited(one, b)
    assert new.text == edit(a, b)
    for k in (s.K, s.SHORT_K):
        assert new.anchors(k).digest() == s.Document(new.text).anchors(k).digest()
    assert one.likeness(two) == two.likeness(one) == pytest.approx(brute_likeness(a, b))
    assert one.likeness(new) == pytest.approx(brute_likeness(a, new.text))
    assert one.likeness(s.Document(a)) == 1


def test_order_counts():
    a, b = letters(3, 600), letters(4, 600)
    assert s.Document(a + b).likeness(s.Document(b + a)) < 0.6 and s.Document(a + b).likeness(s.Document(a + "?" + b)) > 0.95


def test_every_anchor_of_a_long_text_counts():
    a, b, shared = letters(5, 30_000), letters(6, 30_000), letters(7, 324)
    apart = s.Document(a).likeness(s.Document(b))
    assert s.Document(a + shared).likeness(s.Document(shared + b)) > apart
    assert len(s.Document(a).anchors()) > 5000


def test_texts_near_the_short_limit():
    for n in range(20, 100):
        text = letters(n, n)
        for following in ("", "x", letters(9, 300)):
            new = s.Edited(s.Document(text), following)
            assert 0.5 < s.Document(text).likeness(new) < 1, (n, following)
    assert 0.6 < s.Document(letters(3, 4000)).likeness(s.Edited(s.Document(letters(3, 4000)), letters(4, 4000))) < 0.9
    assert s.Document(letters(3, 4000)).likeness(s.Document(letters(4, 4000))) < 0.02
    assert s.Document("").likeness(s.Document("")) == 1 and s.Document("").likeness(s.Document("abc")) == 0


def test_odd_rows(odd, none, odd_rows):
    got = s.fingerprints(odd).collect()
    assert len(got) == len(odd_rows)
    texts = sorted(((d, t or "") for d, t, *_ in odd_rows if d is not None and d != 6))
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    for (d, text), (e, after) in zip(texts, texts[1:]):
        if 6 in (d + 1, e - 1):  # the repeated rows lie between
            continue
        row, new = by_id[d], edit(text, after)
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert row.fingerprint == s.Document(text).anchors().digest() and row.edited_fingerprint == s.Document(new).anchors().digest()
        if len(text) < 5000 and len(after) < 5000:
            assert row.near_next == pytest.approx(brute_likeness(text, after)) and row.near_edited == pytest.approx(brute_likeness(text, new))
    assert [r.near_next for r in got if r.doc_id == 6].count(1.0) >= 1
    assert by_id[5].fingerprint == by_id[6].fingerprint
    assert s.fingerprints(none).count() == 0
    assert s.fingerprints(odd.where("doc_id = 12")).first().near_next == 1
    row = s.anchored(odd).where("doc_id = 16").first()
    assert list(zip([h & MASK for h in row.hashes], np.cumsum(row.gaps).tolist())) == brute_anchors(odd_rows[13][1])


def test_next_wraps_round_for_any_partitioning(spark):
    rows = [(i * 7, f"text number {i} " * 9) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for row in s.fingerprints(docs).collect():
        i = row.doc_id // 7
        assert row.edited_sha256 == hashlib.sha256(edit(rows[i][1], rows[(i + 1) % 50][1]).encode()).hexdigest()


def test_all_rows_under_one_id(spark):
    docs = spark.createDataFrame([(None, ["alpha alpha", "omega rho", "sigma"][i % 3]) for i in range(90)], "doc_id long, text string").repartition(3)
    got = s.fingerprints(docs).collect()
    assert len(got) == 90 and sum(r.near_next == 1 for r in got) == 87
