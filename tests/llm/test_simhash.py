import re

import numpy as np
import xxhash

from quillon.llm import simhash
from quillon.llm.common import Scratch


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, fps):
    """Smallest id reachable, by comparing all pairs."""
    best = dict(zip(range(len(ids)), ids))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            near = np.flatnonzero(np.bitwise_count(np.array(fps, np.uint64) ^ np.uint64(a)) <= 3)
            low = min(best[int(j)] for j in near)
            for j in near:
                changed |= best[int(j)] != low
                best[int(j)] = low
    return [best[i] for i in range(len(ids))]


def test_fingerprint():
    for text in ("", " \n", "one", "One two", "a b c", "a a a a a a", "Ünï\xa0x y\x0bz w " * 9, "q " * 200 + "r"):
        assert simhash.fingerprint(text) == brute_fingerprint(text), text


def test_odd_rows(odd, none, odd_rows):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(odd).collect()}
    known = [(d, simhash.fingerprint(t or "")) for d, t, *_ in odd_rows if d is not None]
    want = groups([d for d, _ in known], [f for _, f in known])
    assert {(d, f"{f:016x}"): w for (d, f), w in zip(known, want)}.items() <= got.items()
    assert simhash.near_duplicates(odd).count() == len(odd_rows)
    assert simhash.near_duplicates(none).count() == 0


def random_fingerprints(n, rng):
    """Chains and clouds of close fingerprints among unrelated ones."""
    out = set()
    while len(out) < n:
        at = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(0, 2))
        for _ in range(int(rng.integers(1, 12))):
            out.add(at)
            for bit in rng.integers(0, 64, int(rng.integers(1, 5))):
                at ^= 1 << int(bit)
    return sorted(out)


def test_components_against_all_pairs(spark):
    fps = random_fingerprints(400, np.random.default_rng(2))
    ids = np.random.default_rng(3).permutation(len(fps)).tolist()
    vertices = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f, i) for f, i in zip(fps, ids)], "fp long, owner long")
    with Scratch(spark) as scratch:
        roots = dict(simhash.components(simhash.links(vertices), scratch).collect())
    assert [roots.get(i, i) for i in ids] == groups(ids, fps)


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    with Scratch(spark) as scratch:
        found = simhash.components(edges, scratch).collect()
    assert {tuple(r) for r in found} == {(i, 0) for i in range(1, 201)}


def test_tree_follows_only_edges_within_the_radius():
    forest = simhash.Forest()
    tree = simhash.BKTree(forest)
    values = random_fingerprints(300, np.random.default_rng(8))
    for i, v in enumerate(values):
        tree.link_and_add(v, i)
    assert [forest.find(i) for i in range(len(values))] == groups(list(range(len(values))), values)


def test_one_of_each(odd, none):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 5 in ids and not {6, 7} & set(ids) and 8 in ids and not {9, 10} & set(ids)
    assert simhash.one_of_each(none).count() == 0


def near_texts(rng):
    """Texts of many sizes with copies from slightly to much edited, and short ones."""
    out = ["", " ", "one two", "One  two", "a b c d e", "a b c d e f", "a b c d f"]
    for size in (6, 9, 14, 30, 80, 300, 900):
        for _ in range(4):
            words = [f"w{x}" for x in rng.integers(0, 5000, size)]
            out.append(" ".join(words))
            for edits in (0, 1, 2, size // 80, size // 50, size // 40, size // 20):
                now = list(words)
                for at in rng.integers(0, size, edits):
                    now[at] = f"e{rng.integers(0, 5000)}"
                out.append(" ".join(now + ["tail"] * int(rng.integers(0, 2))))
    return out


def test_stage_keeps_one_of_each_group_of_jaccard_080(spark):
    rng = np.random.default_rng(11)
    texts = near_texts(rng)
    ids = rng.permutation(len(texts)).tolist()
    sets = []
    for t in texts:
        words = t.lower().split()
        sets.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    best, changed = list(ids), True
    links = [(i, j) for i in range(len(ids)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(best[i], best[j])
            changed |= best[i] != low or best[j] != low
            best[i] = best[j] = low
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    assert dict(simhash.near_copies(docs).collect()) == dict(zip(ids, best))
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == set(best)
    far = [(i, j) for i, j in links if (simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count() > simhash.RADIUS]
    assert len(far) > 20  # what the operator's own radius would have kept


def test_shingles_of_five_words():
    def brute(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    rng = np.random.default_rng(12)
    texts = ["", " ", "a", "a b", "A B c D", "a b c d e", "a b c d e f", "ab c d e f", "a bc d e f", "x " * 40, "Ünï\xa0x y\x0bz w q " * 9]
    texts += [" ".join(rng.choice(["alpha", "b", "Gamma", "d"], 60)) for _ in range(30)]
    sets = [set(simhash.shingle_set(t).tolist()) for t in texts]
    for t, x in zip(texts, sets):
        assert len(x) == len(brute(t)), t
        for u, y in zip(texts, sets):
            assert len(x & y) == len(brute(t) & brute(u))


def test_strides_of_long_texts_do_not_matter(monkeypatch):
    text = " ".join(f"w{i * i % 977}" + "x" * (300 if i % 50 == 0 else 0) for i in range(900)) + "  "
    texts = [text, "a b", "", text[:200], "one " * 9, text]
    whole = [simhash.shingle_set(t).tolist() for t in texts]
    assert [x.tolist() for x in simhash.sets_of(texts)] == whole
    for stride in (64, 700, 3000):
        monkeypatch.setattr(simhash, "STRIDE", stride)
        assert [x.tolist() for x in simhash.sets_of(texts)] == whole


def test_common_passage_and_large_group(spark):
    """A passage that all share, one text with many near copies, and others: no link is lost or made."""
    rng = np.random.default_rng(13)
    passage = " ".join(f"p{i}" for i in range(60))
    family = [f"f{x}" for x in rng.integers(0, 9999, 120)]
    rows = []
    for i in range(500):
        if i % 3 == 0:
            now = list(family)
            now[int(rng.integers(0, 120))] = f"e{i}"
            text = " ".join(now)
        else:
            text = " ".join(f"o{x}" for x in rng.integers(0, 10**6, 80))
        rows.append((i, f"{passage} {text}"))
    got = dict(simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {i: 0 if i % 3 == 0 else i for i, _ in rows}


def test_tables_are_removed(spark, odd):
    from quillon.llm.common import own_dir

    def tables():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
        return {f.getPath().getName().rsplit("-", 1)[0] for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)}

    simhash.near_copies(odd)
    assert not tables() & {"edges", "marks", "keys", "met", "weighed", "stars", "pairs", "shingles", "links", "rooted", "owners"}


def test_bands_meet_as_calculated():
    rng = np.random.default_rng(14)
    met, shared = 0, 0
    for _ in range(300):
        x = rng.integers(0, 2**63, 90).astype(np.uint64)
        a, b = simhash.band_keys([np.unique(x[:80]), np.unique(x[10:])])  # similarity 70 of 90
        equal = int((a == b).sum())
        met, shared = met + (equal > 0), shared + equal
    assert met == 300 and abs(shared / 300 / simhash.BANDS - (7 / 9) ** simhash.ROWS) < 0.03
    one, none, two = simhash.band_keys([x, x[:0], x])
    assert (one == two).all() and len(none) == 0


def test_large_group_about_one_text_and_its_outliers(spark, monkeypatch):
    """Copies like one text but not like each other, in groups larger than those that are compared whole."""
    monkeypatch.setattr(simhash, "SMALL_GROUP", 8)
    rng = np.random.default_rng(15)
    base = [f"f{x}" for x in range(120)]
    rows = [(500, " ".join(base))]
    for i in range(200):
        now = list(base)
        for at in rng.choice(24, 2, replace=False):  # 10 of 116 shingles go: 0.84 with the base, 0.7 with others
            now[int(at) * 5] = f"e{i}"
        rows.append((i, " ".join(now)))
    rows += [(600 + i, " ".join(base[:60] + [f"g{i}x{j}" for j in range(40)])) for i in range(5)]
    got = dict(simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    sets = {i: set(simhash.shingle_set(t).tolist()) for i, t in rows}
    alike = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    assert sum(alike(i, i + 1) for i in range(199)) < 40
    assert got == {i: (0 if i <= 500 else i) for i, _ in rows} and all(alike(i, 500) for i in range(200))


def test_links_between_texts_that_are_no_hubs(spark, monkeypatch):
    """Chains whose texts are like their neighbours only, all in large groups that many blocks hold."""
    rng = np.random.default_rng(16)
    rows = []
    base = [f"b{x}" for x in range(100)]
    for chain in range(12):
        now = base[:70] + [f"c{chain}x{j}" for j in range(30)]
        for step in range(25):
            rows.append((len(rows), " ".join(now)))
            for at in rng.choice(20, 2, replace=False):
                now[int(at) * 5] = f"s{chain}x{step}x{at}"
    ids = rng.permutation(len(rows)).tolist()
    rows = [(ids[i], t) for i, t in rows]
    sets = {i: set(simhash.shingle_set(t).tolist()) for i, t in rows}
    best = {i: i for i, _ in rows}
    links = [(i, j) for i in best for j in best if i < j and len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j])]
    for _ in range(len(rows)):
        before = dict(best)
        for i, j in links:
            best[i] = best[j] = min(best[i], best[j])
        if best == before:
            break
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(set(best.values())) > 1
    for texts in (4096, 16):
        with monkeypatch.context() as m:
            m.setattr(simhash, "SMALL_GROUP", 2)
            m.setattr(simhash, "BLOCK_TEXTS", texts)
            seen = []
            crossed = simhash.crossed
            m.setattr(simhash, "crossed", lambda large, *more: seen.append(large.agg({"many": "max"}).first()[0]) or crossed(large, *more))
            assert dict(simhash.near_copies(docs).collect()) == best
            assert seen and seen[0] > 16


def test_many_texts_of_one_id_one_without_words(spark):
    """In a group of over SMALL_GROUP texts an id has a text without words too, others have repeated rows and several texts."""
    base = [f"w{x}" for x in range(100)]
    near = lambda i, j: " ".join(base[:-2] + [f"n{i}", f"m{j}"])
    rows = [(i, near(i, 0)) for i in range(10, 110)] + [(200, ""), (109, " "), (109, "")]
    rows += [(50, near(50, j)) for j in range(5)] + [(60, near(60, 0))] * 20
    rows += [(70, " ".join(f"x{i}" for i in range(50))), (300, " ".join(f"x{i}" for i in range(50)) + " y"), (301, "alone in the world")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        got = simhash.near_copies(docs)
        assert dict(got.collect()) == {i: 301 if i == 301 else 10 for i, _ in rows} and got.count() == len(rows)
    sets = simhash.shingle_sets(docs.orderBy("doc_id")).groupBy("doc_id").count()
    assert {i: n for i, n in sets.collect() if n > 1} == {50: 5, 70: 2}


def test_stage_searches_trees_of_simhashes(monkeypatch):
    """The stage's candidates come from BK-trees with the wide radius; one tree, and two blocks' trees, give the links of all pairs."""
    rng = np.random.default_rng(17)
    sets = [x for x in simhash.sets_of(near_texts(rng)) if len(x)]
    sets = list({x.tobytes(): x for x in sets}.values())
    fps = [simhash.majority([x]) for x in sets]
    ids = list(range(len(sets)))

    def parts(links):
        forest = simhash.Forest()
        for a, b in links:
            forest.join(a, b)
        return [forest.find(i) for i in ids]

    want = parts((i, j) for i in ids for j in range(i) if len(np.intersect1d(sets[i], sets[j])) * 5 >= 4 * len(np.union1d(sets[i], sets[j])))
    radii, tree = [], simhash.BKTree
    monkeypatch.setattr(simhash, "BKTree", lambda forest, radius, confirm: radii.append(radius) or tree(forest, radius, confirm))
    one = list(simhash.searched(ids, fps, sets, ids, [0] * len(ids), 0, 0))
    assert parts(one) == want and len(one) == len(ids) - len(set(want))
    block, found = [i % 2 for i in ids], []
    for b in (0, 1):
        own = [i for i in ids if block[i] == b]
        found += simhash.searched(own, [fps[i] for i in own], [sets[i] for i in own], own, [b] * len(own), b, b)
    roots = parts(found)
    more = list(simhash.searched(ids, fps, sets, roots, block, 0, 1))
    assert more and parts(found + more) == want and len(found + more) == len(one)
    assert radii == [simhash.WIDE_RADIUS] * 4


def test_alike_counts_whole_sets():
    rng = np.random.default_rng(18)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 40, rng.integers(0, 60)).astype(np.uint64)) for _ in range(2))
        assert simhash.alike(x, y) == (len(np.intersect1d(x, y)) * 5 >= 4 * len(np.union1d(x, y)))
    assert simhash.alike(x[:0], x[:0])


def test_majorities_of_many_sets(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(n % 2) for n in (0, 1, 2, 254, 255, 256, 510, 511, 5000, 0, 1 << 15, 3)]
    wanted = [simhash.majority([x]) for x in sets]
    assert simhash.majorities(sets).tolist() == wanted and not len(simhash.majorities([]))
    monkeypatch.setattr(simhash, "STRIDE", 400)
    assert simhash.majorities(sets).tolist() == wanted


def test_overlaps_with_marked_shingles():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (1, 40, 80, 120, 160, 200, 200, 300)]
    overlaps = simhash.Overlaps(sets)
    pairs = [(i, j) for i in (0, 5, 3, 5, 7, 6) for j in range(len(sets))]
    got = [overlaps.alike(i, j) for i, j in pairs]
    assert got == [simhash.alike(sets[i], sets[j]) for i, j in pairs] and 0 < sum(got) < len(got)
