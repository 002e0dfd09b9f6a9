"""Every stage on its own input, against brute force."""

import re
from collections import Counter, defaultdict
from itertools import combinations

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quillon.llm import language_id, quality
from quillon.llm.common import written

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def states(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], D), "test-stage"))
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns_and_order(states):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language ID", "line dedup", "SimHash near-dedup", "best-fit packing"]
    assert all(s.columns == states[0].columns for s in states[:-1])


def rows(df, *columns):
    return {r.doc_id: r for r in df.select("doc_id", *columns).collect()}


def test_quality_stage(states, spark):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    assert ids(states[1]) == ids(quality.classified(states[0], labels).where("score >= 0.3"))


def test_language_stage(states):
    """Kept is what has a language and is as like it as its calibration asks, document by document."""
    profiles = language_id.learn(states[1])
    want = set()
    for doc_id, row in rows(states[1], "text").items():
        (name,), (score,) = profiles.predict([row.text or ""])
        size = language_id.bundles([row.text or ""])[2][0]
        if name != "und" and score >= profiles.least[profiles.languages.index(name), size]:
            want.add(doc_id)
    assert ids(states[2]) == want


def test_line_stage(states):
    strip = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    seen, before = {}, rows(states[2], "text")
    for doc_id in sorted(before):
        for line in (before[doc_id].text or "").split("\n"):
            seen.setdefault(strip(line), doc_id)
    kept = {d: "\n".join(x for x in (r.text or "").split("\n") if len(strip(x)) < 10 or seen[strip(x)] == d) for d, r in before.items()}
    after = rows(states[3], "text", "n_chars")
    assert {d: r.text for d, r in after.items()} == kept and all(r.n_chars == len(r.text) for r in after.values())


def test_near_duplicate_stage(states):
    """The smallest id of each group of Jaccard similarity 0.8 on five-word shingles, from all pairs."""
    texts = {d: re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "") for d, r in rows(states[3], "text").items()}
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t) for d, t in texts.items()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in words.items()}
    best = {d: d for d in sets}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    while any(best[a] != best[b] for a, b in links):
        for a, b in links:
            best[a] = best[b] = min(best[a], best[b])
    assert ids(states[4]) == set(best.values())


def test_packing_stage(states):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = {d: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for d, r in rows(states[4], "text").items()}
    packed, load, sources = defaultdict(list), Counter(), defaultdict(list)
    source = rows(states[4], "source")
    for r in states[5].collect():
        packed[r.doc_id].append((r.first_token, r.n_tokens))
        load[r.bin_id] += r.n_tokens
        sources[r.bin_id].append(source[r.doc_id].source)
    assert {d: sum(k for _, k in x) for d, x in packed.items()} == n and max(load.values()) <= 2048
    assert all(at == sum(k for _, k in sorted(x)[:i]) for x in packed.values() for i, (at, _) in enumerate(sorted(x)))
    assert all(len(x) == len(set(x)) for x in ([s for s in found if s is not None] for found in sources.values()))


def test_run_is_all_stages(states, spark):
    assert sorted(map(tuple, corpus_pipeline.run(spark, D).collect())) == sorted(map(tuple, states[5].collect()))


def test_clean_documents_stay(states, spark):
    good = spark.read.parquet(f"{D}/labels.parquet").where("quality = 1").select("doc_id")
    assert len(ids(good) - ids(states[2])) <= 0.02 * len(ids(good))


def test_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            before, docs = docs.columns, written(stage(spark, docs, D), "odd-stage")
            assert docs.columns == before or "bin_id" in docs.columns
