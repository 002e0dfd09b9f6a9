"""Language identification and quality classification."""

import numpy as np
import pytest

from quillon.llm import language_id, quality


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_languages_of_held_out_documents(tables):
    docs, _ = tables
    got = language_id.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_held_out_languages_are_not_used(tables, spark):
    from pyspark.sql import functions as F

    from quillon.llm.common import held_out

    docs, _ = tables
    wrong = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert "xx" not in language_id.learn(wrong).languages


def test_binding_keeps_places_apart():
    v = language_id.gram_vectors(np.array([[97, 98, 99], [99, 98, 97], [97, 98, 99]]))
    assert (v[0] == v[2]).all() and abs((v[0] * v[1]).mean()) < 0.2 and set(np.unique(v)) == {-1, 1}


def test_language_on_odd_rows(odd, none, odd_rows):
    got = language_id.identified(odd).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        if r.doc_id in (8, 9, 10, 11):
            assert (r.lang_pred, r.score) == ("und", 0)
    assert next(r for r in got if r.doc_id == 14).lang_pred in ("en", "fr", "de", "es")
    assert language_id.identified(none).count() == 0
    kept = language_id.accepted(odd, language_id.learn(odd))
    assert kept.columns == odd.columns and not {8, 9, 10, 11} & {r.doc_id for r in kept.collect()}


def test_texts_like_no_language_are_rejected(tables, spark):
    import random

    docs, labels = tables
    profiles = language_id.learn(docs)
    rng = random.Random(7)
    letters = {"latin": (97, 122), "cyrillic": (0x430, 0x44F), "greek": (0x3B1, 0x3C9), "arabic": (0x627, 0x64A), "cjk": (0x4E00, 0x9FA5)}
    word = lambda a, b: "".join(chr(rng.randint(a, b)) for _ in range(rng.randint(2, 9)))
    rows = [(name, size, " ".join(word(*span) for _ in range(size))) for name, span in letters.items() for size in (30, 300) for _ in range(40)]
    strange = spark.createDataFrame(rows, "script string, size int, text string")
    kept = [tuple(r) for r in language_id.accepted(strange, profiles).groupBy("script", "size").count().collect()]
    assert all(n <= 2 for _, _, n in kept), kept
    clean = docs.join(labels.where("quality = 1"), "doc_id").select("doc_id", "text")
    assert language_id.accepted(clean, profiles).count() >= 0.98 * clean.count()
    short = clean.selectExpr("doc_id", "substring(text, 101, 40) AS text").where("length(text) = 40")
    assert language_id.accepted(short, profiles).count() >= 0.95 * short.count()


def test_quality_of_held_out_documents(tables):
    docs, labels = tables
    got = quality.classified(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    good, poor = held.score[held.quality == 1].to_numpy(), held.score[held.quality == 0].to_numpy()
    assert (good[:, None] > poor[None]).mean() > 0.95 and (held.predicted == held.quality).mean() > 0.95


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, quality.FEATURES))
    y = (x[:, 0] + rng.normal(size=600) > 0).astype(float)
    model = quality.fit(x, y, quality.INDEX)
    assert quality.log_loss(model.logits(x) / model.temperature, y) < 0.7


def test_quality_on_odd_rows(spark, odd, none, odd_rows):
    labels = spark.createDataFrame([(5, 1), (6, 0), (6, 1), (None, 1), (7, None), (12, 3), (101, 1)], "doc_id long, quality int")
    got = quality.classified(odd, labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    same = {r.doc_id: r.score for r in got}
    assert same[8] == same[9] == same[10] and same[5] == same[6]
    assert quality.classified(none, labels).count() == 0
    assert {r.score for r in quality.classified(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.accepted(odd, None).columns == odd.columns


def brute_bundle(text):
    """The sum of the n-grams' vectors, letter by letter."""
    codes = [0]
    for c in text:
        code = ord(c.lower()[0]) if ord(c) < 0x40000 and c.isalpha() else 0
        if code or codes[-1]:
            codes.append(code)
    if codes[-1]:
        codes.append(0)
    total = np.zeros(language_id.DIMENSIONS)
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        x, y, z = (language_id.letter_vector(k).astype(int) for k in (a, b, c))
        total += [x[i - 2] * y[i - 1] * z[i] for i in range(len(x))]
    return total


SENTENCES = {
    "en": "the quick brown fox jumps over the lazy dog and then it sleeps under that old tree",
    "de": "der schnelle braune Fuchs springt über den faulen Hund und dann schläft er unter jenem Baum",
    "fr": "le vif renard brun saute par-dessus le chien paresseux puis il dort sous cet arbre-là",
}


def test_languages_by_brute_force(spark, monkeypatch):
    import zlib

    rows = [(i, " ".join(x.split()[(i * 3 + j) % 12] for j in range(9)) + (" É1x!" * (i % 2)), lang) for i, (lang, x) in enumerate(list(SENTENCES.items()) * 12)]
    rows += [(100, "  ", "en"), (101, None, "de"), (102, "ABC abc", None)]
    got = {r.doc_id: r for r in language_id.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    unit = lambda v: np.array(v) / max(sum(x * x for x in v) ** 0.5, 1e-12)
    sums = {lang: [] for lang in SENTENCES}
    for i, text, lang in rows:
        if lang and text and any(map(str.isalpha, text)) and zlib.crc32(str(i).encode()) % 5:
            sums[lang].append(unit(brute_bundle(text)))
    names = sorted(sums)
    means = [np.mean(sums[x], axis=0) for x in names]
    shared = np.mean(means, axis=0)
    for i, text, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        if not text or not any(map(str.isalpha, text)):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        near = [float(unit(unit(brute_bundle(text)) - shared) @ unit(m - shared)) for m in means]
        best = int(np.argmax(near))
        assert got[i].lang_pred == names[best] and abs(got[i].score - min(max(near[best], 0), 1)) < 1e-4


def test_slices_of_n_grams_do_not_matter(monkeypatch):
    texts = [*SENTENCES.values(), "".join(map(chr, np.random.default_rng(4).integers(0x4E00, 0x9FA5, 3000)))]
    whole, _, sizes = language_id.bundles(texts)
    monkeypatch.setattr(language_id, "SLICE", 100)
    monkeypatch.setattr(language_id.GramMemory, "LIMIT", 250)
    language_id.gram_memory.cache_clear()
    some, _, same = language_id.bundles(texts)
    language_id.gram_memory.cache_clear()
    assert (whole == some).all() and (sizes == same).all()
    assert all((brute_bundle(t) == v).all() for t, v in zip(texts, whole))


def test_memory_of_a_long_text_of_many_letters():
    import tracemalloc

    text = "".join(map(chr, np.random.default_rng(5).integers(0x4E00, 0x9FA5, 600_000)))
    language_id.folded()
    tracemalloc.start()
    language_id.bundles([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 << 20


def test_sample_is_bounded_for_many_values_of_lang(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 3)
    monkeypatch.setattr(language_id, "SAMPLE_ROWS", 60)
    rows = [(i, list(SENTENCES.values())[i % 3], list(SENTENCES)[i % 3]) for i in range(600)] + [(1000 + i, "etwas", f"dirt {i}") for i in range(50)]
    seen = []
    monkeypatch.setattr(language_id, "learn_from", lambda sample: seen.append(sample.count()) or sample.select("lang").distinct().collect())
    assert {r.lang for r in language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))} <= set(SENTENCES)
    assert 20 < seen[0] < 130


def test_quality_by_brute_force(spark):
    """Contexts, pooling and the network's scores, one word and one number at a time."""
    import zlib

    rng = np.random.default_rng(6)
    pool = "the a river Stone 12 runs, under over! bridge of old Éa and".split()
    rows = [(i, " ".join(rng.choice(pool, 12)) if i % 2 else "BUY 99 BUY 99 !!! " * 3) for i in range(60)] + [(70, None), (71, "  ")]
    labels = [(i, i % 2) for i in range(60)]
    got = {r.doc_id: r.score for r in quality.classified(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    bucket = lambda w: zlib.crc32(w) % quality.BUCKETS
    words = {i: (t or "").encode().lower().split() for i, t in rows}
    sums = np.zeros((quality.BUCKETS, quality.WIDTH))
    train = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5]
    for i in train:
        for a, w in enumerate(words[i]):
            for b, v in enumerate(words[i]):
                if 0 < abs(a - b) <= quality.CONTEXT:
                    sums[bucket(w)] += quality.INDEX[bucket(v)]
    vectors = [quality.INDEX[k] / quality.NONZERO**0.5 + sums[k] / max(np.linalg.norm(sums[k]), 1e-6) for k in range(quality.BUCKETS)]

    def shape(w):
        full = "".join("a" if c in b"abcdefghijklmnopqrstuvwxyz" else "A" if c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" else "N" if c in b"0123456789" else "u" if c > 127 else "p" for c in w)
        return (full[:1] + full[-3:]).encode()

    def features(text):
        raw = (text or "").encode().split()
        low = [w.lower() for w in raw]
        if not raw:
            return np.zeros(quality.FEATURES)
        shapes = [b"again" if k and low[k] == low[k - 1] else shape(w) for k, w in enumerate(raw)]
        v = np.array([vectors[bucket(w)] for w in low], float)
        s = np.array([quality.INDEX[zlib.crc32(x, 1) % quality.BUCKETS] for x in shapes], float)
        extra = [np.log1p(len(raw)), np.log1p(len({bucket(w) for w in low})) - np.log1p(len(raw)), len(text) / len(raw) / 10, np.log1p(len(text))]
        return np.concatenate([v.mean(0), v.std(0), s.mean(0), extra])

    by_id = dict(rows)
    pairs = sorted((features(by_id[i]).astype(np.float32).tobytes(), q) for i, q in labels if i in train)
    x = np.array([np.frombuffer(f, np.float32) for f, _ in pairs], float)
    model = quality.fit(x, np.array([q for _, q in pairs], float), np.array(vectors, np.float32))
    for i, text in rows:
        z = [min(max((a - m) / s, -8), 8) for a, m, s in zip(features(text), model.middle, model.spread)]
        hidden = [max(0.0, sum(a * w for a, w in zip(z, model.w1[:, k])) + model.b1[k]) for k in range(quality.HIDDEN)]
        logit = sum(h * w for h, w in zip(hidden, model.w2)) + model.b2
        assert abs(got[i] - 1 / (1 + np.exp(-logit / model.temperature))) < 0.02, i


def test_only_the_sample_is_read_by_few_tasks(tables, monkeypatch):
    docs, labels = tables
    seen = []
    monkeypatch.setattr(quality, "learn_from", lambda sample: seen.append((sample.inputFiles(), sample.count())))
    quality.learn(docs, labels, 50)
    files, n = seen[0]
    assert all("quality-sample" in f for f in files) and 20 < n < 100
