"""Language identification with hyperdimensional profiles (operator 1).

Every letter has a random vector of +1 and -1. An n-gram binds its letters' vectors, each permuted
(rotated) by its place, by products; a document bundles its n-grams by a sum. A language's
prototype is the sum of its training documents' unit vectors, less what all languages share. A
document gets the language whose prototype has the largest cosine with it. What cosine a document
must have to be accepted is learned as well: a low quantile of training documents' own, by language
and by how many different n-grams a text has, since short texts have lower cosines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.bpe import chunks, small_batches
from quillon.llm.common import Scratch, hash_fraction, held_out, id_text, quiet_threads, small_arrow_batches

DIMENSIONS = 512
GRAM = 3
#: Bounds of the training sample: about this many documents of each language, chosen by a hash of doc_id,
SAMPLE_PER_LANGUAGE = 4000
#: and of all languages together; of values of lang only the most frequent are learned, this many at most.
SAMPLE_ROWS, MOST_LANGUAGES = 64_000, 512
UNKNOWN = "und"
ROWS = 64
#: Different n-grams of a run of texts whose vectors are held at once.
SLICE = 1 << 13
#: A document of less likeness to every language is rejected by accepted(), whatever was learned.
MIN_SCORE = 0.02
#: Share of the training texts of a language and size that the learned least likeness would reject.
REJECTED = 0.005
#: Fewer training texts of a size teach no least likeness.
ENOUGH = 50
#: Code points of the pieces of training documents that stand for short texts.
PIECES = (8, 16, 32, 64, 128)
#: Classes of size, by powers of two of different n-grams, and steps of likeness from -1 to 1.
SIZES, STEPS = 12, 400


@lru_cache(1)
def folded() -> np.ndarray:
    """Lower-case letter of each code point below 0x40000, 0 where it is no letter."""
    out = np.zeros(0x40000, np.uint32)
    for cp in range(0x40000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low[0])
    return out


@lru_cache(4096)
def letter_vector(cp: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(key=cp + 1)).integers(0, 2, DIMENSIONS, dtype=np.int8) * np.int8(2) - np.int8(1)


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """Bound vectors of rows of GRAM code points (0: a gap between words)."""
    letters, place = np.unique(grams, return_inverse=True)
    base = np.stack([letter_vector(int(c)) for c in letters])
    place = place.reshape(grams.shape)
    out = base[place[:, -1]]
    for j in range(GRAM - 1):
        out = out * np.roll(base, GRAM - 1 - j, axis=1)[place[:, j]]
    return out.astype(np.float32)


class GramMemory:
    """Vectors of at most LIMIT n-grams seen by this worker; emptied when more come."""

    LIMIT = 60_000

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.row: dict[int, int] = {}
        self.vectors = np.zeros((1024, DIMENSIONS), np.float32)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Rows of self.vectors for distinct n-gram keys, SLICE at most."""
        missing = [k for k in keys.tolist() if k not in self.row]
        if len(self.row) + len(missing) > self.LIMIT:
            self.clear()
            missing = keys.tolist()
        if missing:
            wanted = np.array(missing, np.uint64)
            grams = np.stack([(wanted >> np.uint64(21 * (GRAM - 1 - j))) & np.uint64(0x1FFFFF) for j in range(GRAM)], 1)
            first = len(self.row)
            if first + len(missing) > len(self.vectors):
                grown = np.zeros((min(2 * (first + len(missing)), self.LIMIT), DIMENSIONS), np.float32)
                grown[:first] = self.vectors[:first]
                self.vectors = grown
            self.vectors[first : first + len(missing)] = gram_vectors(grams)
            self.row.update(zip(missing, range(first, first + len(missing))))
        return np.fromiter(map(self.row.__getitem__, keys.tolist()), np.int64, len(keys))


@lru_cache(1)
def gram_memory() -> GramMemory:
    return GramMemory()


def bundles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A bundle for each text, whether it has letters, and its class of size. Whole texts; memory follows the longest."""
    out, lettered, kinds = np.zeros((len(texts), DIMENSIONS), np.float32), np.zeros(len(texts), bool), np.zeros(len(texts), np.int64)
    at = 0
    for run in chunks(texts):
        for lo in range(0, len(run), ROWS):
            some = run[lo : lo + ROWS]
            _bundle(some, out[at : at + len(some)], lettered[at : at + len(some)], kinds[at : at + len(some)])
            at += len(some)
    return out, lettered, np.minimum(np.frexp(kinds)[1], SIZES - 1)


def _bundle(texts: list[str], out: np.ndarray, lettered: np.ndarray, kinds: np.ndarray) -> None:
    joined = "".join(f"\n{x}\n" for x in texts)
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(x) + 2 for x in texts])
    small = cps < 0x40000
    codes = np.where(small, folded()[np.where(small, cps, 0)], 0)
    lettered |= np.bincount(owner, codes > 0, len(texts)) > 0
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0) | (owner[1:] != owner[:-1])  # one gap for a run of gaps
    codes, owner = codes[keep].astype(np.uint64), owner[keep]
    if len(codes) < GRAM:
        return
    keys = codes[: len(codes) - GRAM + 1].copy()
    for j in range(1, GRAM):
        keys = keys << np.uint64(21) | codes[j : len(codes) - GRAM + 1 + j]
    whole = owner[: len(keys)] == owner[GRAM - 1 :]
    keys, owner = keys[whole], owner[: len(whole)][whole]
    if not len(keys):
        return
    distinct, place = np.unique(keys, return_inverse=True)
    memory = gram_memory()
    if len(distinct) > SLICE:
        order = np.argsort(place, kind="stable")
        place, owner = place[order], owner[order]
    for first in range(0, len(distinct), SLICE):
        some = distinct[first : first + SLICE]
        a, b = (0, len(place)) if len(distinct) <= SLICE else np.searchsorted(place, (first, first + len(some)))
        counts = np.bincount(owner[a:b] * len(some) + (place[a:b] - first), minlength=len(texts) * len(some)).astype(np.float32).reshape(len(texts), -1)
        kinds += np.count_nonzero(counts, axis=1)
        rows = memory.rows(some)
        out += counts @ memory.vectors[rows]


def unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x.astype(np.float64) ** 2).sum(-1, keepdims=True))
    return x / np.maximum(length, 1e-12)


@dataclass
class Profiles:
    languages: list[str]
    prototypes: np.ndarray  # unit rows
    shared: np.ndarray  # what is taken from each unit bundle first
    least: np.ndarray | None = None  # likeness to be accepted, by language and class of size

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, score, _ = self.judge(texts)
        return names, score

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language and score of each text, and whether it is as like that language as texts of it are."""
        vectors, lettered, sizes = bundles(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        near = unit(unit(vectors) - self.shared) @ self.prototypes.T
        best = near.argmax(1)
        score = np.clip(near[np.arange(len(texts)), best], 0, 1)
        names = [self.languages[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), lettered.tolist())]
        like = lettered if self.least is None else lettered & (score >= self.least[best, sizes])
        return names, np.where(lettered, score, 0.0), like


def learn(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Profiles:
    """Prototypes from text and non-null lang of documents that are not held out.

    The sample is bounded by per_language for each language and SAMPLE_ROWS for all (in expectation),
    whatever the table's size and however uneven the languages: its members are those of least hash of
    doc_id. Of values of lang the MOST_LANGUAGES most frequent count, of equally frequent ones those that
    come first in order. The documents are read once for the counts of lang and once for the sample,
    which is written and read twice. Sums are made in the tasks; a row for each task and language comes
    to the driver's aggregate.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # MOST_LANGUAGES rows at most, on the driver and in the broadcast.
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not counts:
        return Profiles([], np.zeros((0, DIMENSIONS)), np.zeros(DIMENSIONS))
    wanted = min(per_language, SAMPLE_ROWS / len(counts))
    shares = docs.sparkSession.createDataFrame([(r.lang, min(1.0, wanted / r.n)) for r in counts], "known string, share double")
    sample = rows.join(F.broadcast(shares), F.col("lang") == F.col("known")).where(hash_fraction(F.col("doc_id"), "language sample") < F.col("share")).select("text", "lang")
    with Scratch(docs.sparkSession) as scratch:
        return learn_from(scratch.written(sample, "language-sample"))


def learn_from(sample: DataFrame) -> Profiles:
    """Prototypes and least likeness of a sample's text and lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quiet_threads()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                vectors, lettered, _ = bundles([x or "" for x in part.column(0).to_pylist()])
                vectors, langs = unit(vectors), np.array(part.column(1).to_pylist(), object)
                for lang in set(langs.tolist()):
                    mine = (langs == lang) & lettered
                    sums[lang] = sums.get(lang, 0) + np.append(vectors[mine].sum(0), mine.sum())
        names = list(sums)
        flat = np.concatenate([sums[x] for x in names]) if names else np.zeros(0)
        place = np.tile(np.arange(DIMENSIONS + 1), len(names))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, object), DIMENSIONS + 1), pa.string()), pa.array(place, pa.int32()), pa.array(flat, pa.float64())], ["lang", "place", "value"])

    sums = sample.mapInArrow(run, "lang string, place int, value double").groupBy("lang", "place").agg(F.sum("value").alias("value")).collect()
    languages = sorted({r.lang for r in sums})
    grid = np.zeros((len(languages), DIMENSIONS + 1))
    for r in sums:
        grid[languages.index(r.lang), r.place] = r.value
    good = grid[:, -1] > 0
    languages, grid = [x for x, ok in zip(languages, good) if ok], grid[good]
    means = grid[:, :-1] / grid[:, -1:]
    shared = means.mean(0) if len(languages) > 1 else np.zeros(DIMENSIONS)
    profiles = Profiles(languages, unit(means - shared), shared)
    profiles.least = calibrated(sample, profiles, means, grid[:, -1])
    return profiles


def calibrated(sample: DataFrame, profiles: Profiles, means: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Least likeness by language and class of size, from the sample's texts and pieces of them.

    A text's likeness is taken to prototypes without it. Where a language has too few texts of a
    size, all languages' count; where these are too few, what the next smaller size asks, which is
    less, and MIN_SCORE below all sizes.
    """
    total = len(profiles.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quiet_threads()
        seen = np.zeros((total, SIZES, STEPS), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                pairs = [(x, profiles.languages.index(y)) for x, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if y in profiles.languages]
                texts, own = [x for x, _ in pairs], np.array([y for _, y in pairs], np.int64)
                whole, lettered, sizes = bundles(texts)
                whole = unit(whole)
                n = counts[own][:, None]
                mean = (means[own] * n - whole) / np.maximum(n - 1, 1)
                shared = profiles.shared + (mean - means[own]) / total if total > 1 else np.zeros((len(texts), DIMENSIONS))
                prototype, known = unit(mean - shared), n[:, 0] > 1
                for length in (None, *PIECES):
                    if length is None:
                        vectors, ok, kinds = whole, lettered & known, sizes
                    else:
                        # From the middle: what begins texts of one collection is often the same.
                        vectors, ok, kinds = bundles([x[len(x) // 2 : len(x) // 2 + length] for x in texts])
                        vectors, ok = unit(vectors), ok & known & (np.array(list(map(len, texts)), np.int64) > length)
                    near = (unit(vectors - shared) * prototype).sum(1)
                    step = np.clip((near + 1) / 2 * STEPS, 0, STEPS - 1).astype(np.int64)
                    np.add.at(seen, (own[ok], kinds[ok], step[ok]), 1)
        place = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(seen.ravel()[place], pa.int64())], ["place", "n"])

    seen = np.zeros(total * SIZES * STEPS, np.int64)
    for r in sample.mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        seen[r.place] = r.n
    seen = seen.reshape(total, SIZES, STEPS)
    seen = np.where(seen.sum(2, keepdims=True) >= ENOUGH, seen, seen.sum(0))
    amount = seen.sum(2)
    step = (seen.cumsum(2) <= REJECTED * amount[..., None]).sum(2)  # the step that holds the quantile
    least = np.where(amount >= ENOUGH, np.maximum(step / STEPS * 2 - 1, MIN_SCORE), 0)
    for size in range(1, SIZES):
        least[:, size] = np.where(amount[:, size] >= ENOUGH, least[:, size], least[:, size - 1])
    return np.maximum(least, MIN_SCORE)


def predictions(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score of every row, from its whole text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quiet_threads()
        for doc_ids, texts in small_batches(batches):
            names, score = profiles.predict(texts)
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return id_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame) -> DataFrame:
    """Learn from docs, then predict all of them: doc_id, held_out, lang_pred, score.

    Null text, empty text and text without letters: lang_pred 'und', score 0. With no labelled
    document all are 'und'. Equal texts get equal predictions; rows are not merged. A null doc_id
    is held out.
    """
    return predictions(docs, learn(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, profiles: Profiles, least: float = MIN_SCORE) -> DataFrame:
    """The rows of docs, with all columns, that have letters and likeness to some language.

    A text is like a language if its cosine is one that texts of that language and size have (calibrated()),
    and least at least. No shuffle.
    """
    at = docs.columns.index("text")
    small_arrow_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quiet_threads()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                names, score, like = profiles.judge([x or "" for x in part.column(at).to_pylist()])
                keep = [name != UNKNOWN and s >= least and ok for name, s, ok in zip(names, score.tolist(), like.tolist())]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
