"""Quality classifier: random-indexing word vectors, a two-layer network, calibrated scores (operator 3).

Each word bucket has a sparse random index vector. A word's vector is its own index vector plus what
the words about it contributed in the training sample. A document pools its words' vectors (mean,
spread) and those of the words' shapes; shapes catch letters, digits, marks and repeats. A two-layer
network in numpy gives a logit; a temperature, fitted on rows kept from its training, calibrates it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.bpe import small_batches
from quillon.llm.common import Scratch, hash_fraction, held_out, id_text, quiet_threads, small_arrow_batches

BUCKETS = 1 << 14
WIDTH = 48
NONZERO = 6
HIDDEN = 48
EPOCHS = 40
#: Bound of the labelled sample, in expectation; its members have the least hash of doc_id.
SAMPLE_ROWS = 12_000
SAMPLE_TASKS = 8
CONTEXT = 2
#: Words whose contexts are summed at once.
CONTEXT_RUN = 1 << 15
THRESHOLD = 0.3
SHAPE = np.zeros(256, np.uint8)
for _b in range(256):  # 0 mark, 1 lower case, 2 upper case, 3 digit, 4 beyond ASCII
    SHAPE[_b] = 1 if 97 <= _b <= 122 else 2 if 65 <= _b <= 90 else 3 if 48 <= _b <= 57 else 4 if _b > 127 else 0
SHAPE_TABLE = bytes(b"paANu"[x] for x in SHAPE)
FEATURES = 2 * WIDTH + WIDTH + 4


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(7)
    out = np.zeros((BUCKETS, WIDTH), np.float32)
    for _ in range(NONZERO):
        out[np.arange(BUCKETS), rng.integers(0, WIDTH, BUCKETS)] += rng.integers(0, 2, BUCKETS) * 2 - 1
    return out


INDEX = index_vectors()


def word_buckets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the lower-cased words and of their shapes; a word like the one before has the shape 'again'."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    shapes = [b"again" if a == b else s[:1] + s[-3:] for a, b, s in zip(words, [b"", *words], raw.translate(SHAPE_TABLE_SPLIT).split())]
    mask = BUCKETS - 1
    return np.fromiter((crc32(w) & mask for w in words), np.int64, len(words)), np.fromiter((crc32(s, 1) & mask for s in shapes), np.int64, len(shapes))


#: Shapes of all bytes but white space, which still splits.
SHAPE_TABLE_SPLIT = bytes(b if b in b" \t\n\x0b\f\r" else SHAPE_TABLE[b] for b in range(256))


def pooled(text: str, vectors: np.ndarray) -> np.ndarray:
    """The features of a whole text; words are taken in runs, so that memory stays bounded. No words: zeros."""
    out = np.zeros(FEATURES)
    words, shapes = word_buckets(text)
    n = len(words)
    if not n:
        return out
    total, square, shape = np.zeros(WIDTH), np.zeros(WIDTH), np.zeros(WIDTH)
    for at in range(0, n, 1 << 12):
        some = vectors[words[at : at + (1 << 12)]]
        total += some.sum(0, dtype=np.float64)
        square += (some * some).sum(0, dtype=np.float64)
        shape += INDEX[shapes[at : at + (1 << 12)]].sum(0, dtype=np.float64)
    mean = total / n
    out[:WIDTH], out[WIDTH : 2 * WIDTH], out[2 * WIDTH : 3 * WIDTH] = mean, np.sqrt(np.maximum(square / n - mean * mean, 0)), shape / n
    distinct = len(np.unique(words))
    out[3 * WIDTH :] = np.log1p(n), np.log1p(distinct) - np.log1p(n), len(text) / n / 10, np.log1p(len(text))
    return out


@dataclass
class Classifier:
    vectors: np.ndarray
    middle: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(np.clip((x - self.middle) / self.spread, -8, 8) @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.stack([pooled(t, self.vectors) for t in texts]) if texts else np.zeros((0, FEATURES))
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def log_loss(logit: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logit) - y * logit))


def fit(x: np.ndarray, y: np.ndarray, vectors: np.ndarray) -> Classifier:
    """Train by Adam on four fifths of the rows; fit the temperature on the rest."""
    rng = np.random.default_rng(11)
    order = rng.permutation(len(x))
    cut = max(1, len(x) // 5) if len(x) >= 10 else 0
    kept, used = order[:cut], order[cut:]
    middle, spread = x[used].mean(0), x[used].std(0) + 1e-3
    z = np.clip((x - middle) / spread, -8, 8)
    p = [rng.normal(0, np.sqrt(2 / FEATURES), (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    share = np.clip(y[used].mean(), 0.01, 0.99)
    p[3][0] = np.log(share / (1 - share))
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        rng.shuffle(used)
        for at in range(0, len(used), 128):
            some = used[at : at + 128]
            a = z[some] @ p[0] + p[1]
            h = np.maximum(a, 0)
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[some]) / len(some)
            back = np.outer(d, p[2]) * (a > 0)
            grads = [z[some].T @ back + 1e-4 * p[0], back.sum(0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= 2e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    model = Classifier(vectors, middle, spread, p[0], p[1], p[2], float(p[3][0]))
    if cut:
        logit = model.logits(x[kept])
        model.temperature = float(min(np.geomspace(0.25, 8, 64), key=lambda t: log_loss(logit / t, y[kept])))
    return model


def add_contexts(sums: np.ndarray, words: np.ndarray) -> None:
    """Add to each word's row the index vectors of the words within CONTEXT places. BUCKETS stands for no word."""
    for gap in range(1, CONTEXT + 1):
        for at in range(0, len(words) - gap, CONTEXT_RUN):
            near, far = words[at : at + CONTEXT_RUN][: len(words) - gap - at], words[at + gap : at + gap + CONTEXT_RUN]
            real = (near < BUCKETS) & (far < BUCKETS)
            for a, b in ((near[real], far[real]), (far[real], near[real])):
                if len(a):
                    order = np.argsort(a, kind="stable")
                    a = a[order]
                    first = np.flatnonzero(np.diff(a, prepend=-1))
                    sums[a[first]] += np.add.reduceat(INDEX[b[order]], first)


def labelled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """text and quality (0 or 1) of a sample of about rows labelled documents that are not held out."""
    marks = labels.select(F.col("doc_id").cast("long").alias("marked"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & ~held_out(F.col("marked")))
    marks = marks.groupBy("marked").agg(F.min("quality").alias("quality"))
    n = marks.count()
    marks = marks.where(hash_fraction(F.col("marked"), "quality sample") < min(1.0, rows / max(n, 1)))
    # The marks are broadcast: about rows of them, whatever the tables' size. So no text is shuffled.
    return id_text(docs).join(F.broadcast(marks), F.col("doc_id") == F.col("marked")).select("text", "quality")


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Classifier | None:
    """The classifier, from a bounded sample. None: no labelled document.

    The documents are read once, by as many tasks as their scan has; what is kept of them is written,
    and few tasks read that.
    """
    with Scratch(docs.sparkSession) as scratch:
        return learn_from(scratch.written(labelled(docs, labels, rows), "quality-sample").coalesce(SAMPLE_TASKS))


def learn_from(sample: DataFrame) -> Classifier | None:
    """The classifier of a sample's text and quality, read twice: for the words' contexts and for the features."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quiet_threads()
        sums, held, size = np.zeros((BUCKETS, WIDTH), np.float32), [], 0
        edge = np.full(CONTEXT, BUCKETS)  # between documents: no word
        for batch in batches:
            for text in batch.column(0):
                held += [word_buckets(text.as_py() or "")[0], edge]
                size += len(held[-2])
                if size >= CONTEXT_RUN:
                    add_contexts(sums, np.concatenate(held))
                    held, size = [], 0
        if held:
            add_contexts(sums, np.concatenate(held))
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])

    vectors = np.zeros((BUCKETS, WIDTH), np.float32)
    for row in sample.mapInArrow(contexts, "sums binary").collect():  # SAMPLE_TASKS rows at most
        vectors += np.frombuffer(row.sums, np.float32).reshape(BUCKETS, WIDTH)
    length = np.sqrt((vectors * vectors).sum(1, keepdims=True))
    vectors = (INDEX / np.sqrt(NONZERO) + vectors / np.maximum(length, 1e-6)).astype(np.float32)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quiet_threads()
        for batch in batches:
            x = [pooled(t.as_py() or "", vectors).astype(np.float32).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column(1)], ["x", "quality"])

    found = sorted((bytes(r.x), r.quality) for r in sample.mapInArrow(features, "x binary, quality int").collect())  # about rows of them
    if not found:
        return None
    x = np.frombuffer(b"".join(f for f, _ in found), np.float32).reshape(-1, FEATURES).astype(np.float64)
    return fit(x, np.array([q for _, q in found], np.float64), vectors)


def scores(docs: DataFrame, model: Classifier | None) -> DataFrame:
    """doc_id and score of every row, from its whole text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quiet_threads()
        for doc_ids, texts in small_batches(batches):
            score = model.score(texts) if model else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(score, pa.float64())], ["doc_id", "score"])

    return id_text(docs).mapInArrow(run, "doc_id long, score double")


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels, then score all documents: doc_id, held_out, score, predicted.

    Null and empty texts have the score of no words. Without labelled documents every score is 0.5.
    Equal texts get equal scores; rows are not merged. Where a document has several labels the
    smallest counts. A null doc_id is held out.
    """
    out = scores(docs, learn(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Classifier | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all columns, whose whole text scores threshold or more. No shuffle."""
    at = docs.columns.index("text")
    small_arrow_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quiet_threads()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                keep = model.score([x or "" for x in part.column(at).to_pylist()]) >= threshold if model else [True] * len(part)
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
