"""Quality classifier: random-indexing word vectors, mean-pooled, then a two-layer numpy network.

Words are hashed into a fixed number of slots. A slot's vector is its sparse ternary index vector
plus the direction of the summed index vectors of its neighbours in the training sample. A document
is the mean vector of its tokens; a network with one hidden layer scores it, and a temperature fitted
on a calibration fold makes the scores probabilities. The model's size is a constant, so it can be
broadcast; scoring is one map over the scan.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, read

#: Slots and dimensions of the word vectors, nonzeros of an index vector, neighbours on either side.
SLOTS, DIMS, NONZERO, WINDOW = 1 << 15, 64, 4, 2
HIDDEN, EPOCHS, SEED = 32, 300, 20
#: Bounds of the labelled sample: rows, and characters of a text that may be learned from.
SAMPLE_ROWS, SAMPLE_CHARS = 8_000, 200_000
#: A score from here on predicts label 1.
THRESHOLD = 0.7

_PIECE = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
#: Slots below this stand for shapes of words.
SHAPES = 64
#: Slots that stand for a word equal to the one before it, and to the one before that.
REPEATS = ("\x32", "\x33")


def _slots(word: str) -> str:
    """The slots of a white-space word's pieces, one character each; shapes other than lower case add one."""
    out = []
    for p in _PIECE.findall(word):
        if p[0].isalpha():
            if p.isupper() and len(p) > 1:
                out.append(1)
            elif not p.islower():
                out.append(2 if p[1:].islower() or len(p) == 1 else 3)
            p = p.lower()
        elif p[0].isdigit():
            out.append(8 + min(len(p), 20))
            continue
        elif len(p) > 1:
            out.append(32 + min(len(p), 8))
        out.append(SHAPES + zlib.crc32(p.encode("utf-8", "replace")) % (SLOTS - SHAPES))
    return "".join(map(chr, out))


class Tokens:
    """text -> slots; remembers at most ``most`` words."""

    def __init__(self, most: int = 100_000) -> None:
        self.most, self.seen = most, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.split()
        new = set(words).difference(self.seen)
        if new:
            if len(self.seen) > self.most:
                self.seen, new = {}, set(words)
            self.seen.update((w, _slots(w)) for w in new)
        again = REPEATS[0] * sum(map(eq, words, words[1:])) + REPEATS[1] * sum(map(eq, words, words[2:]))
        return np.frombuffer(("".join(map(self.seen.__getitem__, words)) + again).encode("utf-16-le"), "<u2")


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    constant: float | None = None

    def pool(self, slots: np.ndarray) -> np.ndarray:
        """The mean vector, in blocks, so that a very long text takes no more memory than a short one."""
        total = np.zeros(self.vectors.shape[1], np.float64)
        for a in range(0, len(slots), 65_536):
            total += self.vectors.take(slots[a : a + 65_536], axis=0).sum(axis=0)
        return (total / max(1, len(slots))).astype(np.float32)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        x = (pooled - self.mean) / self.scale
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(pooled), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(pooled).astype(np.float64) / self.temperature, -60, 60)))


def word_vectors(docs: list[np.ndarray], slots: int = SLOTS, dims: int = DIMS) -> np.ndarray:
    """Random indexing over the sample: index vector plus the unit vector of the summed neighbours'."""
    rng = np.random.default_rng(SEED)
    at = rng.integers(0, dims, (slots, NONZERO))
    sign = rng.choice(np.array([-1.0, 1.0], np.float32), (slots, NONZERO))
    index = np.zeros((slots, dims), np.float32)
    np.add.at(index, (np.arange(slots)[:, None], at), sign)
    context = np.zeros(slots * dims, np.float64)
    block, size = [], 0
    for k, d in enumerate(docs):
        block.append(d)
        size += len(d)
        if size > 500_000 or k == len(docs) - 1:
            seq = np.concatenate([np.append(x.astype(np.int64), [-1] * WINDOW) for x in block])
            for gap in range(1, WINDOW + 1):
                a, b = seq[:-gap], seq[gap:]
                ok = (a >= 0) & (b >= 0)
                a, b = a[ok], b[ok]
                for j in range(NONZERO):
                    context += np.bincount(a * dims + at[b, j], sign[b, j], slots * dims)
                    context += np.bincount(b * dims + at[a, j], sign[a, j], slots * dims)
            block, size = [], 0
    context = context.reshape(slots, dims)
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    return (index / np.sqrt(NONZERO) + context / np.maximum(norm, 1e-9)).astype(np.float32)


def fit(texts: list[str], labels: list[int]) -> Model:
    """Learn from whole texts; a fifth of them, by a hash of the text, fits the temperature."""
    y = np.array(labels, np.float64)
    tokens = Tokens()
    docs = [tokens(t) for t in texts]
    vectors = word_vectors(docs)
    blank = Model(vectors, np.zeros(DIMS, np.float32), np.ones(DIMS, np.float32), np.zeros((DIMS, HIDDEN), np.float32), np.zeros(HIDDEN, np.float32), np.zeros(HIDDEN, np.float32), 0.0, 1.0)
    if len(set(labels)) < 2:
        blank.constant = float(y.mean()) if len(y) else 0.5
        return blank
    x = np.stack([blank.pool(d) for d in docs])
    held = np.array([zlib.crc32(t.encode("utf-8", "replace")) % 5 == 0 for t in texts])
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    mean, scale = x[~held].mean(0), x[~held].std(0) + 1e-3
    z, t = ((x[~held] - mean) / scale).astype(np.float32), y[~held]
    rng = np.random.default_rng(SEED)
    p = [rng.normal(0, np.sqrt(2 / DIMS), (DIMS, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(EPOCHS if len(t) < 3_000 else EPOCHS // 5):
        order = rng.permutation(len(t))
        for a in range(0, len(order), 128):
            i = order[a : a + 128]
            h = z[i] @ p[0] + p[1]
            r = np.maximum(h, 0)
            s = 1 / (1 + np.exp(-np.clip(r @ p[2] + p[3][0], -30, 30)))
            g = (s - t[i]) / len(i)
            gh = np.outer(g, p[2]) * (h > 0)
            grads = [z[i].T @ gh + 1e-4 * p[0], gh.sum(0), r.T @ g + 1e-4 * p[2], np.array([g.sum()])]
            step += 1
            for q, gr, mm, vv in zip(p, grads, m, v, strict=True):
                mm += 0.1 * (gr - mm)
                vv += 0.001 * (gr * gr - vv)
                q -= 0.003 * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
    model = Model(vectors, mean, scale, p[0].astype(np.float32), p[1].astype(np.float32), p[2].astype(np.float32), float(p[3][0]), 1.0)
    on = held if held.any() else ~held
    logit, truth = model.logits(x[on]).astype(np.float64), y[on]
    loss = lambda temp: np.mean(np.logaddexp(0, logit / temp) - truth * logit / temp)
    model.temperature = float(min(np.exp(np.linspace(-1.5, 3, 181)), key=loss))
    return model


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null ids are in no fold."""
    return F.crc32(id_col.cast("string")) % parts


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """Fit on the labelled rows outside the held-out fold that come first in a hash order, at most ``rows``.

    Ids with several labels take their mean, rounded. Rows longer than SAMPLE_CHARS teach nothing.
    """
    order = F.xxhash64(F.col(id_col), F.lit(SEED))
    known = labels.where(F.col(label_col).isNotNull() & (fold(F.col(id_col), 4) != 2)).groupBy(id_col).agg(F.round(F.avg(label_col)).cast("int").alias("__y"))
    known = known.orderBy(order, id_col).limit(rows)
    src = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__t")).where(F.length("__t") <= SAMPLE_CHARS)
    sample = src.join(F.broadcast(known), id_col).orderBy(order, F.xxhash64("__t")).limit(rows).select("__t", "__y")
    got = sample.toPandas()
    return fit(got["__t"].tolist(), got["__y"].tolist())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs plus ``score`` (0 to 1) and ``predicted``; null texts score as empty ones.

    Columns of docs with these names are replaced. One pass, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def udf(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens, m = Tokens(), shared.value
        for s in frames:
            # A row at a time: sums in a matrix product depend on the batch, and equal texts score alike.
            yield pd.Series([float(m.scores(m.pool(tokens(x or ""))[None, :])[0]) for x in s], dtype="float64")
        give_back()

    out = docs.withColumn("score", udf(F.col(text_col)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, read(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op1_quality_classifier": op1_quality_classifier}
SQL: dict[str, str] = {}
