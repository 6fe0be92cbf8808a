"""Toxicity: byte n-gram vectors, averaged over a text, into a linear softmax; both trained together in numpy.

Each distinct word of a text contributes its n-grams of SIZES bytes, the separator before and after it included,
hashed to BUCKETS vectors. A text's vector is their mean, NEUTRAL zero vectors included, so a misspelling that no training text holds still gets most of its
n-grams from known words. Training is by row-wise Adagrad over fixed mini-batches of a bounded sample of labelled
rows (max_positive and max_negative, the first by a hash of the id); scoring covers every row and the whole
text, and needs one number per bucket only, because mean and softmax are linear up to the last step.

Nulls and texts without a word have no n-grams and get the score of the bias. Rows are scored one by one, so
repeated rows get equal scores; other columns pass through, one
named like the score is replaced. Without labelled rows of both kinds, every score is the
share of positive labels (0 where there are none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .core import LOWER, U64, _BYTES, _powers, column_bytes, materialise, mix64, slices, tidy, words

SIZES = (3, 4, 5)
BUCKETS = 1 << 20
#: Neutral n-grams added to every mean, so that a short text needs as much evidence as a longer one.
NEUTRAL = 1000
#: N-grams in fewer training texts keep a neutral vector.
MIN_TEXTS = 6
DIMENSIONS = 8
MAX_POSITIVE, MAX_NEGATIVE = 1500, 3000
EPOCHS, BATCH_DOCS, RATE, INIT = 20, 32, 30.0, 0.02
#: Start of the sums of squared gradients: rare n-grams then move by what they add up to, not by their own scale.
DAMPING = 1e-5
#: A positive text weighs twice what makes both kinds equal, up to this: missing one is worse than the reverse.
MAX_WEIGHT = 4.0


def distinct_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents' distinct words, A-Z lower-cased, one separator before each: (bytes, offsets)."""
    h, start, end, first = words(buf, offsets, fold_case=True)
    keep = [a + np.sort(np.unique(h[a:b], return_index=True)[1]) for a, b in zip(first[:-1], first[1:], strict=True)]
    counts = np.array([0, *map(len, keep)])
    keep = np.concatenate(keep) if keep else np.zeros(0, np.int64)
    lengths = end[keep] - start[keep] + 1
    ends = np.concatenate(([0], np.cumsum(lengths)))
    x = buf[np.maximum(np.arange(ends[-1]) + np.repeat(start[keep] - 1 - ends[:-1], lengths), 0)]
    x[ends[:-1]] = 32
    return x, ends[np.cumsum(counts)]


def ngrams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram of the distinct words, document by document; first n-gram of each document)."""
    x, starts = distinct_words(buf, offsets)
    docs, total = len(offsets) - 1, len(x) + 1
    x = np.append(x, np.uint8(32))
    power, inverse = _powers(total)
    sums = np.zeros(total + 1, U64)
    np.cumsum(_BYTES[LOWER[x]] * power, dtype=U64, out=sums[1:])
    gaps = np.concatenate(([0], np.cumsum(x == 32, dtype=np.int32)))
    found, cuts = [], []
    for n in SIZES:
        last = max(0, total - n + 1)
        inner = np.flatnonzero(gaps[n - 1 : n - 1 + last] == gaps[1 : 1 + last]) if last else np.zeros(0, np.int64)
        h = (sums[inner + n] - sums[inner]) * inverse[inner]
        found.append((mix64(h + U64(n)) >> U64(44)).astype(np.int32))
        cuts.append(np.searchsorted(inner, starts))
        cuts[-1][-1] = len(inner)
    if docs == 1:
        return np.concatenate(found), np.array([0, sum(map(len, found))])
    out = [f[c[i] : c[i + 1]] for i in range(docs) for f, c in zip(found, cuts, strict=True)]
    return np.concatenate(out) if out else np.zeros(0, np.int32), sum(cuts)


@dataclass
class Model:
    """One number per bucket (its vector's part in the log odds) and the bias."""

    parts: np.ndarray
    bias: float

    def scores(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        grams, first = ngrams(buf, offsets)
        sums = np.concatenate(([0.0], np.cumsum(self.parts[grams], dtype=np.float64)))
        odds = np.diff(sums[first]) / (np.diff(first) + NEUTRAL) + self.bias
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def train(buf: np.ndarray, offsets: np.ndarray, labels: np.ndarray, seed: int = 7) -> Model:
    """Vectors, softmax and bias together, by cross-entropy."""
    positive = int(labels.sum())
    if not 0 < positive < len(labels):
        p = min(max(positive / max(1, len(labels)), 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((BUCKETS, DIMENSIONS)) - 0.5) * INIT).astype(np.float32)
    out = (rng.standard_normal((DIMENSIONS, 2)) * 0.5).astype(np.float32)
    bias, speed = np.zeros(2, np.float32), np.full(BUCKETS, DAMPING, np.float32)
    out_speed, bias_speed = np.full_like(out, 1e-8), np.full(2, 1e-8, np.float32)
    weight = np.where(labels == 1, min(MAX_WEIGHT, 2 * (len(labels) - positive) / positive), 1.0).astype(np.float32)
    texts = []
    for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
        g, _ = ngrams(buf[lo:hi], np.array([0, hi - lo]))
        distinct, count = np.unique(g, return_counts=True)
        texts.append((distinct, (count / (len(g) + NEUTRAL)).astype(np.float32)))
    common = np.bincount(np.concatenate([g for g, _ in texts]), minlength=BUCKETS) >= MIN_TEXTS
    vectors[~common] = 0
    order, batches = rng.permutation(len(labels)), []
    for lo in range(0, len(order), BATCH_DOCS):
        rows, grams, shares, docs = order[lo : lo + BATCH_DOCS], [], [], []
        for k, r in enumerate(rows):
            g, share = texts[r]
            keep = common[g]
            grams.append(g[keep])
            shares.append(share[keep])
            docs.append(np.full(len(grams[-1]), k, np.int16))
            texts[r] = None
        used, place = np.unique(np.concatenate(grams), return_inverse=True)
        batches.append((rows, used.astype(np.int32), place.astype(np.int32), np.concatenate(shares), np.concatenate(docs)))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for b in rng.permutation(len(batches)):
            rows, used, place, share, doc = batches[b]
            own = vectors[used]
            mean = np.stack([np.bincount(doc, share * own[place, d], len(rows)) for d in range(DIMENSIONS)], 1).astype(np.float32)
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            p *= weight[rows][:, None] / len(rows)
            back = p @ out.T
            grad = np.stack([np.bincount(place, share * back[doc, d], len(used)) for d in range(DIMENSIONS)], 1).astype(np.float32)
            speed[used] += (grad * grad).mean(1)
            vectors[used] -= rate * grad / np.sqrt(speed[used])[:, None]
            step = mean.T @ p
            out_speed += step * step
            out -= 0.06 * rate / RATE * step / np.sqrt(out_speed)
            bias_speed += p.sum(0) ** 2
            bias -= 0.06 * rate / RATE * p.sum(0) / np.sqrt(bias_speed)
    return Model(vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def sample(documents: DataFrame, labels: DataFrame, max_positive: int, max_negative: int, id_col: str, label: str) -> DataFrame:
    """(id, label) of the bounded training sample, the first by a hash of the id, the same on every run."""
    rows = labels.where(F.col(label).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).distinct()
    rows = rows.join(documents.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    kind = lambda y, n: rows.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(n)
    return kind(1, max_positive).unionByName(kind(0, max_negative))


def fit(documents: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE, id_col: str = "doc_id", text: str = "text", label: str = "label") -> Model:
    """A model of at most max_positive + max_negative labelled documents; labels other than 0 and 1 do not count.

    The sample is bounded, so its ids may be broadcast; texts are not shuffled. Rows that repeat an id all count."""
    chosen = materialise(sample(documents, labels, max_positive, max_negative, id_col, label))
    rows = documents.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    table = rows.toArrow().sort_by([("id", "ascending"), ("text", "ascending")])
    buf, offsets = column_bytes(table.column("text"))
    return train(buf, offsets, table.column("label").to_numpy().astype(np.int64))


def score(df: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """Adds each whole text's probability of label 1."""
    df = df.drop(to)
    shared = df.sparkSession.sparkContext.broadcast((model.parts.astype(np.float32), model.bias))  # BUCKETS numbers
    schema = T.StructType([*df.schema.fields, T.StructField(to, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        own = Model(*shared.value)
        for batch in batches:
            buf, offsets = column_bytes(batch.column(batch.schema.get_field_index(text)))
            made = [own.scores(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(made) if made else np.zeros(0))], names=schema.names)

    return df.mapInArrow(run, schema)
