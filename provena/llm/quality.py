"""Quality classifier: supervised subword embeddings.

A document is the mean of the vectors of its features: hashed words, hashed character n-grams of words, hashed pairs of neighbouring words
(a repeated word is a pair of its own). A softmax layer on the mean gives the class. Vectors and layer are trained together by stochastic
gradient descent in numpy, on at most MAX_TRAIN labelled rows with MAX_BYTES of text (a text over a 64th of that is not learned from), on the driver.

As the layer is linear in the mean, a trained model is one number per feature: scoring needs a table of 2 ** BITS numbers. Texts are hashed
in batches of about BATCH_BYTES, all places at once, without a loop over words.

Defined cases: null and empty texts have no features and get the constant's score; without labelled rows of both classes the score is the
base rate; repeated rows get the same score; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shared, read
from .learning import fold_of, of_bounded_size, training_sample

#: Labelled rows that are learned from, and bytes of their texts: what goes to the driver at most.
MAX_TRAIN, MAX_BYTES = 6_000, 64_000_000
#: Bound of the output weights: a text of one word over and over, labelled both ways, would drive them out of all bounds.
LARGEST = 100.0
BITS, DIM = 17, 12
NGRAMS = (3, 4)
EPOCHS, UPDATES, RATE = 4, 24_000, 0.6
BATCH_BYTES = 1 << 20
GOOD = 0.7

SPACES = bytes(32 if b in b"\t\n\v\f\r " else b for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind)) * _MIX
    return ((h ^ (h >> np.uint64(32))) * _MIX >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places in text, buckets) of all words, n-grams of words and pairs of words. text: as SPACES leaves it; two spaces part documents.

    Everything is computed for all places at once: a word's hash is a difference of running sums of bytes times powers of an odd
    base, divided by the power at which the word begins.
    """
    t = np.frombuffer(b" " + text + b"  ", np.uint8)
    solid = t != 32
    edge = np.diff(solid.astype(np.int8))
    first, last = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    wide = t.astype(np.uint64) + np.uint64(1)
    powers, backs = np.full(len(t) + 1, _BASE), np.full(len(t) + 1, _BACK)
    powers[0] = backs[0] = 1
    powers, backs = np.cumprod(powers), np.cumprod(backs)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(wide * powers[:-1])))
    word = (sums[last] - sums[first]) * backs[first]
    out = [(first, _bucket(word, 1))]
    for n in NGRAMS:
        inner = solid[1 : len(t) - n + 2].copy()
        for k in range(2, n - 1):
            inner &= solid[k : len(t) - n + 1 + k]
        at = np.flatnonzero(inner)
        code = wide[at]
        for k in range(1, n):
            code = code * np.uint64(257) + wide[at + k]
        out.append((at, _bucket(code, n)))
    near = first[1:] - last[:-1] < 2
    a, b = word[:-1][near], word[1:][near]
    out.append((first[1:][near], np.where(a == b, np.int64(1), _bucket(a * _BASE ^ b, 7))))
    return out


def plain(text: bytes | None) -> bytes:
    """text with single spaces for white space."""
    return b" ".join((text or b"").split())


@dataclass
class Model:
    value: np.ndarray  # of each feature, for the log-odds of class 1
    constant: float

    def scores(self, texts: list[bytes | None]) -> list[float]:
        out: list[float] = []
        at = 0
        while at < len(texts):
            part, size = [], 0
            while at < len(texts) and (not part or size < BATCH_BYTES):
                part.append(plain(texts[at]))
                size += len(part[-1])
                at += 1
            bounds = np.concatenate(([0], np.cumsum([len(p) + 2 for p in part])))
            total, n = np.zeros(len(part)), np.zeros(len(part))
            for where, bucket in features(b"  ".join(part)):
                # a feature's place counts the space put before the text
                doc = np.minimum(np.searchsorted(bounds, where, "right") - 1, len(part) - 1)
                total += np.bincount(doc, self.value[bucket], len(part))
                n += np.bincount(doc, minlength=len(part))
            z = self.constant + total / np.maximum(n, 1)
            out += (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()
        return out


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(features, share of each) of a text."""
    f, n = np.unique(np.concatenate([b for _, b in features(plain(text))]), return_counts=True)
    return f, (n / max(n.sum(), 1)).astype(np.float32)


def train(texts: list[bytes], y: np.ndarray, seed: int = 11) -> Model:
    """Stochastic gradient descent on the softmax loss, one row at a time, the rate falling to nothing."""
    y = np.asarray(y, int)
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        return Model(np.zeros(1 << BITS), float(np.log(rate / (1 - rate))))
    rng = np.random.default_rng(seed)
    rows = [bag(t) for t in texts]
    e = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    w, b = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    done, epochs = 0, max(EPOCHS, min(40, UPDATES // len(rows)))
    whole = epochs * len(rows)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            f, share = rows[k]
            rate = RATE * (1 - done / whole)
            done += 1
            h = share @ e[f]
            z = h @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1
            back = w @ p
            w -= rate * np.outer(h, p)
            np.clip(w, -LARGEST, LARGEST, out=w)
            b -= rate * 0.1 * p
            if len(f):
                e[f] -= (rate * 40 * share)[:, None] * back
    return Model((e @ (w[:, 1] - w[:, 0])).astype(np.float64), float(b[1] - b[0]))


def fit(sample: DataFrame, max_bytes: int = MAX_BYTES) -> Model:
    """From rows (id, text, y) of training_sample(); the rows go to the driver, MAX_TRAIN at most, with max_bytes of text at most."""
    rows = of_bounded_size(sample, max_bytes).select("id", "text", "y").toArrow().sort_by("id")
    return train(rows.column("text").to_pylist(), np.array([int(v > 0) for v in rows.column("y").to_pylist()], int))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with quality_score (0 to 1); a column of this name is replaced."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "quality_score"])
    k = docs.columns.index(text_col)
    held = Shared(docs.sparkSession, model)  # 2 ** BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in batches:
            s = model.scores(b.column(k).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, "quality_score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())]))


def op10_quality(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit(training_sample(docs, labels, "quality", fold_of("doc_id", 4) != 2, MAX_TRAIN))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= GOOD).cast("int").alias("predicted"))
