"""Labelled rows for training, and logistic regression by Newton's method."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


def fold_of(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo folds."""
    return F.crc32(F.col(key).cast("string")) % folds


def training_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text as binary, y) of labelled rows that keep allows, about max_rows at most, chosen by a hash of the id. Written once.

    A row labelled twice takes the larger label; null ids, labels and texts are not learned from; of rows that repeat an id the smallest text is, so the number of
    rows is bounded however often an id stands there.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & keep).groupBy(id_col).agg(F.max(label).alias("y")).select(F.col(id_col).alias("id"), F.col("y").cast("int"))
    n = rows.count()
    chosen = rows.where(F.pmod(F.xxhash64("id", F.lit("train")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, max_rows / max(n, 1))))
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("binary").alias("text")).where("text is not null")
    # the chosen rows are at most about max_rows pairs of numbers
    found = texts.join(F.broadcast(chosen), F.col("doc") == F.col("id"))
    return written(found.groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y")), f"train-{label}")


def of_bounded_size(sample: DataFrame, max_bytes: int) -> DataFrame:
    """The rows of training_sample() whose texts have a 64th of max_bytes at most, and of these so many, chosen by a hash, that all together have about max_bytes."""
    rows = sample.where(F.octet_length("text") <= max_bytes // 64)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    if size <= max_bytes:
        return rows
    return rows.where(F.pmod(F.xxhash64("id", F.lit("bytes")), F.lit(1_000_000)) < int(1_000_000 * max_bytes / size))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Coefficients, the constant last: ridge-penalised likelihood on standardised columns, by Newton steps that are halved until they
    gain. The penalty keeps classes that can be told apart wholly from driving the coefficients out of bounds. With one class only, a
    constant that says so.
    """
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.01
        return np.concatenate((np.zeros(x.shape[1] if x.ndim == 2 else 0), [np.log(rate / (1 - rate))]))
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1
    a = np.hstack(((x - mean) / scale, np.ones((len(x), 1))))
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(penalty * w * w))

    w = np.zeros(a.shape[1])
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(h, a.T @ (p - y) + penalty * w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-9 * max(1.0, before):
            break
    out = w.copy()
    out[:-1] /= scale
    out[-1] -= float(np.sum(w[:-1] * mean / scale))
    return out
