"""Labelled samples of bounded size and a small logistic fit, for the models that learn from labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, stage

#: Labels are learned from rows whose checksum bucket, modulo MODULUS, is not HELD_OUT.
MODULUS, HELD_OUT = 4, 2


def held_out(key, modulus: int = MODULUS, rest: int = HELD_OUT):
    return bucket_of(key, modulus) == rest


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int], name: str) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, text and y of at most per_class[y] labelled training documents of each class, and how many of each
    class there are in all.

    Which ones depends on a hash of the id alone; labels that contradict each other count as 1. An id counts once: of rows that
    repeat it, the one with the least checksum of its text is taken.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(label).cast("int").alias("y"))
        .withColumn("draw", F.md5(F.col("doc_id").cast("string").cast("binary")))
    )
    chosen = None
    for y, n in per_class.items():
        some = known.filter(F.col("y") == y).orderBy("draw", "doc_id").limit(n).select("doc_id", "y")
        chosen = some if chosen is None else chosen.unionByName(some)
    # broadcast: sum(per_class) rows at most
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    every = known.join(texts.select("doc_id"), "doc_id", "left_semi").groupBy("y").count().collect()
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    return stage(one.select("doc_id", "text", "y"), name), {r["y"]: r["count"] for r in every}


def row_weights(y: np.ndarray, every: dict[int, int]) -> np.ndarray:
    """Weights (1 on average) by which the classes of the sampled rows y are as frequent as in all training rows."""
    weights = np.ones(len(y))
    for k, n in every.items():
        weights[y == k] = n / max(1, (y == k).sum())
    return weights / weights.mean() if len(y) else weights


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 60, weights: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last is the constant) by Newton's method with a quadratic penalty. weights: of the rows, 1 on average."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        return np.r_[np.zeros(x.shape[1]), np.log(share / (1 - share))]
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    c = np.ones(len(y)) if weights is None else weights
    ridge = penalty * len(y) * np.r_[np.ones(x.shape[1]), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (c * p * (1 - p))[:, None]).T @ a + np.diag(ridge + 1e-9), a.T @ (c * (y - p)) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
