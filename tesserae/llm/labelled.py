"""Bounded samples of labelled documents for the trained classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of a training sample, and the longest text in it (in code points).
SAMPLE = 3000
LONGEST = 50_000


def held_out(doc_id: str = "doc_id"):
    """True for the third of the ids that no classifier learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE, longest: int = LONGEST) -> tuple[list[bytes], np.ndarray]:
    """Texts and 0/1 labels of at most ``most`` labelled rows that are not held out, the same ones every time.

    Rows with a null id or label are left out; of several labels for an id the
    largest counts. Only the bounded list of ids is sent to the tasks.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out())
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= longest)
    found = texts.join(F.broadcast(rows), "doc_id").groupBy("doc_id", "y").agg(F.max("text").alias("text"))
    found = sorted((r["doc_id"], r["text"].encode(), r["y"]) for r in found.toLocalIterator())
    return [t for _, t, _ in found], np.array([y for *_, y in found], np.float32)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the last is the intercept."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (p * (1 - p))[:, None]).T @ a + penalty * len(a) * np.eye(len(w))
        step = np.linalg.solve(hessian, a.T @ (y - p) - penalty * len(a) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w
