"""Small learners that several classifiers share, and the bounded sample of labels that they are fitted on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import smallest

#: Bytes of text that a classifier is fitted on at most.
MOST_BYTES = 256 << 20


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights of a logistic regression on dense features, the last weight being the intercept; by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def labelled(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, most: int) -> DataFrame:
    """doc_id, text, label of up to `most` labelled documents of MOST_BYTES of text together, none of them held out.

    They are those of the smallest id hashes: the same in every run. Several labels of one document count as the smallest;
    null labels as none. Of rows that repeat an id, the one of the smallest text is learnt from.
    """
    few = labels.where(F.col(label).isNotNull() & ~held_out & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    few = smallest(few, F.xxhash64("doc_id"), most)
    one = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    upto = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(W.orderBy(F.xxhash64("doc_id"), "doc_id"))  # of `most` rows
    return one.withColumn("upto", upto).where(F.col("upto") <= MOST_BYTES).select("doc_id", "text", "label")
