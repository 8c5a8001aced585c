"""A linear-chain conditional random field that calls every line good or bad, and documents by what their lines sum to.

Each line has a few counts (letters, capitals, digits, signs, repeated words and lines, ...), each cut into bins. Its
potential adds the weights of its own bins and of its neighbours' bins; a 2 x 2 table scores neighbouring labels.
Forward-backward gives every line's probability of being bad; weighted by length, these make up the document's quality.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import column_bytes, id_crc, shared_dir, small, spread, table, unused
from palimpsest.llm.learn import labelled, logistic, sigmoid

#: Labelled documents that are learnt from at most.
SAMPLE = 8_000
#: Gradient steps of each of two rounds: by the documents' labels, then with those lines of bad documents as good that look it.
STEPS = 60
#: Lines that are worked on at a time.
BATCH = 200_000

UPPER, DIGITS, MARKS, CALLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*|<>{}[]=_~^\\+/@`", b"!?"
PLAIN = bytes(range(97, 123)) + bytes(range(128, 256)) + UPPER
#: Upper ends of the bins of each measure.
EDGES = (
    np.array([5, 20, 60, 150, 400, 1500]),  # bytes
    np.array([0, 1, 2, 4, 8, 16, 64]),  # words
    np.array([0.001, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7]),  # capitals
    np.array([0.001, 0.02, 0.05, 0.1, 0.3]),  # digits
    np.array([0.001, 0.01, 0.03, 0.08, 0.15, 0.3]),  # signs
    np.array([0.001, 0.01, 0.03, 0.08, 0.2]),  # calls
    np.array([0.001, 0.01, 0.03, 0.06, 0.12]),  # other punctuation
    np.array([0.05, 0.2, 0.4, 0.6, 0.75, 0.85, 0.95]),  # distinct words
    np.array([0.001, 0.02, 0.06, 0.15, 0.4, 0.8]),  # words that repeat the one before
    np.array([2.0, 3.0, 4.0, 5.0, 6.5, 9.0, 14.0]),  # mean word
    np.array([1, 2, 4, 8]),  # copies of the line in its document
    np.array([0.5]),  # ends a sentence
    np.array([0.02, 0.05, 0.1, 0.2, 0.4]),  # share of the commonest word
)
BINS = max(map(len, EDGES)) + 1


def measures(text: bytes) -> np.ndarray:
    """One row of measures for every line."""
    split = text.split(b"\n")
    copies = Counter(split) if len(split) > 1 else {split[0]: 1}
    out = []
    for line in split:
        n, words = len(line) or 1, line.split()
        k = len(words) or 1
        rest = line.translate(None, PLAIN)
        signs, calls, digits = len(rest) - len(rest.translate(None, MARKS)), len(rest) - len(rest.translate(None, CALLS)), len(rest) - len(rest.translate(None, DIGITS))
        upper = len(line) - len(line.translate(None, UPPER))
        distinct, again = len(set(words)), sum(map(operator.eq, words, words[1:]))
        common = max(Counter(words).values()) if words and distinct < 0.6 * k else 1
        other = len(rest.translate(None, b" \t\r")) - signs - calls - digits
        out.append((len(line), len(words), upper / n, digits / n, signs / n, calls / n, other / n, distinct / k, again / k, (n - k) / k, copies[line], line[-1:] in b".!?:;", common / k if k > 3 else 0))
    return np.array(out, float)


def bins(m: np.ndarray) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, m[:, j], side="left") for j, e in enumerate(EDGES)]).astype(np.uint8)


class Lines:
    """The lines of some documents one after the other, with neighbours and steps across documents side by side."""

    def __init__(self, each: list[np.ndarray]):
        self.size = np.array([len(b) for b in each])
        self.starts = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        own = np.concatenate(each).astype(np.int64) + np.arange(len(EDGES)) * BINS
        edge = np.full((1, own.shape[1]), len(EDGES) * BINS)
        before, after = np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge])
        before[self.starts], after[self.starts + self.size - 1] = edge, edge
        width = len(EDGES) * BINS + 1
        self.index = np.hstack([own, before + width, after + 2 * width])
        self.width = 3 * width
        order = np.argsort(-self.size, kind="stable")
        self.live = np.searchsorted(-self.size[order], -np.arange(self.size.max()), side="left")
        self.begin = self.starts[order]

    def at(self, t: int) -> np.ndarray:
        return self.begin[: self.live[t]] + t

    def marginals(self, w: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(bad) of each line, and expected counts of neighbouring labels. Label 1 is bad; only its potential is free."""
        e = np.exp(np.clip(w[self.index].sum(1), -30, 30))
        phi = np.column_stack([1 / (1 + e), e / (1 + e)])
        move = np.exp(pair)
        alpha, beta, scale = np.empty_like(phi), np.empty_like(phi), np.empty(len(phi))
        for t in range(len(self.live)):
            at = self.at(t)
            a = phi[at] if t == 0 else (alpha[at - 1] @ move) * phi[at]
            scale[at] = s = a.sum(1)
            alpha[at] = a / s[:, None]
        right, moves = np.ones((len(self.size), 2)), np.zeros((2, 2))
        for t in range(len(self.live) - 1, -1, -1):
            at = self.at(t)
            beta[at] = right[: len(at)]
            if t:
                back = phi[at] * right[: len(at)] / scale[at][:, None]
                moves += (alpha[at - 1].T @ back) * move
                right[: len(at)] = back @ move.T
        return (alpha * beta)[:, 1], moves

    def summed(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts)


class Model:
    def __init__(self, w: np.ndarray, pair: np.ndarray, top: np.ndarray | None = None):
        self.w, self.pair, self.top = w, pair, top

    def totals(self, lines: Lines, lengths: np.ndarray) -> np.ndarray:
        """What a document is judged by: the length-weighted and the largest probability that a line is bad, ..."""
        bad, _ = lines.marginals(self.w, self.pair)
        share = lines.summed(bad * lengths) / lines.summed(lengths)
        most = np.maximum.reduceat(bad, lines.starts)
        return np.column_stack([share, most, np.sqrt(share), np.log1p(lines.summed(lengths)) / 10, lines.summed(bad) / lines.size])

    def scores(self, lines: Lines, lengths: np.ndarray) -> np.ndarray:
        x = self.totals(lines, lengths)
        return 1 - sigmoid(np.column_stack([x, np.ones(len(x))]) @ self.top)


def fit(each: list[np.ndarray], lengths: list[np.ndarray], good: np.ndarray, steps: int = STEPS) -> Model:
    lines, size = Lines(each), np.concatenate(lengths)
    doc = np.repeat(1.0 - good, lines.size)
    w, pair = np.zeros(lines.width), np.zeros((2, 2))
    y = doc
    follows = np.ones(len(doc), bool)
    follows[lines.starts] = False
    for turn in range(2):
        moves = np.zeros((2, 2))
        a, b = y[np.flatnonzero(follows) - 1].astype(int), y[follows].astype(int)
        np.add.at(moves, (a, b), 1)
        mw, vw, mp, vp = np.zeros_like(w), np.zeros_like(w), np.zeros((2, 2)), np.zeros((2, 2))
        for k in range(1, steps + 1):
            p, expect = lines.marginals(w, pair)
            gw = np.bincount(lines.index.ravel(), np.repeat(y - p, lines.index.shape[1]), lines.width) / len(y) - 1e-5 * w
            gp = (moves - expect) / len(y) - 1e-5 * pair
            mw, vw, mp, vp = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw**2, 0.9 * mp + 0.1 * gp, 0.99 * vp + 0.01 * gp**2
            w = w + 0.1 * (mw / (1 - 0.9**k)) / (np.sqrt(vw / (1 - 0.99**k)) + 1e-8)
            pair = np.clip(pair + 0.1 * (mp / (1 - 0.9**k)) / (np.sqrt(vp / (1 - 0.99**k)) + 1e-8), -6, 6)
        if turn == 0:  # a bad document may hold good lines: those that look it, their neighbours aside
            own = w[lines.index[:, : len(EDGES)]].sum(1)
            y = doc * (own > np.quantile(own[doc == 0], 0.9) if (doc == 0).any() else 1)
    m = Model(w, pair)
    m.top = logistic(m.totals(lines, size), 1.0 - good, ridge=0.01)
    return m


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        ms = [measures(t or b"") for t in column_bytes(b, "text")]
        yield pa.RecordBatch.from_arrays([b.column(2), pa.array([bins(m).tobytes() for m in ms], pa.binary()), pa.array([(m[:, 0] + 1).tobytes() for m in ms], pa.binary())], ["label", "bins", "lengths"])


def _score(model, keep: str | None = None):
    """Scores of batches; keep: under that name, beside all their columns, else beside doc_id and held_out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            scores, each, n = [], [], 0

            def flush():
                scores.append(model.value.scores(Lines([bins(m) for m in each]), np.concatenate([m[:, 0] + 1 for m in each])))
                each.clear()

            for t in column_bytes(b, "text"):
                each.append(measures(t or b""))
                n += len(each[-1])
                if n >= BATCH:
                    flush()
                    n = 0
            if each:
                flush()
            score = pa.array(np.concatenate([*scores, np.empty(0)]), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, score], [*b.schema.names, keep]) if keep else pa.RecordBatch.from_arrays([b.column(0), b.column(1), score], ["doc_id", "held_out", "score"])

    return run


def learn(docs: DataFrame, labels: DataFrame, held_out: Column, most: int = SAMPLE):
    """The broadcast model of a bounded sample of labelled rows that aren't held_out; None without labels of both kinds."""
    rows = labelled(docs, labels, "quality", held_out, most).mapInArrow(_features, "label int, bins binary, lengths binary").toPandas()
    good = rows["label"].to_numpy(float)
    if len(set(good)) < 2:
        return None
    model = fit([np.frombuffer(x, np.uint8).reshape(-1, len(EDGES)) for x in rows["bins"]], [np.frombuffer(x) for x in rows["lengths"]], good)
    return docs.sparkSession.sparkContext.broadcast(model)


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text): score is P(good).

    labels: doc_id, quality (1 good, 0 bad); rows that are held_out are not learnt from, and of the rest a bounded sample.
    Nothing but the text is an input. A null or empty text is one empty line. Repeated rows get equal scores. Without
    labels of both kinds nothing is learnt and every score is 0.5. Other columns are ignored; an empty table gives none. A
    very long text is read whole, line by line; nothing is ranked, so ties don't matter.
    """
    shared_dir(docs.sparkSession)
    docs = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    model, out = learn(docs, labels, held_out, most), docs.select("doc_id", held_out.alias("held_out"), "text")
    if model is None:
        scored = out.select("doc_id", "held_out", F.lit(0.5).alias("score"))
    else:
        scored = out.mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, held_out: Column, most: int = SAMPLE) -> DataFrame:
    """The rows of docs, with all their columns whatever their names, that the model calls good.

    All rows stay where nothing can be learnt. A null or empty text is one empty line; very long ones are read whole;
    repeated rows get equal scores and stay or go together. An empty table gives none.
    """
    shared_dir(docs.sparkSession)
    docs = spread(docs)
    model = learn(docs, labels, held_out, most)
    if model is None:
        return docs
    score = unused("score", docs)
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(_score(model, score), schema).where(F.col(score) >= 0.5).drop(score)


def line_labels(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, line (from 0), bad: the probability that each line is bad, under a fitted model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            each = [bins(measures((t or "").encode())) for t in f["text"]]
            if each:
                lines = Lines(each)
                p, _ = lines.marginals(shared.value.w, shared.value.pair)
                yield pd.DataFrame({"doc_id": np.repeat(f["doc_id"].to_numpy(), lines.size), "line": np.arange(len(p)) - np.repeat(lines.starts, lines.size), "bad": p})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, line int, bad double")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents; see classify()."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), id_crc("doc_id", 3) == 1)
