"""A hidden Markov language model: Baum-Welch over all training texts, exact likelihoods by the scaled forward recursion.

Words that training texts hold LEAST times are symbols of their own; every other word is the symbol RARE followed by its
share among rare words, (c+1) / (C+V+1), which leaves one part for words never seen. The end of a text is a symbol, so that
the model is a distribution over texts. Counts of words come from a shuffle over all training texts; expected counts of
states are summed in each partition and then across partitions by symbol. No text is cut: a long one is worked on in runs
side by side, whose transfer matrices carry the forward and backward states from run to run.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import WordHashes, column_bytes, drop, id_crc, save, shared_dir, shuffles_removed, small, spread, table

#: Words with a symbol of their own at most (64 bytes each in the model), hidden states, Baum-Welch passes after the first START_PASSES.
TOP, STATES, PASSES = 131_072, 8, 2
#: A word with a symbol of its own occurs so often at least. What occurs less stands for the words that training lacks.
LEAST = 2
#: The first passes read one training text in so many, all of them as the others do, and are so many.
START_SHARE, START_PASSES = 1, 6
#: Distinct training words up to which their counts are broadcast (14 bytes each, 18 where counts pass 31 bits); beyond, they are joined.
BROADCAST_WORDS = 8_000_000
#: Symbols of a run: longer texts are several, with their states carried over.
RUN = 2_048
#: Symbols that are worked on at a time.
BATCH = 1_000_000
#: Steps after which states, and matrices over runs, are scaled anew: so many emissions multiplied stay far from the least double.
SCALED = 8
#: Weight of the overall word distribution in every state's own.
PRIOR = 200.0
END, RARE = 0, 1
_END = np.uint32(END).tobytes()


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words in a partition; handed on whenever they have grown large."""
    seen: Counter = Counter()
    names = ["hash", "c"]

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([_hash(w) for w in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], names)

    for b in small(batches):
        for t in column_bytes(b, "text"):
            seen.update((t or b"").lower().split())
            if len(seen) > 500_000:
                yield out()
                seen.clear()
    yield out()


class Vocabulary:
    """Sorted hashes of training words with their counts and symbols (RARE unless among the most frequent)."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, symbols: np.ndarray):
        self.hashes, self.counts, self.symbols = hashes, counts, symbols

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and symbol of each word hash; 0 and RARE for strangers."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.full(len(h), RARE, np.uint32)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[at] == h
        return np.where(hit, self.counts[at], 0), np.where(hit, self.symbols[at], RARE).astype(np.uint32)


def _encode(vocab, base: float, end_count: int, rare_total: float, keep_rare: bool):
    """Each text as symbols, with its sums over words; keep_rare: words outside the vocabulary given are listed, not scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, v, n_row, part = WordHashes(), vocab.value, 0, TaskContext.get().partitionId()
        for b in small(batches):
            words = [(t or b"").lower().split() for t in column_bytes(b, "text")]
            size, rows = np.array([len(w) for w in words], np.int64), len(words)
            h = (hashes.of([x for w in words for x in w]) ^ np.uint64(1 << 63)).view(np.int64)
            # each distinct word is looked up once, in order: the vocabulary is read from front to back
            distinct, which = np.unique(h, return_inverse=True)
            c, symbol = (x[which] for x in v.find(distinct))
            logs, rare, text = np.log10(c + 1.0), symbol == RARE, np.repeat(np.arange(rows), size)
            unsure = rare if keep_rare else np.zeros(len(h), bool)
            summed = lambda x, rows=rows, text=text: np.bincount(text, x, rows)
            ends = np.concatenate([[0], np.cumsum(size)])
            out = {
                "rid": (part << 33) + n_row + np.arange(rows),
                "n_tokens": size + 1,
                "n_known": summed((c > 0) & ~unsure).astype(np.int64) + (end_count > 0),
                "base": summed(logs * ~unsure) + math.log10(end_count + 1) - base * (size + 1),
                "rare": summed(logs * (rare & ~unsure)) - rare_total * summed(rare),
            }
            n_row += rows
            ids = [symbol[i:j].tobytes() + _END for i, j in zip(ends[:-1], ends[1:], strict=True)]
            apart = np.concatenate([[0], np.cumsum(summed(unsure))]).astype(np.int32)
            strange = pa.ListArray.from_arrays(pa.array(apart), pa.array(h[unsure]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, out.values()), pa.array(ids, pa.binary()), strange], ["doc_id", "held_out", *out, "ids", "strange"])

    return run


class Model:
    """start (S), move (S x S), emit (symbols x S), all probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, np.asfortranarray(emit)  # a state's emissions side by side

    @staticmethod
    def random(unigram: np.ndarray, states: int) -> Model:
        rng = np.random.default_rng(7)
        emit = unigram[:, None] * rng.uniform(0.5, 1.5, (len(unigram), states))
        move = rng.uniform(0.5, 1.5, (states, states)) + 4 * np.eye(states)
        return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    @staticmethod
    def of_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray, unigram: np.ndarray) -> Model:
        emit = emit + PRIOR * unigram[:, None]
        return Model((start + 1) / (start + 1).sum(), (move + 1) / (move + 1).sum(1, keepdims=True), emit / emit.sum(0))


class Batch:
    """Sequences side by side, longest first, place by place: at step t the first `live[t]` of them go on, and lie at span(t)."""

    def __init__(self, seqs: list[np.ndarray]):
        size = np.array([len(x) for x in seqs])
        self.order = np.argsort(-size, kind="stable")
        size = size[self.order]
        self.live = np.searchsorted(-size, -np.arange(size[0]), side="left").tolist()
        ends = np.concatenate([[0], np.cumsum(self.live)])
        self.ends, place = ends.tolist(), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        self.flat = np.empty(len(place), np.int64)
        self.flat[ends[place] + np.repeat(np.arange(len(size)), size)] = np.concatenate([seqs[i] for i in self.order])

    def span(self, t: int) -> slice:
        return slice(self.ends[t], self.ends[t + 1])

    def emitted(self, m: Model) -> np.ndarray:
        """Probabilities of the symbols, states x symbols."""
        return np.take(m.emit.T, self.flat, axis=1)


class Runs:
    """Sequences cut into runs: the runs, the sequence of each, and its place among that sequence's."""

    def __init__(self, seqs: list[np.ndarray], size: int | None = None):
        size = size or RUN
        self.runs = [x[i : i + size] for x in seqs for i in range(0, len(x), size)]
        k = np.array([-(-len(x) // size) for x in seqs])
        self.owner = np.repeat(np.arange(len(seqs)), k)
        self.nth = np.arange(len(self.runs)) - np.repeat(np.cumsum(k) - k, k)

    def entered(self, m: Model, alone: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
        """What is known of the first state of each run from all before it, each run's log likelihood given that, the
        states at the end of the run before it, and what later runs say of the states at each run's end.

        alone: else sequences of one run, which carry nothing over, are left out of the likelihoods, and aren't read.
        """
        states, n = len(m.start), len(self.runs)
        enter, logs, before, after = np.tile(m.start, (n, 1)), np.zeros(n), np.zeros((n, states)), None
        first = np.flatnonzero((self.nth == 0) & (alone | np.append(self.nth[1:] > 0, False)))
        last = np.zeros((n, states))
        if len(first):
            last[first], logs[first] = _forward(m, [self.runs[i] for i in first], enter[first])
        later = np.flatnonzero(self.nth > 0)
        if len(later):
            through, scale = _transfer(m, [self.runs[i] for i in later])
            at = np.zeros(n, int)
            at[later] = np.arange(len(later))
            for k in range(1, int(self.nth.max()) + 1):
                i = np.flatnonzero(self.nth == k)
                before[i] = last[i - 1]
                enter[i] = before[i] @ m.move
                v = np.einsum("is,ist->it", before[i], through[at[i]])
                total = v.sum(1)
                last[i], logs[i] = v / total[:, None], np.log(total) + scale[at[i]]
            after = np.ones((n, states))
            for k in range(int(self.nth.max()), 0, -1):
                i = np.flatnonzero(self.nth == k)
                back = np.einsum("ist,it->is", through[at[i]], after[i])
                after[i - 1] = back / (last[i - 1] * back).sum(1, keepdims=True)
        return enter, logs, before, after


def _forward(m: Model, runs: list[np.ndarray], enter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States at the end of each run, and its log likelihood, by the scaled forward recursion."""
    b, move = Batch(runs), np.ascontiguousarray(m.move.T)
    e, out, last = b.emitted(m), np.zeros(len(runs)), np.empty((len(m.start), len(runs)))
    alpha = enter[b.order].T
    for t, live in enumerate(b.live):
        alpha = (move @ alpha[:, :live] if t else alpha) * e[:, b.span(t)]
        end = b.live[t + 1] if t + 1 < len(b.live) else 0
        if end < live or t % SCALED == 0:
            scale = alpha.sum(0)
            alpha /= scale
            out[:live] += np.log(scale)
            last[:, end:live] = alpha[:, end:]
    logs, states = np.empty(len(runs)), np.empty((len(runs), len(m.start)))
    logs[b.order], states[b.order] = out, last.T
    return states, logs


def _transfer(m: Model, runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """From the state before each run to the state at its end, together with its symbols: a matrix, and the logarithm of
    what it is scaled by."""
    b, s, move = Batch(runs), len(m.start), np.ascontiguousarray(m.move.T)
    e, logs, out = b.emitted(m), np.zeros(len(runs)), np.empty((s, s, len(runs)))
    # state now, state before the run, run
    a = np.repeat(move[:, :, None], len(runs), 2) * e[:, None, b.span(0)]
    for t, live in enumerate(b.live):
        if t:
            a = (move @ a[:, :, :live].reshape(s, -1)).reshape(s, s, live)
            a *= e[:, None, b.span(t)]
        end = b.live[t + 1] if t + 1 < len(b.live) else 0
        if end < live or t % SCALED == 0:
            scale = a.sum((0, 1))
            a /= scale
            logs[:live] += np.log(scale)
            out[:, :, end:live] = a[:, :, end:]
    back, matrices = np.empty(len(runs)), np.empty((len(runs), s, s))
    back[b.order], matrices[b.order] = logs, out.transpose(2, 1, 0)
    return matrices, back


def likelihoods(m: Model, seqs: list[np.ndarray]) -> np.ndarray:
    """Natural logarithms of the probabilities of whole sequences, by the scaled forward recursion."""
    cut = Runs(seqs)
    return np.bincount(cut.owner, cut.entered(m)[1], len(seqs))


def expected(m: Model, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, moves and emissions in whole sequences."""
    cut = Runs(seqs)
    enter, _, before, after = cut.entered(m, alone=False)
    b, s, forth = Batch(cut.runs), len(m.start), np.ascontiguousarray(m.move.T)
    e, before, goes_on = b.emitted(m), before[b.order], cut.nth[b.order] > 0
    alpha, last = np.empty_like(e), enter[b.order].T
    for t, live in enumerate(b.live):
        here = b.span(t)
        last = (forth @ last[:, :live] if t else last) * e[:, here]
        # every run ends scaled: from both sides its states then sum to 1 at each place
        if (b.live[t + 1] if t + 1 < len(b.live) else 0) < live or t % SCALED == 0:
            c = last.sum(0)
            last /= c
            e[:, here] /= c
        alpha[:, here] = last
    move = np.zeros((s, s))
    beta = np.ones((s, len(cut.runs))) if after is None else after[b.order].T.copy()
    for t in range(len(b.live) - 1, -1, -1):
        here, live = b.span(t), b.live[t]
        w = e[:, here] * beta[:, :live]
        alpha[:, here] *= beta[:, :live]  # from now on what is known of these states from both sides
        if t:
            move += alpha[:, b.ends[t - 1] : b.ends[t - 1] + live] @ w.T
            beta[:, :live] = m.move @ w
        else:
            move += before[goes_on].T @ w[:, goes_on].T
    emit = np.empty((s, len(m.emit)))
    for j in range(s):
        emit[j] = np.bincount(b.flat, alpha[j], len(m.emit))
    return alpha[:, b.span(0)][:, ~goes_on].sum(1), move * m.move, emit.T


def _batches(frames: Iterator[pd.DataFrame], most: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Keys and symbols, about `most` symbols at a time."""
    keys, ids, n = [], [], 0
    for f in frames:
        for k, x in zip(f["rid"], f["ids"], strict=True):
            keys.append(k)
            ids.append(np.frombuffer(x, np.uint32).astype(np.int64))
            n += len(ids[-1])
            if n >= most:
                yield keys, ids
                keys, ids, n = [], [], 0
    if ids:
        yield keys, ids


def _expect(model, states: int):
    """Rows symbol, c0..: a partition's expected emissions; symbol -1 holds starts and -2-i the moves from state i."""
    cols = ["symbol", *(f"c{j}" for j in range(states))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, total = model.value, None
        for _, ids in _batches(frames, BATCH):
            got = expected(m, ids)
            total = got if total is None else tuple(a + b for a, b in zip(total, got, strict=True))
        if total is not None:
            start, move, emit = total
            used = np.flatnonzero(emit.any(axis=1))
            yield pd.DataFrame(np.column_stack([used, emit[used]]), columns=cols).astype({"symbol": "int64"})
            yield pd.DataFrame(np.column_stack([-2 - np.arange(states), move]), columns=cols).astype({"symbol": "int64"})
            yield pd.DataFrame(np.column_stack([[-1], start[None, :]]), columns=cols).astype({"symbol": "int64"})

    return run, "symbol long, " + ", ".join(f"{c} double" for c in cols[1:])


def _score(model):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, ids in _batches(frames, BATCH // 2):
            yield pd.DataFrame({"rid": keys, "hmm": likelihoods(model.value, ids) / math.log(10)})

    return run


def _often(words: DataFrame, top: int) -> DataFrame:
    """Words (hash, c) among which are the `top` most frequent of at least LEAST, and few others.

    A histogram of logarithms of counts says where to cut, so what is then ordered doesn't grow with the partitions.
    """
    level = F.floor(F.log2("c") * 16).cast("int")
    words, at, n = words.where(F.col("c") >= LEAST), 0, 0
    for at, k in sorted(map(tuple, words.groupBy(level.alias("level")).count().collect()), reverse=True):
        n += k
        if n >= top:
            break
    return words.where(level >= at)


def score(docs: DataFrame, held_out: Column, top: int = TOP, states: int = STATES, passes: int = PASSES, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """Scores every text of docs (doc_id, text) under a model of those that are not held_out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. A null or empty text is the end token
    alone; a very long one is scored whole, its runs side by side. Repeated rows count and are scored each. Of words that
    occur equally often, those of smaller hashes have symbols of their own where not all can. Without any training text every probability comes from the smoothing
    alone. Other columns are ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    docs = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text")))
    train = docs.where("not held_out")
    with shuffles_removed(spark):
        words = save(train.select("text").mapInArrow(_count, "hash long, c long").groupBy("hash").agg(F.sum("c").alias("c")), "hmm-words")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = train.count()
    n, v = total + ends, distinct + (ends > 0)

    best = _often(words, top).orderBy(F.desc("c"), "hash").limit(top).toArrow()
    best_hash, best_c = best["hash"].to_numpy(), best["c"].to_numpy()
    whole = distinct <= broadcast_words
    known = words.toArrow() if whole else best
    order = np.argsort(known["hash"].to_numpy(), kind="stable")
    hashes, symbols = known["hash"].to_numpy()[order], np.full(len(order), RARE, np.uint32)
    symbols[np.searchsorted(hashes, best_hash)] = np.arange(2, 2 + len(best_hash), dtype=np.uint32)
    counts = known["c"].to_numpy()[order]
    counts = counts.astype(np.int32) if not len(counts) or counts.max() < 1 << 31 else counts
    del known, order
    vocab = spark.sparkContext.broadcast(Vocabulary(hashes, counts, symbols))
    rare_c, rare_v = total - int(best_c.sum()), distinct - len(best_c)
    base, rare_total = math.log10(n + v + 1), math.log10(rare_c + rare_v + 1)
    schema = "doc_id long, held_out boolean, rid long, n_tokens long, n_known long, base double, rare double, ids binary, strange array<long>"
    coded = save(docs.mapInArrow(_encode(vocab, base, ends, rare_total, not whole), schema), "hmm-symbols")
    vocab.destroy()
    if whole:
        drop(words)

    unigram = np.concatenate([[ends + 1, rare_c + 1], best_c + 1.0])
    unigram /= unigram.sum()
    model = Model.random(unigram, states)
    training = coded.where("not held_out").select("rid", "ids")
    for _ in range(START_PASSES + passes):
        shared = spark.sparkContext.broadcast(model)
        run, cols = _expect(shared, states)
        with shuffles_removed(spark):
            got = training.mapInPandas(run, cols).groupBy("symbol").agg(*(F.sum(f"c{j}").alias(f"c{j}") for j in range(states))).toArrow()
        counts = np.zeros((1 + states + len(unigram), states))
        at = got["symbol"].to_numpy() + 1 + states
        for j in range(states):
            counts[at, j] = got[f"c{j}"].to_numpy()
        del got, at
        model = Model.of_counts(counts[states], counts[:states][::-1], counts[states + 1 :], unigram)
        shared.destroy()

    model = spark.sparkContext.broadcast(model)
    if whole:
        scored = coded.select("doc_id", "held_out", "rid", "n_tokens", "n_known", "base", "rare", "ids").mapInPandas(_score_rows(model), "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    else:  # too many words to broadcast: those without a symbol are looked up by a join
        looked = coded.select("rid", F.explode("strange").alias("hash")).join(words, "hash")
        sums = looked.groupBy("rid").agg(F.count("*").alias("found"), F.sum(F.log10(F.col("c") + 1.0)).alias("logs"))
        hmm = coded.select("rid", "ids").mapInPandas(_score(model), "rid long, hmm double")
        scored = coded.drop("ids", "strange").join(hmm, "rid").join(sums, "rid", "left").na.fill(0, ["found"]).na.fill(0.0, ["logs"])
        scored = scored.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("found")).alias("n_known"), (F.col("base") + F.col("logs")).alias("base"), (F.col("hmm") + F.col("rare") + F.col("logs")).alias("score"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def _score_rows(model):
    keep = ["doc_id", "held_out", "n_tokens", "n_known", "base"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f.reset_index(drop=True)
            out = f[keep].copy()
            out["score"] = 0.0
            size = f["ids"].map(len).to_numpy().cumsum() // (BATCH * 2)
            for _, g in f.groupby(size):
                ids = [np.frombuffer(x, np.uint32).astype(np.int64) for x in g["ids"]]
                out.loc[g.index, "score"] = likelihoods(model.value, ids) / math.log(10) + g["rare"]
            yield out

    return run


def op2_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents; see score()."""
    return score(table(spark, sf_dir, "documents"), id_crc("doc_id", 7) == 2)
