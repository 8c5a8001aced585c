"""Toxicity after noisy-channel deobfuscation.

Tokens that may be written around a filter (signs or digits, letters repeated or spaced out), of any length, become lattices:
each sign may stand for letters, a separator for nothing, a repeat for one letter. Viterbi decodes the likeliest letters
under a character trigram model of all training texts; runs of spaced letters are also cut into words. The restored text is then scored by what its words and their
beginnings say about the label.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import WordHashes, column_bytes, drop, id_crc, save, shared_dir, shingles, small, spread, table, unused
from palimpsest.llm.learn import labelled, logistic, sigmoid

#: Labelled documents that are learnt from at most.
SAMPLE = 5_000
#: Documents of label 1 that a word or beginning must occur in, and the lower bound of its log odds to count.
LEAST_DOCS, LEAST_ODDS = 3, 1.0
#: Lengths of the beginnings of words that are looked at besides whole words.
BEGINNINGS = (4, 5, 6)
#: Summed evidence of so many strongest words goes into a document's score.
STRONGEST = (1, 2, 3, 5, 10)
#: Trigrams of letters that the character model keeps in a dictionary, the most frequent ones (some 100 bytes each); all
#: others lie in sorted arrays, 16 bytes each.
GRAMS = 500_000
#: Tokens remembered at most.
MEMORY = 500_000
#: Letters that are counted at a time.
LETTERS = 500_000

#: Letters that signs and digits stand for. Fixed values.
STANDS_FOR = {"4": "a", "@": "a", "3": "e", "€": "e", "1": "il", "!": "il", "|": "il", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "8": "b", "9": "g", "6": "bg", "2": "z", "(": "c", "<": "c", "*": "aeiou", "#": "aeiou", "%": "aeiou"}
#: Signs that spell a word out. Fixed values.
SEPARATORS = " \t.-_*~,'`^:;/\\|+"
#: Natural logarithms of the channel's probabilities.
AS_IS, SIGN, DROP, REPEAT = -0.05, -1.5, -1.0, -0.7

EDGE_SIGNS = ".,;:!?\"'()[]{}<>|$%&#*=~^`_+/\\-"
SPACED = re.compile(rb"(?<!\S)(?:\S[ \t]{1,3}){2,}\S(?!\S)")
#: Signs at the ends of a token that stand for no letter.
EDGE_ONLY = "".join(c for c in EDGE_SIGNS if c not in STANDS_FOR)
#: What the channel may have altered: a sign that stands for letters, a separator, a letter twice, what is no letter.
ODD = re.compile(rf"[{re.escape(''.join(STANDS_FOR) + SEPARATORS)}]|([^\W\d_])\1|[\W\d_]")
#: Single letters with separators between them.
SPELT = re.compile(r"\w(?:[ \t.\-_*~,'`^:;/\\|+]+\w){2,}")


def packed(letters: str) -> int:
    """Up to three code points as one number."""
    out = 0
    for c in letters:
        out = out << 21 | ord(c)
    return out


class Sorted:
    """Numbers by sorted 64-bit keys, 16 bytes each."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order]

    def get(self, key: int) -> float | None:
        i = int(self.keys.searchsorted(np.int64(key)))
        return float(self.values[i]) if i < len(self.keys) and self.keys[i] == key else None


class Grams(Sorted):
    """Counts of trigrams by their packed letters."""

    @staticmethod
    def of(three: Counter) -> Grams:
        return Grams(np.array([packed(k) for k in three], np.int64), np.array(list(three.values()), np.int64))

    def __eq__(self, other: object) -> bool:
        other = Grams.of(other) if isinstance(other, Counter) else other
        return isinstance(other, Grams) and np.array_equal(self.keys, other.keys) and np.array_equal(self.values, other.values)

    __hash__ = None


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace")) - (1 << 63)


class Words(Sorted):
    """Counts of words seen twice and more by their hashes, the lengths that they have, and of all words the sum of counts
    and how many were seen once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, lengths: Iterable[int], total: int, once: int):
        super().__init__(keys, values)
        self.lengths, self.total, self.once = sorted(lengths), total, once


class Logs(Sorted):
    """Logarithms of words by their hashes."""

    def get(self, word: str, default: float | None = None) -> float | None:
        p = super().get(_hash(word))
        return default if p is None else p


def _often(keys: np.ndarray, n: np.ndarray, logs: np.ndarray, size: int) -> tuple[dict[str, float], Sorted | None]:
    """Logarithms by letters, `size` code points each, for the GRAMS most frequent; the others' by packed letters."""
    most = np.ones(len(keys), bool)
    if len(keys) > GRAMS:
        most[np.argpartition(n, len(n) - GRAMS)[: len(n) - GRAMS]] = False
    shifts = range(21 * (size - 1), -1, -21)
    return {"".join(chr(k >> x & 0x1FFFFF) for x in shifts): p for k, p in zip(keys[most].tolist(), logs[most].tolist(), strict=True)}, None if most.all() else Sorted(keys[~most], logs[~most])


class Letters:
    """Character trigrams with add-one smoothing over the letters seen."""

    def __init__(self, three: Counter | Grams, known: Counter | Words):
        """three: trigrams of words with two spaces before and one behind; known: words that spelt-out ones are cut into."""
        three = three if isinstance(three, Grams) else Grams.of(three)
        keys, n = three.keys, three.values
        pairs, which = np.unique(keys >> 21, return_inverse=True)
        two = np.zeros(len(pairs), np.int64)
        np.add.at(two, which, n)
        seen = np.unique(np.concatenate([np.unique(keys >> x & 0x1FFFFF) for x in (42, 21, 0)]))
        size = int((seen != ord(" ")).sum()) + 1
        self.p, self.rest = _often(keys, n, np.log((n + 0.1) / (two[which] + 0.1 * size)), 3)
        self.none, self.rest_none = _often(pairs, two, np.log(0.1 / (two + 0.1 * size)), 2)
        self.never = math.log(1 / size)
        # words seen twice have their own probability; all others share that of words seen once, by their letters
        if isinstance(known, Words):
            total, once, self.lengths = known.total + 1, known.once, known.lengths
            self.word = Logs(known.keys, np.log(known.values / total))
        else:
            total, once = known.total() + 1, sum(n == 1 for n in known.values())
            self.word = {w: math.log(n / total) for w, n in known.items() if n > 1}
            self.lengths = sorted({len(w) for w in self.word})
        self.new = math.log((1 + once) / total)

    def of(self, two: str, c: str) -> float:
        p = self.p.get(two + c)
        return self.far(two, c) if p is None else p

    def far(self, two: str, c: str) -> float:
        """What follows two letters, of trigrams that the dictionary lacks."""
        p = self.rest and self.rest.get(packed(two + c))
        if p is None and (p := self.none.get(two)) is None:
            p = self.rest_none and self.rest_none.get(packed(two))
        return self.never if p is None else p

    def decode(self, seen: str, ends: str = "") -> str:
        """The likeliest letters behind what is seen: exact Viterbi over the last two letters, in time linear in the length.

        ends: signs at the ends stand for letters where they can ("letters"), may all stand for nothing ("free"), or are
        like others.
        """
        first, last = len(seen) - len(seen.lstrip(EDGE_SIGNS)), len(seen.rstrip(EDGE_SIGNS))
        # a state's letters are a chain of (chain before, letter)
        known, none, never, far = self.p.get, self.none.get, self.never, self.rest and self.far
        states: dict[str, tuple[float, tuple | None]] = {"  ": (0.0, None)}
        for i, o in enumerate(seen):
            nxt: dict[str, tuple[float, tuple | None]] = {}
            ways = ([(o, AS_IS)] if o.isalpha() else []) + [(c, SIGN) for c in STANDS_FOR.get(o, "")]
            drop = DROP if o in SEPARATORS else REPEAT if i and o == seen[i - 1] and o.isalpha() else -6.0 if not ways else None
            if ends and not first <= i < last:
                drop = DROP if ends == "free" else None if ways else drop
            for two, (score, word) in states.items():
                for c, cost in ways:
                    p = known(two + c)
                    s, key = score + cost + (p if p is not None else far(two, c) if far else none(two, never)), two[1] + c
                    if key not in nxt or s > nxt[key][0]:
                        nxt[key] = (s, (word, c))
                if drop is not None:
                    s = score + drop
                    if two not in nxt or s > nxt[two][0]:
                        nxt[two] = (s, word)
            states = nxt
        _, word = max(((s + self.of(two, " "), w) for two, (s, w) in states.items()), key=lambda x: x[0], default=(0.0, None))
        letters = []
        while word is not None:
            word, c = word
            letters.append(c)
        return "".join(reversed(letters))

    def cut(self, s: str) -> list[str]:
        """The likeliest words that letters without gaps consist of; words not seen twice are read by their trigrams."""
        best, none = [(0.0, 0)], (-math.inf, 0)
        one = more = none  # a new word of one letter so far, of more: score, where it begins
        for j in range(1, len(s) + 1):
            c = s[j - 1]
            far = max((one[0] + self.of(" " + s[j - 2], c), one[1]), (more[0] + self.of(s[j - 3 : j - 1], c), more[1])) if j > 1 else none
            one, more = (best[j - 1][0] + self.new + self.of("  ", c), j - 1), far
            ways = [(one[0] + self.of(" " + c, " "), one[1]), (more[0] + self.of(s[j - 2 : j], " "), more[1])]
            ways += [(best[j - n][0] + p, j - n) for n in self.lengths[: bisect_right(self.lengths, j)] if (p := self.word.get(s[j - n : j])) is not None]
            best.append(max(ways))
        out, j = [], len(s)
        while j:
            out.append(s[best[j][1] : j])
            j = best[j][1]
        return out[::-1]


def plain(token: str) -> str:
    return token.strip(EDGE_SIGNS)


def tokens_of(texts: Iterable[bytes], most: int | None = None) -> Iterator[Counter]:
    """How many texts hold each token, in parts of about `most` tokens (all in one without it); parts add up."""
    raw = Counter()
    for t in texts:
        raw.update(set(t.split()))
        if most and len(raw) >= most:
            yield raw
            raw = Counter()
    yield raw


def words_in(raw: Counter) -> Counter:
    """Of counted tokens the words of letters alone, in lower case and without signs at their ends."""
    out = Counter()
    for token, n in raw.items():
        w = plain(token.decode("utf-8", "replace").lower())
        if w.isalpha():
            out[w] += n
    return out


def words_of(texts: Iterable[bytes]) -> Counter:
    """How often words of letters alone occur; once for each way of a text to write them."""
    return words_in(next(tokens_of(texts)))


def trigrams(words: Counter) -> Counter:
    """How often each three letters follow each other in words, their ends being spaces."""
    out = Counter()
    for part in _parts(words):
        keys, n = _trigrams(part)
        out.update({"".join(chr(k >> shift & 0x1FFFFF) for shift in (42, 21, 0)): c for k, c in zip(keys.tolist(), n.tolist(), strict=True)})
    return out


def _parts(words: Counter) -> Iterator[list[tuple[str, int]]]:
    """Words and their counts, about LETTERS letters at a time."""
    part, size = [], 0
    for w, n in words.items():
        part.append((w, n))
        size += len(w) + 3
        if size >= LETTERS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _trigrams(part: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Packed trigrams and their counts."""
    signs = np.frombuffer("".join(f"  {w} " for w, _ in part).encode("utf-32-le"), "<u4").astype(np.int64)
    lengths = np.array([len(w) + 3 for w, _ in part])
    ends = np.cumsum(lengths)
    # three letters begin everywhere but at the last two places of a word
    begins = np.ones(len(signs), bool)
    begins[ends - 1] = begins[ends - 2] = False
    at = np.flatnonzero(begins)
    keys, which = np.unique(signs[at] << 42 | signs[at + 1] << 21 | signs[at + 2], return_inverse=True)
    n = np.zeros(len(keys), np.int64)
    np.add.at(n, which, np.repeat(np.array([n for _, n in part], np.int64), lengths - 2))
    return keys, n


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of packed trigrams (length 0), and of words by length and hash."""
    row = lambda *x: pa.RecordBatch.from_arrays([pa.array(x[0], pa.int32()), *(pa.array(y, pa.int64()) for y in x[1:])], ["length", "key", "n"])
    # a token is cut into letters once for a part of the task, however many texts hold it
    for raw in tokens_of((t or b"" for b in small(batches) for t in column_bytes(b, "text")), MEMORY):
        words = words_in(raw)
        for part in _parts(words):
            keys, n = _trigrams(part)
            yield row(np.zeros(len(keys), np.int32), keys, n)
            yield row([len(w) for w, _ in part], [_hash(w) for w, _ in part], [n for _, n in part])


def counts_of(docs: DataFrame) -> tuple[Grams, Words]:
    """Trigrams and words of all texts of docs (text), every one: as many rows as letters follow each other in different
    ways, and as there are words seen twice."""
    counts = save(docs.select("text").mapInArrow(_counted, "length int, key long, n long").groupBy("length", "key").agg(F.sum("n").alias("n")), "toxicity-counts")
    words = counts.where("length > 0")
    total, once = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") == 1)).first()
    grams, often = counts.where("length = 0").select("key", "n").toArrow(), words.where("n > 1").select("length", "key", "n").toArrow()
    drop(counts)
    return Grams(grams["key"].to_numpy(), grams["n"].to_numpy()), Words(often["key"].to_numpy(), often["n"].to_numpy(), np.unique(often["length"].to_numpy()).tolist(), total, once)


def letters_of(docs: DataFrame) -> Grams:
    """Trigrams of the words of all texts of docs (text), every one."""
    return counts_of(docs)[0]


def features(word: str) -> list[int]:
    """crc32 of the word and of its beginnings."""
    w = word.encode()
    return [crc32(b"=" + w), *(crc32(b"^" + word[:n].encode()) for n in BEGINNINGS if len(word) > n)]


class Model:
    def __init__(self, letters: Letters, odds: dict[int, float], top: np.ndarray | None = None):
        self.letters, self.odds, self.top, self.seen = letters, odds, top, {}

    def __getstate__(self):
        return {**self.__dict__, "seen": {}}

    def readings(self, token: str) -> tuple[list[str], list[str]]:
        """The token without signs at its ends and, where the channel may have altered it, what Viterbi makes of it; if it
        is spelt out, also the words that its letters consist of."""
        if len(token) > 3 and token[-1] == token[-2] == token[-3] and not token[-1].isalnum():
            token = token.rstrip(token[-1])  # decoration, not spelling
        bare = token.strip(EDGE_SIGNS)
        out = [bare] if bare else []
        if spelt := SPELT.fullmatch(bare):
            bare = "".join(c for c in bare if c not in SEPARATORS)
            out.append(bare)
        full = token.strip(EDGE_ONLY)
        ways = [(full, ""), (token.strip(EDGE_ONLY + "("), ""), (bare, "")]
        if full != token.strip(EDGE_SIGNS):
            ways += [(full, "letters"), (full, "free")]
        out += [self.letters.decode(x, ends) for x, ends in dict.fromkeys(ways) if ODD.search(x)]
        return [w for w in dict.fromkeys(out) if w], self.letters.cut(self.letters.decode(bare)) if spelt else []

    def words(self, token: str) -> list[str]:
        whole, parts = self.readings(token)
        return list(dict.fromkeys(whole + parts))

    def evidence(self, token: bytes) -> tuple[tuple[str, float], ...]:
        """The word that a token comes to, or the words if it is spelt out and they say more, and the strongest log odds of
        each and its beginnings; none where none count."""
        got = self.seen.get(token)
        if got is None:
            whole, parts = ({w: o for w in ws if (o := max(self.odds.get(f, 0.0) for f in features(w))) > 0} for ws in self.readings(token.decode("utf-8", "replace").lower()))
            best = max(whole.items(), key=lambda x: x[1], default=("", 0.0))
            got = tuple(parts.items()) if sum(parts.values()) > best[1] else (best,) if best[1] > 0 else ()
            if len(self.seen) >= MEMORY:
                self.seen.clear()
            self.seen[token] = got
        return got

    def restored(self, text: bytes) -> set[bytes]:
        """Distinct tokens of a text, runs of single letters being one more token each, and their parts between wider gaps."""
        tokens = set(text.split())
        for m in SPACED.finditer(text):
            tokens.add(b" ".join(m[0].split()))
            gap = min(map(len, re.findall(rb"[ \t]+", m[0])))
            tokens.update(b" ".join(x.split()) for x in re.split(rb"[ \t]{%d,}" % (gap + 1), m[0]))
        return tokens

    def totals(self, text: bytes) -> np.ndarray:
        found: dict[str, float] = {}
        tokens = self.restored(text)
        for t in tokens:
            for w, o in self.evidence(t):
                if o > found.get(w, 0.0):
                    found[w] = o
        best = sorted(found.values(), reverse=True)
        strong = sum(o > 2.5 for o in best)
        return np.array([*(sum(best[:n]) for n in STRONGEST), math.log1p(strong), math.log1p(len(tokens))])


def odds_of(sets: list[np.ndarray], y: np.ndarray) -> dict[int, float]:
    """Lower bounds of the log odds of words and beginnings, where they speak for label 1."""
    sides = [np.unique(np.concatenate([*(s for s, t in zip(sets, y, strict=True) if t == k), np.empty(0, np.uint32)]), return_counts=True) for k in (1, 0)]
    (f, a), (g, b) = sides
    pos, neg = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    often = a >= LEAST_DOCS
    f, a = f[often], a[often]
    at = np.minimum(np.searchsorted(g, f), max(0, len(g) - 1))
    m = np.where(g[at] == f, b[at], 0) if len(g) else np.zeros(len(f))
    low = np.log((a + 0.5) / (pos + 1)) - np.log((m + 0.5) / (neg + 1)) - 2.33 * np.sqrt(1 / (a + 0.5) + 1 / (m + 0.5))
    return dict(zip(f[low > LEAST_ODDS].tolist(), low[low > LEAST_ODDS].tolist(), strict=True))


def distinct(texts: list[bytes]) -> np.ndarray:
    """Indexes of the texts without copies of earlier ones: none of the three smallest shingle hashes is known."""
    hashes, seen, out = WordHashes(), set(), []
    for i, t in enumerate(texts):
        own = set(shingles(hashes.of(t.lower().split()), 5)[:3].tolist())
        if seen.isdisjoint(own):
            out.append(i)
        seen |= own
    return np.array(out, int)


def fit(texts: list[bytes], y: np.ndarray, three: Counter | Grams | None = None, known: Words | None = None) -> Model:
    """Odds from the texts, letters from trigrams of more of them where given and words to cut into from their words, else from the same; the weights of a document's totals are fitted on halves that the odds don't know.

    Copies of a text are learnt from once: else its chance words would look like evidence.
    """
    once = distinct(texts)
    if len(set(y[once])) == 2:
        texts, y = [texts[i] for i in once], y[once]
    own = words_of(texts) if three is None or known is None else None
    letters = Letters(trigrams(own) if three is None else three, own if known is None else known)
    m, read = Model(letters, {}), {}

    def looked(t: bytes) -> np.ndarray:
        out: set[int] = set()
        for w in m.restored(t):
            if w not in read:
                if len(read) >= MEMORY // 10:
                    read.clear()
                read[w] = [f for x in m.words(w.decode("utf-8", "replace").lower()) for f in features(x)]
            out.update(read[w])
        return np.fromiter(out, np.uint32, len(out))

    sets = [looked(t) for t in texts]
    half, x = np.arange(len(texts)) % 2, np.zeros((len(texts), len(STRONGEST) + 2))
    for k in (0, 1):
        part = Model(letters, odds_of([s for s, h in zip(sets, half, strict=True) if h != k], y[half != k]))
        for i in np.flatnonzero(half == k):
            x[i] = part.totals(texts[i])
        part.seen.clear()
    final = Model(letters, odds_of(sets, y))
    final.top = logistic(x, y, ridge=0.5)
    return final


def _score(model, keep: str | None = None):
    """Scores of batches; keep: under that name, beside all their columns, else beside doc_id and held_out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        try:
            for b in small(batches):
                x = np.array([m.totals(t or b"") for t in column_bytes(b, "text")]).reshape(-1, len(STRONGEST) + 2)
                score = pa.array(sigmoid(x @ m.top[:-1] + m.top[-1]), pa.float64())
                yield pa.RecordBatch.from_arrays([*b.columns, score], [*b.schema.names, keep]) if keep else pa.RecordBatch.from_arrays([b.column(0), b.column(1), score], ["doc_id", "held_out", "score"])
        finally:
            m.seen.clear()  # the worker keeps the model: what it remembers of tokens mustn't stay for later stages

    return run


def learn(docs: DataFrame, labels: DataFrame, held_out: Column, most: int = SAMPLE):
    """The broadcast model: odds and weights from a bounded sample of labelled rows, letters and words from all texts, none of them
    held_out; None without labels of both kinds."""
    rows = labelled(docs, labels, "toxic", held_out, most).select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text")).toArrow().to_pandas()
    rows = rows.sort_values(["doc_id", "text"])  # halves are dealt by row: the same in every run
    y = rows["label"].to_numpy(float)
    if len(set(y)) < 2:
        return None
    three, known = counts_of(docs.where(F.coalesce(~held_out, F.lit(True))))
    return docs.sparkSession.sparkContext.broadcast(fit([t.encode("utf-8", "replace") for t in rows["text"]], y, three, known))


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text): score is P(toxic).

    labels: doc_id, toxic (1 or 0); rows that are held_out are not learnt from, and of the rest a bounded sample.
    Nothing but the text is an input. A null or empty text has no evidence and scores low. Repeated rows get equal
    scores. Without labels of both kinds nothing is learnt and every score is 0. Other columns are ignored; an empty
    table gives none. Of several labels of a document the smallest counts. A very long text is read whole, as tokens of
    any length are. Equal scores are equal: nothing is ranked.
    """
    shared_dir(docs.sparkSession)
    docs = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    model, out = learn(docs, labels, held_out, most), docs.select("doc_id", held_out.alias("held_out"), "text")
    if model is None:
        scored = out.select("doc_id", "held_out", F.lit(0.0).alias("score"))
    else:
        scored = out.mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, held_out: Column, most: int = SAMPLE) -> DataFrame:
    """The rows of docs, with all their columns whatever their names, that the model does not call toxic.

    All rows stay where nothing can be learnt. Null and empty texts have no evidence and stay; very long ones are read
    whole; repeated rows get equal scores and stay or go together. An empty table gives none.
    """
    shared_dir(docs.sparkSession)
    docs = spread(docs)
    model = learn(docs, labels, held_out, most)
    if model is None:
        return docs
    score = unused("score", docs)
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(_score(model, score), schema).where(F.col(score) < 0.5).drop(score)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents; see classify()."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), id_crc("doc_id", 5) == 0)
