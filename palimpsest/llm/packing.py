"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens with a weight. Each window of L tokens grants queue s a quantum of L times its share of
the weights of the queues that still hold tokens; a queue sends packets of a few tokens, and what its quantum doesn't pay
for stays as its deficit and is carried into the next window. Packet j of g tokens of a queue of weight w is sent once
(j + 1/2) g / w has been granted to each unit of weight, which pays for half of it: so the packets of all queues, sorted by that, are the schedule of
a sequential run, and how far each queue is at any window follows from counting. Any partition enters the schedule
anywhere, with the deficits that a sequential run would carry there, and no window waits for another.

Each queue is within one packet of its entitlement after every window, and its share of the others' packets. Packets are single tokens for queues that are due
PACKET tokens a window or more, and PACKET tokens for smaller ones, which would else be strewn over one-token pieces.
Weights default to the queues' own sizes, so that all end together; with others, those that last longer share the rest.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import column_bytes, save, small, spread, table

LENGTH = 4096
#: Tokens of a packet of a queue that is due fewer tokens than these in a window.
PACKET = 64
#: Counts (windows times queues) that are worked on at a time.
COUNTS = 2_000_000
#: Chunks of text whose ids a task remembers at most (some 200 bytes each).
CHUNKS = 500_000
#: Rows of the (partition, source) table up to which it is broadcast; beyond, a plain join.
BROADCAST_ROWS = 50_000
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: A chunk that ends in ASCII punctuation after something else.
TAIL = re.compile(r"(.*[^!-/:-@\[-`{-~])([!-/:-@\[-`{-~]+)", re.S)
#: Letters below this are stable under NFC and lower-cased one by one.
PLAIN = "\u0250"


class ChunkEncoder(dict):
    """Token ids of texts, through a memory of whitespace-free chunks, emptied at `most` of them.

    Right only for lower-casing tokenizers that drop white space, never join across it and keep runs of letters apart
    from punctuation; `whole` asks for plain encoding of each text instead. Chunks of plain letters go straight to the
    tokenizer's merges; a tail of punctuation is cut off a chunk; everything else takes the tokenizer's full way.
    """

    def __init__(self, path: str, end_id: int | None, whole: bool = False, most: int = CHUNKS):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.bytes = {c: ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)[0][0] for c in map(chr, range(0x80, ord(PLAIN))) if c.isalpha()}
        self.bytes = str.maketrans(self.bytes)
        self.dtype = np.dtype("<u2") if max(self.tokenizer.get_vocab_size(), end_id or 0) < 1 << 16 else np.dtype("<u4")
        self.end = b"" if end_id is None else np.array([end_id], self.dtype).tobytes()
        self.whole, self.most = whole, most

    def _full(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        text = chunk.decode()
        if text.isalpha() and max(text) < PLAIN and "\u0130" not in text:
            ids = np.array([t.id for t in self.merges.tokenize(text.lower().translate(self.bytes))], self.dtype).tobytes()
        elif (m := TAIL.fullmatch(text)) and m[1][-1].isalpha() and m[1][-1] < PLAIN:
            ids = self[m[1].encode()] + self[m[2].encode()]
        else:
            ids = self._full(text)
        self[chunk] = ids
        return ids

    def __call__(self, text: str | None) -> bytes:
        return self.raw((text or "").encode("utf-8", "replace"))

    def raw(self, text: bytes | None) -> bytes:
        """Ids of a text in UTF-8."""
        text = text or b""
        if self.whole or b"<|" in text:  # perhaps a special token, which is matched before lower-casing
            return self._full(text.decode("utf-8", "replace")) + self.end
        return b"".join(map(self.__getitem__, text.lower().split())) + self.end


TOKENS = "doc_id long, source string, part int, start_in_part long, n long, width int, ids binary"


def _tokenize(path: str, end_id: int | None, whole: bool, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, at, part = ChunkEncoder(path, end_id, whole, most), {}, TaskContext.get().partitionId()
        width = encode.dtype.itemsize
        for b in small(batches):
            ids, starts = list(map(encode.raw, column_bytes(b, "text"))), []
            sizes = [len(x) // width for x in ids]
            for s, n in zip(b.column(2).to_pylist(), sizes, strict=True):
                starts.append(at.get(s, 0))
                at[s] = starts[-1] + n
            k = len(ids)
            cols = [b.column(0), b.column(2), pa.array([part] * k, pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array([width] * k, pa.int32()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in TOKENS.split(", ")])

    return run


class Schedule:
    """How many tokens each queue has given at any place of the stream: all arithmetic is the same in every task."""

    def __init__(self, sizes: np.ndarray, weights: np.ndarray, length: int):
        self.sizes, self.length, self.total = np.asarray(sizes, np.int64), length, int(np.sum(sizes))
        self.weights = np.asarray(weights, float)
        share = self.weights / max(self.weights.sum(), 1e-300)
        self.packets = np.where(share * length >= PACKET, 1, PACKET).astype(np.int64)
        self.count = -(-self.sizes // self.packets)
        # what has been granted to a unit of weight when queues run out, and the tokens of all queues then
        ends = np.unique(np.concatenate([[0.0], self.sizes / self.weights]))
        self.times = ends
        self.tokens = np.minimum(self.sizes, self.weights * ends[:, None]).sum(1)
        self.slack = int(self.packets.sum()) + len(self.sizes)
        #: Windows whose counts are remembered: documents of all queues of a batch ask for much the same ones.
        self.known, self.rows = np.empty(0, np.int64), np.empty((0, len(self.sizes)), np.int64)

    def at(self, windows: np.ndarray) -> np.ndarray:
        """Tokens of every queue before each window, from memory where they are there."""
        new = np.setdiff1d(windows, self.known)
        if len(new):
            if (len(self.known) + len(new)) * max(1, len(self.sizes)) > COUNTS:
                self.known, self.rows = self.known[:0], self.rows[:0]
                new = np.unique(windows)
            known = np.concatenate([self.known, new])
            order = np.argsort(known)
            self.known, self.rows = known[order], np.concatenate([self.rows, self.given(new * self.length)])[order]
        return self.rows[np.searchsorted(self.known, windows)]

    def due(self, queue, packet: np.ndarray) -> np.ndarray:
        """When half of a packet is paid for; a queue's last one may be smaller."""
        before = packet * self.packets[queue]
        return (before + 0.5 * np.minimum(self.packets[queue], self.sizes[queue] - before)) / self.weights[queue]

    def earlier(self, at: np.ndarray) -> np.ndarray:
        """Packets of every queue that are due before each time (times x queues): counted, then corrected by the very
        numbers that due() gives, so that tasks agree whatever the rounding."""
        every = np.arange(len(self.sizes))
        n = np.clip(np.ceil(at[:, None] * self.weights / self.packets - 0.5), 0, self.count).astype(np.int64)
        for _ in range(2):
            n = np.where((n > 0) & (self.due(every, n - 1) >= at[:, None]), n - 1, n)
            n = np.where((n < self.count) & (self.due(every, n) < at[:, None]), n + 1, n)
        return n

    def given(self, places: np.ndarray) -> np.ndarray:
        """Tokens of every queue among the first `places` tokens of the stream (places x queues). Rows sum to their place."""
        places = np.clip(np.asarray(places, np.int64), 0, self.total)
        low = np.interp(places - self.slack, self.tokens, self.times, left=0.0)
        high = np.nextafter(np.interp(places + self.slack, self.tokens, self.times), np.inf) * (1 + 1e-12)
        held = lambda n: np.minimum(n * self.packets, self.sizes)
        # the last time before which no more than `places` tokens are due
        for _ in range(80):
            mid = (low + high) / 2
            live = np.flatnonzero((mid > low) & (mid < high))
            if not len(live):
                break
            fits = held(self.earlier(mid[live])).sum(1) <= places[live]
            low[live], high[live] = np.where(fits, mid[live], low[live]), np.where(fits, high[live], mid[live])
        n = self.earlier(low)
        out = held(n)
        # packets due at that very time are given in the order of the queues, the last one in part
        after = self.earlier(np.nextafter(low, np.inf))
        more = held(after) - out
        left = (places - out.sum(1))[:, None]
        return out + np.clip(left - (np.cumsum(more, 1) - more), 0, more)

    def window(self, queue: int, start: int, end: int) -> np.ndarray:
        """Numbers of the windows at whose beginnings the tokens start .. end of a queue may be cut, in order, one beyond
        to each side. For queues of large packets, those that their packets are due in."""
        g = int(self.packets[queue])
        packets = np.arange(start // g, (end - 1) // g + 1) if g > 1 else np.array([start, end - 1])
        place = np.interp(self.due(queue, packets), self.times, self.tokens)
        low, high = np.floor((place - self.slack) / self.length).astype(np.int64), np.ceil((place + self.slack) / self.length).astype(np.int64)
        last = -(-self.total // self.length)
        if g == 1:
            return np.arange(max(0, low[0]), min(last, high[-1]) + 1)
        width = int((high - low).max()) + 1
        return np.unique(np.clip(low[:, None] + np.arange(width + 1), 0, last))

    def pieces(self, queue: int, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of documents side by side in a queue: document, start in it, length, sequence and offset of each piece.

        The last window, if it isn't full, is dealt into sequences whose lengths are the powers of two that make it up,
        so that nothing is padded.
        """
        begin, end = int(starts[0]), int(starts[-1] + sizes[-1])
        k = self.window(queue, begin, end)
        # few windows at a time: a row of counts for each boundary
        step = max(2, COUNTS // 4 // max(1, len(self.sizes)))
        boundary, first, offset = [], [], []
        for i in range(0, len(k), step):
            both = self.at(np.concatenate([k[i : i + step], k[i : i + step] + 1]))
            got, nxt = both[: len(both) // 2], both[len(both) // 2 :]
            boundary.append(got[:, queue])
            first.append(nxt[:, queue])
            offset.append((nxt - got)[:, :queue].sum(1))
        boundary, nxt, offset = map(np.concatenate, (boundary, first, offset))
        some = nxt > boundary
        k, boundary, offset = k[some], boundary[some], offset[some]
        cuts = [starts, boundary[(boundary > begin) & (boundary < end)]]
        full, rest = divmod(self.total, self.length)
        powers, at = [], 0
        while rest:
            powers.append((at, 1 << (rest.bit_length() - 1)))
            at, rest = at + powers[-1][1], rest - powers[-1][1]
        if len(k) and k[-1] == full:
            inner = boundary[-1] - offset[-1] + np.array([p for p, _ in powers], np.int64)
            cuts.append(inner[(inner > max(begin, boundary[-1])) & (inner < end)])
        cut = np.unique(np.concatenate(cuts))
        length = np.diff(np.append(cut, end))
        doc = np.searchsorted(starts, cut, side="right") - 1
        at = np.searchsorted(boundary, cut, side="right") - 1
        seq, place = k[at], offset[at] + cut - boundary[at]
        late = np.flatnonzero(seq == full)
        if len(late):
            heads = np.array([p for p, _ in powers], np.int64)
            part = np.searchsorted(heads, place[late], side="right") - 1
            seq[late], place[late] = full + part, place[late] - heads[part]
        return doc, cut - starts[doc], length, seq, place


def _pieces(schedule, length: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan = Schedule(*schedule.value, length)
        names = [c.split()[0] for c in OUT.split(", ")]
        for f in (f.iloc[k : k + 4096] for f in frames for k in range(0, len(f), 4096)):
            f = f[f["n"] > 0].sort_values(["queue", "at"], kind="stable")
            out = []
            if len(f):
                at, n, queue = f["at"].to_numpy(), f["n"].to_numpy(), f["queue"].to_numpy()
                # documents side by side are cut together
                apart = np.flatnonzero((queue[1:] != queue[:-1]) | (at[1:] != at[:-1] + n[:-1])) + 1
                for i, j in zip(np.concatenate([[0], apart]), np.concatenate([apart, [len(f)]]), strict=True):
                    doc, start, size, seq, place = plan.pieces(int(queue[i]), at[i:j], n[i:j])
                    ids, width = f["ids"].iloc[i:j].array, f["width"].iloc[i:j].array
                    crc = [zlib.crc32(np.frombuffer(ids[d], f"<u{width[d]}", m, s * width[d]).astype("<u4")) for d, s, m in zip(doc, start, size, strict=True)]
                    out.append(pd.DataFrame(dict(zip(names, (f["doc_id"].iloc[i:j].array[doc], start, size, crc, n[i:j][doc], seq, place), strict=True))))
            yield pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in names})

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int | None = 2, length: int = LENGTH, whole: bool = False, weights: dict[str | None, float] | None = None, most: int = CHUNKS) -> DataFrame:
    """Packs docs (doc_id, text, source) into sequences of at most `length` tokens; one row per piece.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. weights: the proportions in which windows
    are filled, by source, 1 for those not named; without it each source weighs what it holds. Sources run out where
    their weights ask for more than they hold; the others then share. most: chunks of text that a task remembers; it bounds
    memory and changes no result.

    A null or empty text is the end token alone (without end_id: no piece); a very long one is cut over as many windows as
    its source's share needs. A null source is a queue of its own. Repeated rows are packed each, and queues due at once
    take turns by name; other columns are ignored, whatever their names. An empty table gives no rows. Nothing is dropped:
    each token lies in exactly one piece.

    The texts are read once: their ids go to the shared folder with each row's place in its partition's part of the
    queue, and only a (partition, source) table of sums is shuffled. A source that holds most rows is spread over as
    many partitions as before. A row per source goes to every task; the work of a window grows with their number.
    """
    if weights and min(weights.values()) <= 0:
        raise ValueError("weights must be above 0")
    spark = docs.sparkSession
    ids = save(
        spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"))).mapInArrow(_tokenize(tokenizer, end_id, whole, most), TOKENS),
        "packing-ids",
    )
    sums = save(ids.groupBy("part", "source").agg(F.sum("n").alias("n")), "packing-sums")
    queues = sorted(((r.source, r.n) for r in sums.groupBy("source").agg(F.sum("n").alias("n")).toLocalIterator()), key=lambda x: (x[0] is None, x[0] or ""))
    sizes = np.array([n for _, n in queues], np.int64)
    asked = np.array([float(n) if weights is None else float(weights.get(s, 1.0)) for s, n in queues])
    schedule = spark.sparkContext.broadcast((np.maximum(sizes, 0), np.where(asked > 0, asked, 1.0)))
    numbers = spark.createDataFrame([(s, k) for k, (s, _) in enumerate(queues)] or [(None, 0)], "q_source string, queue int")
    placed = sums.join(F.broadcast(numbers), F.col("source").eqNullSafe(F.col("q_source")))
    placed = placed.withColumn("base", F.sum("n").over(W.partitionBy("queue").orderBy("part")) - F.col("n")).select(F.col("part").alias("b_part"), F.col("source").alias("b_source"), "queue", "base")
    placed = save(placed, "packing-base")
    if placed.count() <= BROADCAST_ROWS:
        placed = F.broadcast(placed)
    rows = ids.join(placed, (F.col("part") == F.col("b_part")) & F.col("source").eqNullSafe(F.col("b_source")))
    return rows.select("doc_id", "ids", "n", "width", "queue", (F.col("base") + F.col("start_in_part")).alias("at")).mapInPandas(_pieces(schedule, length), OUT)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents by their sources' own shares; see pack()."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
