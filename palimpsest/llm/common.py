"""What several operators share: the shared folder, word splitting and hash folds."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.shared import drop, save, shared_dir, spread

__all__ = ["drop", "save", "shared_dir", "spread"]

#: The words of a text, as the queries count them.
WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def unused(name: str, *frames: DataFrame) -> str:
    """The name, with underscores before it until none of the tables has it."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def id_crc(col: str, mod: int) -> Column:
    """crc32 of an id as text, modulo mod; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod


def smallest(df: DataFrame, chance: Column, most: int) -> DataFrame:
    """Up to `most` rows of df, those of the smallest `chance` (a 64-bit hash, ties by nothing but it): the same in every run.

    Rows above a threshold that leaves about twice as many go first, so what meets in one place doesn't grow with the table.
    """
    n, name = df.count(), unused("chance", df)
    few = df.withColumn(name, chance)
    if n > 4 * max(most, 250):
        few = few.where(F.col(name) < F.lit(int(-(2**63) + 2**65 * max(most, 250) // n)))
    return few.orderBy(name).limit(most).drop(name)


class WordHashes(dict):
    """64-bit hashes of words, remembered. Forgets all when it has grown to `most` words, so memory stays bounded."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with full avalanche, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(h: np.ndarray, n: int = 2) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text, from its words' hashes.

    Fewer words than n: the whole sequence is the one shingle. No words: none.
    """
    if not len(h):
        return h
    size = min(n, len(h))
    acc = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i])
    return np.unique(acc >> np.uint64(1))


def small(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches of a task in slices, so that what is made of them stays small beside the texts.

    Workers are used again: memory that earlier tasks have left behind is first given back.
    """
    trim()
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def trim() -> None:
    """Gives back what this Python process has allocated and holds no longer."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trim_jvm(spark: SparkSession) -> str:
    """Has the driver's JVM give back what it has allocated outside its heap and holds no longer; what it says of that."""
    jvm = spark._jvm
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


def ease_driver(spark: SparkSession) -> None:
    """Has the driver, its Python and its JVM, collect garbage and give back what nothing fills: heap, and what compiling many
    plans has left outside it. Changes no result."""
    trim()
    spark._jvm.System.gc()
    with contextlib.suppress(Py4JError):  # only where the JVM has this command
        trim_jvm(spark)


def give_back(spark: SparkSession) -> None:
    """Has the driver and the executors collect their garbage and give back heap that nothing fills, which they would else keep
    as large as the busiest stage before has made it. Changes no result."""
    ease_driver(spark)
    n = 2 * spark.sparkContext.defaultParallelism  # tasks enough for each executor to get some
    spark.range(0, n, 1, n).selectExpr("reflect('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, queries leave no shuffle files when they end, which Spark else keeps until the driver happens to collect its
    garbage. For tables that are made within it and read once: a second reading would shuffle anew."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A text column as UTF-8 bytes."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one array per row."""
    ends = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=ends[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def components(edges: DataFrame) -> DataFrame:
    """node, label of every node of edges (a, b longs): label is the smallest node reachable.

    Each round takes the smallest label among neighbours, then jumps to that label's own; stars end in two rounds, paths
    in about log2 of their length. All of it stays in tables: nothing comes to the driver but a count.
    """
    both = save(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "cc-edges")
    labels = save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "cc-labels")
    kept = labels
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = save(step.join(up, "label").select("node", "old", F.least("label", "up").alias("label")), "cc-labels")
        if new.where("old <> label").isEmpty():
            drop(new, both)
            return labels
        drop(kept)
        labels, kept = new.drop("old"), new
