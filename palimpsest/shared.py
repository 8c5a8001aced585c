"""The folder that the driver and all executors share, and tables kept there."""

from __future__ import annotations

import atexit
import contextlib
import secrets
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of tables that this process has written and not yet removed, by application.
_RUNS: dict[str, str] = {}
#: Keys of sealed tables by application: in the driver's memory alone.
_KEYS: dict[str, bytes] = {}
#: Temporary folders of applications that run on this machine alone and name none.
_LOCAL: dict[str, str] = {}
#: The attribute of a table read back that names its folder.
_PATH = "_palimpsest_path"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where none is named and all executors are on this machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        _LOCAL[spark.sparkContext.applicationId] = named
    return named.rstrip("/")


def _run_dir(spark: SparkSession) -> str:
    """This application's own folder below the shared one; it is removed when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _RUNS:
        _RUNS[app] = f"{shared_dir(spark)}/palimpsest-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _RUNS[app])
    return _RUNS[app]


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone; what is left is sealed where it is sensitive
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _keyed(df: DataFrame) -> DataFrame:
    """df with the key of sealed tables, from a table of one row, always: never a literal of a plan."""
    spark = df.sparkSession
    key = _KEYS.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))
    return df.crossJoin(F.broadcast(spark.createDataFrame([(bytearray(key),)], "__key binary")))


def keyed_hash(df: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    """df with the HMAC-SHA-256 of text columns under that key: equal where all of them are, and of no use without the key."""
    spark = df.sparkSession
    pad = _KEYS.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32)).ljust(64, b"\0")
    pads = (bytearray(b ^ 0x36 for b in pad), bytearray(b ^ 0x5C for b in pad))
    message = F.concat_ws("\x01", *columns).cast("binary")
    inner = F.unhex(F.sha2(F.concat(F.col("__k_in"), message), 256))
    keys = F.broadcast(spark.createDataFrame([pads], "__k_in binary, __k_out binary"))
    return df.crossJoin(keys).withColumn(out, F.unhex(F.sha2(F.concat(F.col("__k_out"), inner), 256))).drop("__k_in", "__k_out")


def opened(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with columns opened that save has sealed and left so."""
    return _keyed(df).withColumns({c: F.decode(F.aes_decrypt(F.col(c), F.col("__key")), "UTF-8") for c in columns}).drop("__key")


def save(df: DataFrame, name: str, sealed: Sequence[str] = (), open: bool = True) -> DataFrame:
    """Writes df to the shared folder and reads it back: later jobs neither repeat its work nor depend on one executor.

    The text columns named in `sealed` lie there encrypted (AES-256-GCM) under a key that only this driver's memory and
    its running tasks hold; they are opened as they are read, or, where `open` is false, by opened().
    """
    spark = df.sparkSession
    path = f"{_run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    stored = df
    if sealed:
        stored = _keyed(df).withColumns({c: F.aes_encrypt(F.encode(c, "UTF-8"), F.col("__key")) for c in sealed}).select(df.columns)
    stored.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(stored.schema).parquet(path)
    if sealed and open:
        back = opened(back, sealed).select(df.columns)
    setattr(back, _PATH, path)
    return back


def drop(*tables: DataFrame | None) -> None:
    """Removes saved tables that nothing will read again; others are left alone."""
    for t in tables:
        if path := getattr(t, _PATH, None):
            _remove(t.sparkSession, path)


#: Rows of a task that reads or searches texts row by row, about; beyond, there are more tasks.
TASK_ROWS = 50_000


def _scanned(df: DataFrame) -> bool:
    """Whether df is files' rows with expressions only, so that they are counted by footers alone."""
    plans = [df._jdf.queryExecution().optimizedPlan()]
    while plans:
        p = plans.pop()
        if p.nodeName() not in ("Project", "LogicalRelation") and not p.nodeName().startswith("Relation"):
            return False
        plans += [p.children().apply(k) for k in range(p.children().size())]
    return True


def spread(df: DataFrame) -> DataFrame:
    """At least as many partitions as cores, and none with many more rows than TASK_ROWS or than others; the scan's own splitting where it gives that.

    Splits of a file aren't its rows: all of a row group are read by one of them.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    if not _scanned(df):
        return df if df.rdd.getNumPartitions() >= n else df.repartition(n)
    each = [r["count"] for r in df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
    most, total = max(each, default=0), sum(each)
    want = max(n, -(-total // TASK_ROWS))
    return df if len(each) >= n and most * want <= 2 * total or len(each) >= want and most <= TASK_ROWS else df.repartition(want)
