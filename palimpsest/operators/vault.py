"""The vault: an encrypted table from (tag, number) to value, kept as Parquet batches behind an atomic manifest.

A batch of new values is numbered, sealed, written under a name of its own and then made visible by replacing the manifest;
a lock on the driver lets one writer at a time allocate. Numbers come from a range-partitioned sort with one prefix sum over
(partition, tag), so no task sees all values of a tag. Keys travel in a one-row table, never as literals of a plan.
"""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import hmac
import json
import os
import secrets
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.shared import save

KEY_BYTES = 32
SCHEMA = "tag string, seq long, index_hash binary, nonce binary, ciphertext binary, created_at timestamp"
#: Labels under which the two keys are derived from the master key.
INDEX_LABEL, SEAL_LABEL = b"palimpsest index v1", b"palimpsest seal v1"


class VaultError(RuntimeError):
    pass


def number(values: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """values (tag, norm, ord, ...) with seq: 1, 2, ... within each tag by ord, after the largest that `taken` (tag, seq) holds.

    values has one row per (tag, norm), or per (tag, key) where it has a keyed hash of both instead. ord orders all of them.
    """
    hidden, last = [c for c in ("norm", "value") if c in values.columns], "norm" if "norm" in values.columns else "key"
    laid = save(values.repartitionByRange("tag", "ord", last).withColumn("__part", F.spark_partition_id()), "vault-order", hidden)
    counts = laid.groupBy("tag", "__part").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(W.partitionBy("tag").orderBy("__part")) - F.col("__n")).drop("__n")
    if taken is not None:
        before = before.join(taken.groupBy("tag").agg(F.max("seq").alias("__top")), "tag", "left")
    else:
        before = before.withColumn("__top", F.lit(0))
    own = F.row_number().over(W.partitionBy("tag", "__part").orderBy("ord", last))
    out = laid.withColumn("__own", own).join(before, ["tag", "__part"])
    return out.withColumn("seq", (F.col("__own") + F.col("__before") + F.coalesce("__top", F.lit(0))).cast("long")).drop("__own", "__before", "__top", "__part")


def firsts(spans: DataFrame) -> DataFrame:
    """tag, norm, value, ord: the first spelling of each distinct value of spans (tag, norm, value, ord)."""
    return spans.groupBy("tag", "norm").agg(F.min(F.struct("ord", "value")).alias("f")).select("tag", "norm", "f.value", "f.ord")


class Vault:
    def __init__(self, spark: SparkSession, folder: str | os.PathLike, key_file: str | os.PathLike):
        self.spark, self.folder = spark, Path(folder)
        if not self.folder.exists():
            self.folder.mkdir(parents=True, mode=0o700)
        self.manifest = self.folder / "MANIFEST.json"
        key_file = Path(key_file)
        if not key_file.exists():
            key_file.parent.mkdir(parents=True, exist_ok=True, mode=0o700)
            with open(os.open(key_file, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "wb") as f:
                f.write(secrets.token_bytes(KEY_BYTES))
        master = key_file.read_bytes()
        if len(master) != KEY_BYTES:
            raise VaultError(f"the key must be {KEY_BYTES} bytes long")
        index, seal = (hmac.new(master, label, hashlib.sha256).digest() for label in (INDEX_LABEL, SEAL_LABEL))
        pad = index.ljust(64, b"\0")
        row = (bytearray(b ^ 0x36 for b in pad), bytearray(b ^ 0x5C for b in pad), bytearray(seal))
        #: One row, always: broadcast without further ado.
        self.keys = F.broadcast(spark.createDataFrame([row], "k_in binary, k_out binary, k_seal binary"))

    @contextlib.contextmanager
    def locked(self):
        with open(os.open(self.folder / "LOCK", os.O_RDWR | os.O_CREAT, 0o600), "w") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            yield

    def batches(self) -> list[str]:
        return json.loads(self.manifest.read_text())["batches"] if self.manifest.exists() else []

    def _commit(self, batches: list[str]) -> None:
        part = self.folder / f".{uuid.uuid4().hex}"
        with open(os.open(part, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w") as f:
            json.dump({"batches": batches}, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, self.manifest)

    def mappings(self, batches: list[str] | None = None) -> DataFrame:
        """The sealed table: tag, seq, index_hash, nonce, ciphertext, created_at; of the visible batches, or those given."""
        paths = [f"file://{self.folder.resolve()}/{b}" for b in (self.batches() if batches is None else batches)]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def entries(self) -> DataFrame:
        """tag, seq, created_at by tag and number; neither values nor keys are read."""
        return self.mappings().select("tag", "seq", "created_at").orderBy("tag", "seq")

    def _hash(self) -> Column:
        message = F.concat(F.encode("tag", "UTF-8"), F.lit(bytearray(1)), F.encode("norm", "UTF-8"))
        inner = F.unhex(F.sha2(F.concat(F.col("k_in"), message), 256))
        return F.unhex(F.sha2(F.concat(F.col("k_out"), inner), 256))

    def _bound(self) -> Column:
        return F.concat(F.encode("tag", "UTF-8"), F.lit(bytearray(1)), F.encode(F.col("seq").cast("string"), "UTF-8"))

    def hashed(self, values: DataFrame) -> DataFrame:
        return values.crossJoin(self.keys.select("k_in", "k_out")).withColumn("index_hash", self._hash()).drop("k_in", "k_out")

    def allocate(self, values: DataFrame) -> DataFrame:
        """tag, norm, seq of every value of values (tag, norm, value, ord), old and new; new ones are sealed and stored. A column key stays.

        values may repeat, unless they have a column key; the first spelling by ord is the one that is stored. Nothing is visible before all is written.
        """
        with self.locked():
            wanted = save(self.hashed(values if "key" in values.columns else firsts(values)), "vault-wanted", ("norm", "value"))
            known = self.mappings().select("index_hash", "seq")
            new = wanted.drop("key").join(known.select("index_hash"), "index_hash", "left_anti")
            if not new.isEmpty():
                numbered = number(new, self.mappings().select("tag", "seq")).crossJoin(self.keys.select("k_seal"))
                nonce = F.unhex(F.substring(F.sha2(F.concat(F.uuid(), F.uuid()), 256), 1, 24))
                sealed = numbered.withColumn("nonce", nonce).withColumn("ciphertext", F.aes_encrypt(F.encode("value", "UTF-8"), F.col("k_seal"), F.lit("GCM"), F.lit("DEFAULT"), F.col("nonce"), self._bound()))
                name = f"batch-{uuid.uuid4().hex}"
                sealed.select("tag", "seq", "index_hash", "nonce", "ciphertext", F.current_timestamp().alias("created_at")).write.parquet(f"file://{self.folder.resolve()}/{name}")
                self.check([*self.batches(), name])
                self._commit([*self.batches(), name])
            return wanted.join(self.mappings().select("index_hash", "seq"), "index_hash").select(*(c for c in ("tag", "norm", "key", "seq") if c in (*wanted.columns, "seq")))

    def check(self, batches: list[str] | None = None) -> None:
        """Raises unless hashes are unique and so are numbers within a tag; no batch becomes visible that would break this."""
        m = self.mappings(batches)
        for keys in (["index_hash"], ["tag", "seq"]):
            if not m.groupBy(*keys).count().where("count > 1").isEmpty():
                raise VaultError(f"{', '.join(keys)} is not unique")

    def values(self, asked: DataFrame | None = None) -> DataFrame:
        """tag, seq, value; of the pairs asked for (tag, seq) only, where given. A wrong key or a moved row is an error."""
        m = self.mappings().select("tag", "seq", "ciphertext")
        if asked is not None:
            m = m.join(asked.select("tag", "seq").distinct(), ["tag", "seq"], "left_semi")
        return self.opened(m).select("tag", "seq", "value")

    def opened(self, sealed: DataFrame) -> DataFrame:
        """Rows with tag, seq and ciphertext, which may be null, with the value in place of the ciphertext."""
        value = F.aes_decrypt(F.col("ciphertext"), F.col("k_seal"), F.lit("GCM"), F.lit("DEFAULT"), self._bound())
        return sealed.crossJoin(self.keys.select("k_seal")).withColumn("value", F.decode(value, "UTF-8")).drop("k_seal", "ciphertext")

    def purge(self) -> int:
        """Forgets everything and returns how many mappings that were; numbering starts anew."""
        import shutil

        with self.locked():
            n, old = self.mappings().count(), self.batches()
            self._commit([])
            for b in old:
                shutil.rmtree(self.folder / b, ignore_errors=True)
            return n
