"""Cleaning a landing folder as a stream: each micro-batch allocates under the vault's lock, then appends its texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from palimpsest.config import Config
from palimpsest.operators.vault import Vault
from palimpsest.plans.clean import clean
from palimpsest.plans.tools import clean_json
from palimpsest.shared import drop, save

#: Micro-batches are folders of their own, so a repeated batch replaces what it wrote before.
BATCH = "batch"


def clean_stream(source: DataFrame, config: Config, store: Vault, out: str, checkpoint: str, id: str = "doc_id", text: str = "text", once: bool = True) -> StreamingQuery:
    """Cleans a stream of texts into Parquet below out, a folder per batch. A rerun of a batch gives the same placeholders."""

    def batch(df: DataFrame, n: int) -> None:
        clean(df, config, store, id, text).write.mode("overwrite").parquet(f"{out}/{BATCH}={n}")

    return _start(source, batch, checkpoint, once)


def clean_json_stream(spark: SparkSession, folder: str, config: Config, store: Vault, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Lines of JSON from a folder, their strings cleaned, each line a row; one that is no JSON is a row with an error, and the stream goes on."""
    lines = spark.readStream.schema(T.StructType([T.StructField("value", T.StringType())])).text(folder)

    def batch(df: DataFrame, n: int) -> None:
        # saved once: the numbers of rows must not change between the passes over them
        rows = save(df.select(F.monotonically_increasing_id().alias("id"), F.col("value").alias("payload")), "landing", ("payload",))
        done = clean_json(rows, config, store)
        error = F.when(F.col("payload").isNull(), F.lit("not valid JSON"))
        done.select("id", "payload", error.alias("error")).write.mode("overwrite").parquet(f"{out}/{BATCH}={n}")
        drop(rows)

    return _start(lines, batch, checkpoint, once)


def _start(source: DataFrame, batch, checkpoint: str, once: bool) -> StreamingQuery:
    w = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
