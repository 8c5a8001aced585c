"""What the two vector operators share: classes of equal vectors, and brute force for audits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import save, smallest, spread


def usable(v: Column) -> Column:
    """Not null, not empty, not zero, and all components finite."""
    v = v.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def classes(rows: DataFrame, ids: int) -> tuple[DataFrame, DataFrame]:
    """Usable rows as (vec_id, k1, k2), and their classes of equal vectors: k1, k2, cid (smallest id), dim, vec, n, ids.

    ids holds the smallest `ids` ids of the class. A class that holds most rows is summed in parts first.
    """
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + 0.0)
    good = spread(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    good = save(good.select("vec_id", v.alias("vec")).withColumn("k1", F.xxhash64("vec")).withColumn("k2", F.xxhash64(F.lit(1), "vec")), "vectors")
    part = good.groupBy("k1", "k2", (F.pmod(F.xxhash64("vec_id"), F.lit(64))).alias("salt")).agg(F.first("vec").alias("vec"), F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("vec_id")), 1, ids).alias("ids"))
    whole = part.groupBy("k1", "k2").agg(F.first("vec").alias("vec"), F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, ids).alias("ids"))
    whole = save(whole.select("k1", "k2", F.col("ids")[0].alias("cid"), F.size("vec").alias("dim"), "vec", "n", "ids"), "vector-classes")
    return good.select("vec_id", "k1", "k2"), whole


def sample(cls: DataFrame, most: int, by: str = "k1") -> pd.DataFrame:
    """cid, dim, vec of up to `most` classes, those of the smallest hashes: the same in every run. Ids come first, vectors
    of those alone after them."""
    few = smallest(cls.select("cid", by), F.xxhash64(by, "cid"), most).select("cid")
    return cls.select("cid", "dim", "vec").join(F.broadcast(few), "cid").orderBy("cid").toPandas()


def unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / big
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def against_all(cls: DataFrame, queries: pd.DataFrame, found, schema: str) -> DataFrame:
    """found(queries' ids, their vectors of one dimension, rows' columns but dim in order) -> columns of schema, for each
    block of all rows of cls (cid, dim, vec, ...)."""
    shared = cls.sparkSession.sparkContext.broadcast({d: (g["cid"].to_numpy(), np.stack(g["vec"])) for d, g in queries.groupby("dim")})
    rest = [c for c in cls.columns if c not in ("cid", "dim", "vec")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for d, g in f.groupby("dim"):
                if d in shared.value:
                    yield found(*shared.value[d], g["cid"].to_numpy(), *(g[c].to_numpy() for c in rest), np.stack(g["vec"]))

    return cls.mapInPandas(run, schema)
