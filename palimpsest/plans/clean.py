"""The flagship plan: detect, resolve, number, rewrite; and its inverse.

    documents -> spans (Arrow scan) -> disjoint spans -> distinct values -> numbers -> placeholders -> rewritten texts

Only spans are shuffled. Texts without spans go from the scan to the result; of the others, spans come back by row.
Values lie in the shared folder sealed, and only until the placeholders of the call are known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.config import Config
from palimpsest.functions.kinds import normalise, tag
from palimpsest.functions.text import placeholder
from palimpsest.operators import rewrite, vault
from palimpsest.operators.detect import Layer, detect
from palimpsest.shared import drop, keyed_hash, opened, save, spread

#: Spans up to which they are broadcast to the texts (some 60 bytes each); beyond, a shuffled join.
BROADCAST_SPANS = 1_000_000
#: What is never written to the shared folder in the clear.
SECRET = ("norm", "value")


def spans(docs: DataFrame, config: Config, id: str = "doc_id", text: str = "text", layer: Layer | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    """One row per disjoint span: id, ord (place among the document's), start, end, kind, custom, tag, norm, value.

    only: names of the recognisers whose spans are found and settled among themselves; all of them by default.
    """
    few = spread(docs.select(id, text))
    found = detect(few, config, text, "spans", layer, only, settle=True, keep=(id,)).where(F.size("spans") > 0)
    each = found.select(id, F.posexplode("spans").alias("nth", "s")).select(id, "nth", "s.start", "s.end", "s.kind", "s.custom", F.col("s.text").alias("value"))
    return each.withColumn("tag", tag(F.col("kind"), F.col("custom"))).withColumn("norm", normalise(F.col("kind"), F.col("value")))


def numbered(found: DataFrame, id: str, store: vault.Vault | None = None) -> DataFrame:
    """tag, key, seq of the values of saved spans (see _saved): those of the vault, where one is given, or of this call."""
    spans_ = found.withColumn("ord", F.struct(id, "nth"))
    if store is None:
        return vault.number(spans_.groupBy("tag", "key").agg(F.min("ord").alias("ord"))).select("tag", "key", "seq")
    return store.allocate(_first_spellings(spans_)).select("tag", "key", "seq")


def _first_spellings(spans_: DataFrame) -> DataFrame:
    """tag, key, ord, value, norm of each distinct value, opened once for each."""
    firsts = spans_.groupBy("tag", "key").agg(F.min(F.struct("ord", "kind", "value")).alias("f"))
    values = opened(firsts.select("tag", "key", "f.ord", "f.kind", "f.value"), ["value"])
    return values.withColumn("norm", normalise(F.col("kind"), F.col("value"))).drop("kind")


def _saved(found: DataFrame, id: str, values: bool) -> DataFrame:
    """Spans with a keyed hash in place of what they say; with the values, sealed, where they are asked for."""
    kept = [id, "nth", "start", "end", "tag", "key", *(["kind", "value"] if values else [])]
    return save(keyed_hash(found, ["tag", "norm"], "key").select(kept), "spans", ["value"] if values else [], open=False)


def place(found: DataFrame, numbers: DataFrame, id: str) -> DataFrame:
    """id, spans (start, end, placeholder), replaced, by_tag from spans and the numbers (tag, norm or key, seq) of their values."""
    by = ["tag", "key" if "key" in numbers.columns else "norm"]
    marked = found.join(numbers, by).select(id, F.struct("start", "end", placeholder(F.col("tag"), F.col("seq")).alias("placeholder"), "tag").alias("s"))
    each = marked.groupBy(id).agg(F.array_sort(F.collect_list("s")).alias("s"))
    tags = F.transform("s", lambda s: s["tag"])
    by_tag = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(tags)), lambda t: F.struct(t, F.size(F.filter(tags, lambda x: x == t)))))
    return each.select(id, F.transform("s", lambda s: s.dropFields("tag")).alias("spans"), F.size("s").alias("replaced"), by_tag.alias("by_tag"))


def rewritten(docs: DataFrame, placed: DataFrame, id: str, text: str) -> DataFrame:
    """docs with the text rewritten, and replaced and by_tag."""
    placed = save(placed, "placed").withColumnRenamed(id, "__id")
    placed = F.broadcast(placed) if (placed.agg(F.sum("replaced")).first()[0] or 0) <= BROADCAST_SPANS else placed
    out = docs.join(placed, F.col(id) == F.col("__id"), "left").drop("__id")
    new = F.when(F.col("spans").isNull(), F.col(text)).otherwise(rewrite.apply(F.col(text), F.col("spans")))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    return out.withColumn(text, new).drop("spans").withColumn("replaced", F.coalesce("replaced", F.lit(0))).withColumn("by_tag", F.coalesce("by_tag", none))


def clean(docs: DataFrame, config: Config, store: vault.Vault | None = None, id: str = "doc_id", text: str = "text", layer: Layer | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    """docs with every sensitive value replaced by its placeholder; columns replaced and by_tag are added.

    id must be unique. Values are numbered by id, then by place. With a vault, numbers are those of the vault, and new values are
    stored before any text is rewritten; without one they hold for this call only.
    """
    found = _saved(spans(docs, config, id, text, layer, only), id, store is not None)
    out = rewritten(docs, place(found, numbered(found, id, store), id), id, text)
    drop(found)
    return out


def clean_with_values(docs: DataFrame, config: Config, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """What clean returns without a vault, and the values (tag, seq, value) behind the placeholders."""
    found = _saved(spans(docs, config, id, text), id, True)
    values = vault.number(_first_spellings(found.withColumn("ord", F.struct(id, "nth"))).drop("norm"))
    values = save(values, "numbers", ["value"])
    out = rewritten(docs, place(found, values.select("tag", "key", "seq"), id), id, text)
    drop(found)
    return out, values.select("tag", "seq", "value")


def restore(docs: DataFrame, store: vault.Vault, id: str = "doc_id", text: str = "text", marked: bool = False) -> DataFrame:
    """docs with placeholders replaced by what the vault holds; only values that occur are opened. marked: only those with placeholders."""
    return rewrite.restore(docs, store.mappings().select("tag", "seq", "ciphertext"), id, text, marked, store.opened)


def summary(cleaned: DataFrame) -> DataFrame:
    """One row: `N replaced: TAG n, ...` over all documents, by tag."""
    each = cleaned.select(F.explode("by_tag").alias("tag", "n")).groupBy("tag").agg(F.sum("n").alias("n"))
    parts = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.array_sort(F.collect_list(F.concat_ws(" ", "tag", F.col("n").cast("string")))).alias("parts"))
    return parts.select(F.concat(F.col("total").cast("string"), F.lit(" replaced"), F.when(F.size("parts") > 0, F.concat(F.lit(": "), F.array_join("parts", ", "))).otherwise("")).alias("summary"))
