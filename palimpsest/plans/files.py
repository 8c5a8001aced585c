"""Cleaning files: listing, conversion, names, review and restoring in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.config import Config
from palimpsest.operators import rewrite
from palimpsest.operators.detect import Layer
from palimpsest.operators.vault import Vault
from palimpsest.plans.clean import SECRET, place, restore, rewritten, spans
from palimpsest.shared import save
from palimpsest.sources import listing, readers, sinks
from palimpsest.sources.formats import ConversionError

#: Order in which a file's values are numbered: its name, then of each part the sheet's name and the text.
STEM, SHEET, BODY = 0, 1, 2


def parts_of(spark: SparkSession, paths: list[str], recursive: bool = False, ocr: readers.Ocr | None = None, permissive: bool = False) -> tuple[DataFrame, int]:
    """Parts of all inputs, and the number of skipped files. The first failure is raised unless permissive: then it is a row with its error."""
    inputs, skipped = listing.resolve(paths, recursive)
    parts = save(readers.read(listing.frame(spark, inputs), ocr), "parts", ("path", "root", "sheet_name", "text", "error"))
    bad = parts.where("error is not null").orderBy("input_ord").take(1)
    if bad and not permissive:
        raise ConversionError(bad[0].error)
    return parts, skipped


def pieces(parts: DataFrame) -> DataFrame:
    """Everything of a file that is searched, as rows of texts with an id that orders them."""
    good = parts.where("error is null").withColumn("stem", sinks.stem(F.col("path")))
    body = good.select("input_ord", "part_ord", F.lit(BODY).alias("source"), "text")
    sheet = good.where("sheet_name is not null").select("input_ord", "part_ord", F.lit(SHEET).alias("source"), F.col("sheet_name").alias("text"))
    name = good.groupBy("input_ord").agg(F.first("stem").alias("text")).select("input_ord", F.lit(-1).alias("part_ord"), F.lit(STEM).alias("source"), "text")
    return body.unionByName(sheet).unionByName(name).withColumn("id", F.struct("input_ord", "part_ord", "source"))


def review(parts: DataFrame, config: Config, layer: Layer | None = None) -> DataFrame:
    """The decisions of a review: one row per span of a text, all accepted, with the line it stands in.

    A reviewer edits `accepted`; values whose every span is rejected never enter the vault.
    """
    texts = pieces(parts).where(F.col("source") == BODY)
    found = spans(texts, config, "id", "text", layer)
    lines = found.join(texts.select("id", "text"), "id")
    before = F.substring_index(F.substring("text", 1, F.col("start")), "\n", -1)
    after = F.substring_index(F.substring(F.col("text"), F.col("end") + 1, F.length("text")), "\n", 1)
    return lines.withColumn("context", F.trim(F.concat(before, "value", after))).withColumn("accepted", F.lit(True)).drop("text")


def clean_files(
    spark: SparkSession, paths: list[str], config: Config, store: Vault, out_dir: str | None = None, recursive: bool = False,
    layer: Layer | None = None, ocr: readers.Ocr | None = None, decisions: DataFrame | None = None, permissive: bool = False,
) -> tuple[DataFrame, int]:
    """Writes cleaned copies of files and folders; returns destination, replaced, by_tag of each, and how many files were skipped.

    Colliding destinations are an error before any value is numbered. decisions: what review() returned, edited.
    """
    parts, skipped = parts_of(spark, paths, recursive, ocr, permissive)
    texts = pieces(parts)
    if not config.redact_filenames:
        texts = texts.where(F.col("source") == BODY)
    plain = parts.where("error is null").withColumn("name", sinks.stem(F.col("path")))
    sinks.ensure_distinct(plain.where("sheet_name is null").withColumn("destination", sinks.destination(F.col("path"), F.col("root"), F.col("format"), F.col("name"), F.lit(None).cast("string"), out_dir)))
    found = spans(texts, config, "id", "text", layer)
    if decisions is not None:
        refused = decisions.where("not accepted").select("id", "start", "end")
        found = found.join(refused, ["id", "start", "end"], "left_anti")
    found = save(found, "file-spans", SECRET)
    order = F.struct(F.col("id.input_ord"), F.when(F.col("id.source") == STEM, -1).otherwise(F.col("id.part_ord")).alias("part"), F.col("id.source"), F.col("nth"))
    numbers = store.allocate(found.select("tag", "norm", "value", order.alias("ord")))
    done = save(rewritten(texts, place(found, numbers, "id"), "id", "text"), "file-texts")
    body = done.where(F.col("source") == BODY).select("input_ord", "part_ord", "text", "replaced", "by_tag")
    names = done.where(F.col("source") == STEM).select("input_ord", sinks.redacted_stem(F.col("text")).alias("new_name"))
    sheets = done.where(F.col("source") == SHEET).select("input_ord", "part_ord", sinks.redacted_stem(F.col("text")).alias("new_sheet"))
    out = plain.drop("text").join(body, ["input_ord", "part_ord"]).join(names, "input_ord", "left").join(sheets, ["input_ord", "part_ord"], "left")
    out = out.withColumn("fragment", F.when(F.col("sheet_name").isNotNull(), sinks.sheet_fragment(F.coalesce("new_sheet", "sheet_name"), F.col("sheet_index"))))
    books = sinks.unique_fragments(out.where("fragment is not null").select("input_ord", "part_ord", "sheet_index", "fragment")).select("input_ord", "part_ord", F.col("fragment").alias("unique"))
    out = out.join(books, ["input_ord", "part_ord"], "left").withColumn("name", F.coalesce("new_name", "name"))
    out = save(out.withColumn("destination", sinks.destination(F.col("path"), F.col("root"), F.col("format"), F.col("name"), F.col("unique"), out_dir)), "file-outputs", ("path", "root", "name", "sheet_name"))
    sinks.ensure_distinct(out)
    sinks.write(out).count()
    return out.select("path", "destination", "replaced", "by_tag"), skipped


def restore_file(spark: SparkSession, path: str, store: Vault, in_place: bool = True) -> tuple[str, int, int]:
    """The restored text and how many placeholders were and weren't known; the file is replaced at once or not at all."""
    with open(path, encoding="utf-8", newline="") as f:
        df = spark.createDataFrame([(0, f.read())], "doc_id int, text string")
    r = restore(df, store).first()
    if in_place:
        sinks.write_atomic(path, r.text.encode())
    return r.text, r.restored, r.unknown


__all__ = ["clean_files", "parts_of", "pieces", "restore_file", "review", "rewrite"]
