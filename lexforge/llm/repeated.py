"""Lines repeated across the documents of one source.

Counts live in small tables per source: documents in all, and documents with each
wording. New documents are counted alone and merged as a delta; which document holds
which wording is kept beside the counts, so documents that are delivered again count
once. Wordings whose share crosses the threshold, in either direction, are the only
reason to touch an old document, and only documents that hold one of them are rebuilt.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions.text import wording
from lexforge.session import keep

#: Parts into which rows of one source or one wording are split where they meet a table of sources or wordings.
SPLITS = 32
#: Keys of the tables.
DOC, LINE = ["source", "doc_no"], ["source", "line_key"]


@dataclass(frozen=True)
class LineTables:
    """sources: source, documents. lines: source, line_key, documents. holders: source, doc_no, line_key. known: source, doc_no."""

    sources: DataFrame
    lines: DataFrame
    holders: DataFrame
    known: DataFrame


def lines_of(documents: DataFrame) -> DataFrame:
    """source, doc_no, line_no and line_key of every line that has a letter; line_no counts all lines from 0.

    ``documents`` has source, doc_no and text; other columns are ignored. Null texts
    have no lines, and documents without a source are left out.
    """
    rows = documents.where("source is not null").select(*DOC, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.withColumn("words", wording(F.col("line"))).where("words <> ''").select(*DOC, "line_no", F.md5("words").alias("line_key"))


def _count(known: DataFrame, holders: DataFrame) -> LineTables:
    return LineTables(known.groupBy("source").agg(F.count("*").alias("documents")), holders.groupBy(*LINE).agg(F.count("*").alias("documents")), holders, known)


def count_lines(documents: DataFrame, lines: DataFrame | None = None) -> LineTables:
    """The tables of one batch. A document counts once for a wording, however often it is delivered or holds it."""
    found = lines_of(documents) if lines is None else lines
    return _count(documents.where("source is not null").select(*DOC).distinct(), found.select(*DOC, "line_key").distinct())


def merge(old: LineTables, batch: LineTables) -> LineTables:
    """Add what is new in the tables of a batch to the old ones; what was delivered before is known and doesn't count again."""
    new = _count(batch.known.join(old.known, DOC, "left_anti"), batch.holders.join(old.holders, [*DOC, "line_key"], "left_anti"))
    add = lambda a, b, keys: a.unionByName(b).groupBy(*keys).agg(F.sum("documents").alias("documents"))
    return LineTables(add(old.sources, new.sources, ["source"]), add(old.lines, new.lines, LINE), old.holders.unionByName(new.holders), old.known.unionByName(new.known))


def _split(rows: DataFrame, by: str) -> DataFrame:
    return rows.withColumn("_s", F.pmod(F.xxhash64(by), F.lit(SPLITS)).cast("int"))


def _each(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))))


def repeated(tables: LineTables, share_numerator: int = 1, share_denominator: int = 4) -> DataFrame:
    """source and line_key of wordings in at least the share of the source's documents."""
    both = _split(tables.lines, "line_key").join(_each(tables.sources.withColumnRenamed("documents", "of")), ["source", "_s"])
    return both.where(F.col("documents") * share_denominator >= F.col("of") * share_numerator).select(*LINE)


def crossings(before: DataFrame, after: DataFrame) -> DataFrame:
    """source, line_key and now_repeated of wordings that crossed the threshold either way."""
    return after.join(before, LINE, "left_anti").withColumn("now_repeated", F.lit(True)).unionByName(before.join(after, LINE, "left_anti").withColumn("now_repeated", F.lit(False)))


def _with_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose wording is among the keys; a wording of many documents is split."""
    return _split(rows, "doc_no").join(_each(keys.select(*LINE)), [*LINE, "_s"], "left_semi").drop("_s")


def found_lines(documents: DataFrame, keys: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """source, doc_no and line_no of the lines with a wording in ``keys``; repeated deliveries count once."""
    return _with_keys(lines_of(documents) if lines is None else lines, keys).select(*DOC, "line_no").distinct()


def documents_to_rebuild(holders: DataFrame, crossed: DataFrame) -> DataFrame:
    """source and doc_no of documents that hold a wording that crossed."""
    return _with_keys(holders, crossed).select(*DOC).distinct()


def without_lines(documents: DataFrame, repeated_keys: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """source, doc_no, text: the documents without their repeated lines, each once.

    Null texts stay null, a text of repeated lines only becomes empty; deliveries of a
    document that differ give the largest text.
    """
    found = found_lines(documents, repeated_keys, lines).groupBy(*DOC).agg(F.collect_list("line_no").alias("gone"))
    once = documents.where("source is not null").groupBy(*DOC).agg(F.max("text").alias("text"))
    parts = F.split("text", "\n")
    kept = F.filter(F.transform(parts, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: ~F.array_contains("gone", p["i"]))
    return once.join(found, DOC, "left").select(*DOC, F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda p: p["x"]), "\n")).alias("text"))


def no_lines(documents: DataFrame) -> LineTables:
    """Tables before any batch."""
    known = documents.select(F.col("source").cast("string").alias("source"), "doc_no").limit(0)
    return _count(known, known.withColumn("line_key", F.lit("")))


def save(tables: LineTables, path: str) -> None:
    """Write the tables below a folder, for the next batch; not over the folder they were loaded from."""
    for name in ("sources", "lines", "holders", "known"):
        getattr(tables, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> LineTables:
    """The tables of save."""
    return LineTables(*(spark.read.parquet(f"{path}/{name}") for name in ("sources", "lines", "holders", "known")))


def _settled(tables: LineTables) -> LineTables:
    return LineTables(keep(tables.sources), keep(tables.lines), keep(tables.holders), keep(tables.known))


def update(old: LineTables, new_documents: DataFrame, lines: DataFrame | None = None) -> tuple[LineTables, DataFrame]:
    """Merge new documents into the tables; gives the new tables and the crossings."""
    now = _settled(merge(old, count_lines(new_documents, lines)))
    return now, keep(crossings(repeated(old), repeated(now)))


@dataclass(frozen=True)
class Cleaned:
    """What is there after some batches: the count tables, the documents' lines, the documents, and which wordings are repeated."""

    tables: LineTables
    lines: DataFrame
    documents: DataFrame
    keys: DataFrame
    #: source, doc_no, text of the cleaned documents; source, doc_no of those that the last batch rebuilt.
    texts: DataFrame | None = None
    touched: DataFrame | None = None


def add_batch(before: Cleaned | None, batch: DataFrame, clean: bool = True) -> Cleaned:
    """Take in one more batch of documents.

    The batch's lines are read once. Of the documents that were there only those are
    built again that hold a wording which crossed the threshold, or were delivered again.
    """
    batch = batch.select(*DOC, "text")
    lines = keep(lines_of(batch))
    old = before.tables if before else no_lines(batch)
    tables, crossed = update(old, batch, lines)
    keys = crossed.where("now_repeated").select(*LINE)
    if before:
        keys = keep(before.keys.join(crossed.where("not now_repeated"), LINE, "left_anti").unionByName(keys))
        lines, documents = before.lines.unionByName(lines), before.documents.unionByName(batch)
    else:
        documents = batch
    out = Cleaned(tables, lines, documents, keys)
    if not clean:
        return out
    again = documents_to_rebuild(tables.holders, crossed).unionByName(batch.where("source is not null").select(*DOC)).distinct()
    touched = keep(again)
    fresh = without_lines(documents.join(touched, DOC, "left_semi"), keys, lines.join(touched, DOC, "left_semi"))
    texts = fresh if before is None or before.texts is None else before.texts.join(touched, DOC, "left_anti").unionByName(fresh)
    return replace(out, texts=keep(texts), touched=touched)
