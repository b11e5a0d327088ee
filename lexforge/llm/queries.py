"""Queries of the operators for training data."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions.text import node_key, strip
from lexforge.llm import groups, mixing, neighbours, packing, quality, repeated, scans, survivors, tokens
from lexforge.llm.sql import SQL
from lexforge.session import cut, table


def node_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(table(spark, d, "nodes").withColumn("id", node_key(F.col("id"))))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The best record of every concept that at least two node ids record."""
    return node_survivors(spark, d).where("n_ids > 1").select("first_id", "best_id")


def p1_survivors(spark: SparkSession, d: str) -> DataFrame:
    """One record per concept, field by field."""
    return node_survivors(spark, d)


def book_texts(spark: SparkSession, d: str, pdf: bool) -> DataFrame:
    """source, doc_no and text of chapters of books whose filename ends in pdf, or of the others."""
    books = table(spark, d, "textbooks").groupBy("textbook_id").agg(F.max(F.lower("filename")).alias("name"))
    kind = F.coalesce(F.col("name").endswith("pdf"), F.lit(False))
    books = books.where(kind if pdf else ~kind).select("textbook_id")
    return table(spark, d, "chapters").join(books, "textbook_id", "left_semi").select(F.col("textbook_id").alias("source"), F.col("ord").alias("doc_no"), F.col("content").alias("text"))


def deliveries(texts: DataFrame, count: int = 2) -> list[DataFrame]:
    """All documents, as so many deliveries that come one after the other."""
    which = F.pmod(F.xxhash64("source", "doc_no"), F.lit(count))
    return [texts.where(which == k) for k in range(count)]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines whose wording stands in at least a quarter of a book's chapters, after two deliveries."""
    state = None
    for batch in deliveries(book_texts(spark, d, pdf=False)):
        state = repeated.add_batch(state, batch, clean=False)
    return repeated.found_lines(state.documents, state.keys, state.lines).select(F.col("source").alias("textbook_id"), F.col("doc_no").alias("ord"), "line_no")


def p2_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """The chapters without those lines, after two deliveries."""
    state = None
    for batch in deliveries(book_texts(spark, d, pdf=False)):
        state = repeated.add_batch(state, batch)
    return state.texts.select(F.col("source").alias("textbook_id"), F.col("doc_no").alias("ord"), F.col("text").alias("content"))


def scanned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chapters of books whose filename ends in pdf, the books, and the other chapters."""
    books = table(spark, d, "textbooks").where(F.lower("filename").endswith("pdf"))
    ids, chapters = books.select("textbook_id").distinct(), table(spark, d, "chapters")
    return chapters.join(ids, "textbook_id", "left_semi"), books, chapters.join(ids, "textbook_id", "left_anti")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of scanned chapters that are furniture, end in a cut word, or hold a misread character."""
    return scans.describe_lines(*scanned(spark, d))


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    """Scanned chapters in continuous paragraphs."""
    return scans.restore(*scanned(spark, d)).select("textbook_id", "ord", F.col("text").alias("content"))


def merge_links(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "decisions").where(F.lower(strip(F.col("action"))) == "merge")
    ids = F.transform(F.concat(F.coalesce("affected_nodes", F.array().cast("array<string>")), F.array("result_node")), node_key)
    return groups.star_links(rows, ids)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups of node ids that merge decisions link."""
    return groups.hash_to_min(merge_links(spark, d))


#: Components of a usable embedding.
DIM = 64


def node_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").select(node_key(F.col("id")).alias("id"), "embedding", "ord")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of nodes with a cosine of at least 0.90."""
    pairs = neighbours.search(node_vectors(spark, d), DIM, least=0.90, probes=16, margin=0.05)
    return pairs.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p7_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar nodes of every node whose ord is divisible by 20."""
    vectors = node_vectors(spark, d)
    # each asker travels to every list it probes, so lists grow with the root of the vectors
    lists = max(1, round(math.sqrt(vectors.count()) / 6))
    near = neighbours.search(vectors, DIM, k=10, asks="ord % 20 = 0", index=neighbours.fit(vectors, DIM, lists=lists))
    return near.select("id", "other", F.round("cosine", 4).alias("cosine"))


def p7_links(spark: SparkSession, d: str) -> DataFrame:
    """Every node with its class of equal embeddings, and how many others have a cosine of at least 0.90 with it."""
    return neighbours.linked(node_vectors(spark, d), DIM, least=0.90, probes=16, margin=0.08)[0]


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    """All documents packed into containers of every kind."""
    sizes = cut(tokens.count_tokens(table(spark, d, "documents")))
    kinds = sorted((r.container_kind, r.capacity_tokens) for r in table(spark, d, "containers").collect())
    parts = [packing.pack(sizes, capacity).select(F.lit(kind).alias("container_kind"), "*") for kind, capacity in kinds]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of every kind are."""
    caps = table(spark, d, "containers")
    per = p8_packing(spark, d).groupBy("container_kind").agg(F.countDistinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    return per.join(F.broadcast(caps), "container_kind").select("container_kind", "containers", "tokens", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("unused_share"))


def drawn_documents(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokens.count_tokens(table(spark, d, "documents"), keep=("source",))
    return mixing.mix(sizes, table(spark, d, "source_targets"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Copies of every document that each mix draws."""
    return drawn_documents(spark, d)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that each mix reaches."""
    return mixing.shares(drawn_documents(spark, d), table(spark, d, "source_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that aren't prose."""
    return quality.describe(table(spark, d, "documents")).where("text_type <> 'prose'").select("doc_id").distinct()


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics and text type of every document."""
    return quality.describe(table(spark, d, "documents"))


def p10_agreement(spark: SparkSession, d: str) -> DataFrame:
    """The learnt types of documents against those that raters gave."""
    return quality.agreement(quality.describe(table(spark, d, "documents")), table(spark, d, "doc_labels"))


__all__ = ["QUERIES", "SQL"]

QUERIES = {f.__name__: f for f in (p1_found, p1_survivors, p2_found, p2_cleaned, p4_found, p4_restored, p5_found, p7_found, p7_neighbours, p7_links, p8_packing, p8_report, p9_mixture, p9_shares, p10_found, p10_statistics, p10_agreement)}
