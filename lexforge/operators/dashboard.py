"""What the dashboards show, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.text import choice_label, kind_label
from lexforge.operators.prefix import running

#: Parts into which the children of a parent are ranked.
SPLITS = 256


def totals(books: DataFrame) -> DataFrame:
    """Books, pages and characters in all."""
    return books.agg(F.count("*").alias("books"), F.coalesce(F.sum("total_pages"), F.lit(0)).alias("pages"), F.coalesce(F.sum("total_chars"), F.lit(0)).alias("chars"))


def overview(books: DataFrame, shown: int = 4) -> DataFrame:
    """The totals and the first titles by book id, with dots if there are more."""
    first = books.orderBy("textbook_id", "title").limit(shown + 1).agg(F.array_sort(F.collect_list(F.struct("textbook_id", F.coalesce("title", F.lit("?")).alias("t")))).alias("x"))
    titles = F.concat(F.array_join(F.transform(F.slice("x", 1, shown), lambda s: s["t"]), ", "), F.when(F.size("x") > shown, "...").otherwise(""))
    return totals(books).crossJoin(first.select(titles.alias("titles")))


def graph_data(merged: tuple[DataFrame, DataFrame] | None, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges to show: those of the merged graph if there is one, or else those of all books."""
    return merged if merged is not None else (nodes.withColumn("textbook", F.coalesce("textbook_id", F.lit("?"))), edges)


def colours(nodes: DataFrame, count: int = 7) -> DataFrame:
    """textbook_id and colour: books in order of their first node, modulo the number of colours."""
    first = nodes.groupBy("textbook_id").agg(F.min("ord").alias("first"))
    placed = running(first, [F.col("first"), F.col("textbook_id")], F.lit(0), to="_z", number="n")
    return placed.select("textbook_id", (F.col("n") % count).cast("int").alias("colour"))


def display(nodes: DataFrame) -> DataFrame:
    """id, label, size and tooltip of nodes."""
    label = F.when(F.length("name") > 8, F.concat(F.substring("name", 1, 7), F.lit("…"))).otherwise(F.col("name"))
    size = F.when(F.col("importance_level") == "关键", 28).when(F.col("importance_level") == "重要", 20).when(F.col("importance_level") == "补充", 14).otherwise(18)
    return nodes.select("id", label.alias("label"), size.alias("size"), F.substring("definition", 1, 150).alias("tooltip"))


def tree_counts(tree: DataFrame) -> DataFrame:
    """Nodes of every depth."""
    return tree.groupBy("depth").agg(F.count("*").alias("nodes"))


def choices(tree: DataFrame, most: int = 500) -> DataFrame:
    """path and label of the first entries in pre-order, with the sign of their depth; the root is none.

    ``tree`` has path (array of ord from the root), depth and name.
    """
    return tree.where("depth > 0").orderBy("path").limit(most).select("path", choice_label(F.col("depth"), F.col("name")).alias("label"))


def shown_children(tree: DataFrame, children: int = 40) -> DataFrame:
    """path, depth, parent_id and label of the entries that are drawn: no more than so many children of a parent.

    ``tree`` has path, depth, parent_id, name and type.
    """
    # the first children of each part of a parent's rows, then the first of these, so that no task sees a large parent whole
    capped = tree.withColumn("_s", F.pmod(F.xxhash64("path"), F.lit(SPLITS)))
    for by in (["parent_id", "_s"], ["parent_id"]):
        capped = capped.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("path"))).where(F.col("_n") <= children)
    return capped.select("path", "depth", "parent_id", kind_label(F.col("type"), F.col("name")).alias("label"))


def selector(tree: DataFrame) -> DataFrame:
    """path, label, value, chapter and section of the entries below the chapters, for a list that opens by chapter.

    ``tree`` has node_id, parent_id, path, depth and name; a section's items carry its name.
    """
    up = tree.select(F.col("node_id").alias("parent_id"), F.col("name").alias("above"), F.col("parent_id").alias("two_up"))
    top = tree.select(F.col("node_id").alias("two_up"), F.col("name").alias("top"))
    rows = tree.where("depth in (2, 3)").join(up, "parent_id").join(top, "two_up", "left")
    item = F.col("depth") == 3
    return rows.select("path", F.concat(F.when(item, "  ").otherwise(" "), "name").alias("label"), F.col("name").alias("value"), F.when(item, F.col("top")).otherwise(F.col("above")).alias("chapter"), F.when(item, F.col("above")).otherwise(F.col("name")).alias("section"))
