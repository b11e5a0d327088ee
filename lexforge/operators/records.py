"""Answers of the extraction step to checked, numbered and deduplicated records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions.text import json_body, strip
from lexforge.operators.prefix import running
from lexforge.schemas import CATEGORIES, IMPORTANCE, RELATIONS

_NODE = "array<struct<local_id: string, name: string, definition: string, importance_level: string, page: string>>"
_EDGE = "array<struct<source: string, target: string, relation_type: string, description: string>>"


def _variant(raw_outputs: DataFrame) -> DataFrame:
    return raw_outputs.withColumn("_v", F.try_parse_json(json_body(F.col("raw"))))


def _items(raw_outputs: DataFrame) -> DataFrame:
    return _variant(raw_outputs).select("textbook_id", "batch_no", "chapter", F.col("page").alias("batch_page"), F.posexplode(F.try_variant_get("_v", "$.nodes", "array<variant>")).alias("pos", "item"))


def _text(name: str) -> Column:
    return F.try_variant_get("item", f"$.{name}", "string")


def _kind(name: str) -> Column:
    """A field that is missing has no type, one that is null has the type of null."""
    return F.schema_of_variant(F.try_variant_get("item", f"$.{name}", "variant"))


def _field(name: str, default: str) -> Column:
    return F.when(_kind(name).isNull(), F.lit(default)).otherwise(_text(name))


def _page() -> Column:
    """The page of an item, that of its batch if it names none, null if it is no whole number."""
    page = _text("page").try_cast("double")
    return F.when(_kind("page").isNull(), F.col("batch_page")).when(page == F.floor(page), page.cast("int"))


def parsed_nodes(raw_outputs: DataFrame) -> DataFrame:
    """textbook_id, batch_no, pos, local_id, name, definition, importance_level, chapter, page of valid nodes.

    A missing name, definition or level takes its default, an explicit null or a level
    outside the vocabulary drops the node; a missing page is the batch's, one that is
    no whole number drops the node. Answers that are no JSON have no nodes.
    """
    items = _items(raw_outputs)
    text, field, whole = _text, _field, _page()
    checked = items.select(
        "textbook_id", "batch_no", "pos", text("local_id").alias("local_id"),
        F.substring(field("name", ""), 1, 20).alias("name"), F.substring(field("definition", ""), 1, 300).alias("definition"),
        field("importance_level", IMPORTANCE[1]).alias("importance_level"), "chapter", whole.alias("page"),
    )
    return checked.where(F.col("name").isNotNull() & F.col("definition").isNotNull() & F.col("page").isNotNull() & F.col("importance_level").isin(IMPORTANCE))


def parsed_edges(raw_outputs: DataFrame) -> DataFrame:
    """textbook_id, batch_no, pos, source, target, relation_type, description of edges whose ends the same answer names."""
    v = _variant(raw_outputs)
    names = F.transform(F.coalesce(F.try_variant_get("_v", "$.nodes", _NODE), F.array().cast(_NODE)), lambda n: F.coalesce(n["local_id"], F.lit("")))
    items = v.select("textbook_id", "batch_no", names.alias("names"), F.posexplode(F.try_variant_get("_v", "$.edges", _EDGE)).alias("pos", "e"))
    kept = items.where(F.array_contains("names", F.col("e.source")) & F.array_contains("names", F.col("e.target")))
    out = kept.select("textbook_id", "batch_no", "pos", "e.source", "e.target", F.coalesce("e.relation_type", F.lit(RELATIONS[1])).alias("relation_type"), F.substring(F.coalesce("e.description", F.lit("")), 1, 50).alias("description"))
    return out.where(F.col("relation_type").isin(RELATIONS))


def token_estimate(raw_outputs: DataFrame) -> DataFrame:
    """Half the characters of all answers, by book."""
    return raw_outputs.groupBy("textbook_id").agg(F.sum(F.floor(F.length("raw") / 2)).alias("tokens"))


def numbered(nodes: DataFrame) -> DataFrame:
    """Nodes with an id of the book and a number over its batches, and ord over all."""
    placed = running(nodes, [F.col("textbook_id"), F.col("batch_no"), F.col("pos")], F.lit(0), to="_z", number="ord").drop("_z")
    first = placed.groupBy("textbook_id").agg(F.min("ord").alias("first"))
    return placed.join(first, "textbook_id").withColumn("id", F.format_string("%s_n%04d", "textbook_id", F.col("ord") - F.col("first") + 1)).drop("first")


def resolved_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose local ends became node ids, pointing at the node that survives deduplication.

    ``nodes`` are numbered, with local_id and batch_no; a name's first node in the book survives.
    """
    key = strip(F.col("name"))
    lasting = nodes.groupBy("textbook_id", key.alias("key")).agg(F.min_by("id", "ord").alias("lasting"))
    ids = nodes.select("textbook_id", "batch_no", "local_id", key.alias("key")).join(lasting, ["textbook_id", "key"]).select("textbook_id", "batch_no", "local_id", "lasting")
    out = edges
    for end in ("source", "target"):
        out = out.join(ids.withColumnRenamed("local_id", end).withColumnRenamed("lasting", f"{end}_id"), ["textbook_id", "batch_no", end])
    return out.drop("source", "target").withColumnsRenamed({"source_id": "source", "target_id": "target"})


def deduplicated_nodes(nodes: DataFrame) -> DataFrame:
    """One node for each stripped name of a book: the first one's id and name, the longest definition, critical if any is, the least page."""
    critical = F.lit(IMPORTANCE[0])
    return (
        nodes.groupBy("textbook_id", strip(F.col("name")).alias("key"))
        .agg(
            F.min_by(F.struct("id", "name", "chapter", "importance_level"), "ord").alias("first"),
            F.max_by("definition", F.struct(F.length("definition"), -F.col("ord"))).alias("definition"),
            F.bool_or(F.col("importance_level") == critical).alias("any_critical"),
            F.min("page").alias("page"),
            F.min("ord").alias("ord"),
        )
        .select("first.id", "first.name", "definition", F.when(F.col("any_critical"), critical).otherwise(F.col("first.importance_level")).alias("importance_level"), "textbook_id", "first.chapter", "page", "ord")
    )


def deduplicated_edges(edges: DataFrame, within: list[str]) -> DataFrame:
    """One edge for each source, target and relation, with the first description."""
    return edges.groupBy(*within, "source", "target", "relation_type").agg(F.min_by(F.struct("description"), "ord").alias("d"), F.min("ord").alias("ord")).select(*within, "source", "target", "relation_type", "d.description", "ord")


def legacy_nodes(raw_outputs: DataFrame) -> DataFrame:
    """textbook_id, batch_no, pos, id, name, definition, category, chapter, page of valid nodes of answers about whole chapters.

    A name is needed. A missing id is made of the node's place, a missing definition is
    empty, a missing category the first of the vocabulary and a missing page the
    chapter's; an explicit null, another category or a page that is no whole number
    drops the node. Texts keep their length.
    """
    checked = _items(raw_outputs).select(
        "textbook_id", "batch_no", "pos", F.when(_kind("id").isNull(), F.format_string("node_%03d", "pos")).otherwise(_text("id")).alias("id"), _text("name").alias("name"),
        _field("definition", "").alias("definition"), _field("category", CATEGORIES[0]).alias("category"), "chapter", _page().alias("page"),
    )
    whole = [F.col(c).isNotNull() for c in ("id", "name", "definition", "page")]
    return checked.where(whole[0] & whole[1] & whole[2] & whole[3] & F.col("category").isin(CATEGORIES))


def legacy_edges(raw_outputs: DataFrame, nodes: DataFrame) -> DataFrame:
    """textbook_id, batch_no, pos, source, target, relation_type, description of edges between valid nodes of the same answer."""
    items = _variant(raw_outputs).select("textbook_id", "batch_no", F.posexplode(F.try_variant_get("_v", "$.edges", "array<variant>")).alias("pos", "item"))
    rows = items.select("textbook_id", "batch_no", "pos", _text("source").alias("source"), _text("target").alias("target"), _field("relation_type", RELATIONS[1]).alias("relation_type"), _field("description", "").alias("description"))
    rows = rows.where(F.col("relation_type").isin(RELATIONS) & F.col("description").isNotNull())
    ids = nodes.select("textbook_id", "batch_no", "id").distinct()
    for end in ("source", "target"):
        rows = rows.join(ids.withColumnRenamed("id", end), ["textbook_id", "batch_no", end], "left_semi")
    return rows


def is_answer(raw: Column) -> Column:
    """Whether an answer holds a JSON object, so that it need not be asked for again."""
    return F.try_parse_json(json_body(raw)).isNotNull()
