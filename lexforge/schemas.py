"""Schemas of the tables that the engine reads and writes, and their fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

#: Fixed values of the data model.
IMPORTANCE = ["关键", "重要", "补充"]
RELATIONS = ["prerequisite", "parallel", "contains", "applies_to"]
ACTIONS = ["merge", "keep", "remove"]
CATEGORIES = ["核心概念", "定理/定律", "方法/技术", "现象/过程"]

_VECTOR = "embedding array<float>"

TABLES: dict[str, str] = {
    "textbooks": "textbook_id string, filename string, title string, total_pages int, total_chars long",
    "chapters": "textbook_id string, ord int, chapter_id string, title string, page_start int, page_end int, content string, char_count int",
    "page_lines": "textbook_id string, page_idx int, line_idx int, text string, size double, is_bold boolean, y double",
    "toc": "book string, ord int, level int, title string, page int",
    "ocr_lines": "book string, page_idx int, line_idx int, text string, score double",
    "raw_outputs": "textbook_id string, batch_no int, chapter string, page int, raw string",
    "nodes": f"id string, name string, definition string, importance_level string, textbook_id string, chapter string, page int, {_VECTOR}, ord long",
    "edges": "textbook_id string, batch_no int, source string, target string, relation_type string, description string, ord long",
    "decisions": "decision_id string, action string, affected_nodes array<string>, affected_names array<string>, result_node string, reason string, confidence double",
    "chunks": f"chunk_id string, text string, textbook_name string, chapter_title string, page_start int, page_end int, {_VECTOR}",
    "questions": f"qid long, question string, top_k int, {_VECTOR}",
    "tree_nodes": "book string, node_id string, parent_id string, depth int, ord int, name string, page int, type string, description string",
}


def schema(name: str) -> T.StructType:
    """The schema of a table by name."""
    return T._parse_datatype_string(TABLES[name])
