"""Queries of the general operators on linked records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions.text import BLANKS, node_key, strip
from lexforge.operators import hierarchy, orphans
from lexforge.session import table


def contains_links(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "edges").where(F.lower(strip(F.col("relation_type"))) == "contains")
    return edges.select(node_key(F.col("source")).alias("parent"), node_key(F.col("target")).alias("child"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Nodes on cycles of contains links."""
    return hierarchy.cycles(contains_links(spark, d))


def p3_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Path, depth, root and number of descendants of every node with contains links."""
    return hierarchy.hierarchy(contains_links(spark, d))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every node below every other along the paths."""
    return hierarchy.descendants(hierarchy.hierarchy(contains_links(spark, d)))


def p3_all_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every node that another leads to over contains links, over any parent and through cycles."""
    return hierarchy.all_descendants(contains_links(spark, d))


def p3_descendant_counts(spark: SparkSession, d: str) -> DataFrame:
    """Number of all those descendants of every node with contains links."""
    return hierarchy.descendant_counts(contains_links(spark, d))


def edge_references(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "edges")
    ends = F.explode(F.array(*[F.struct(F.lit(x).alias("endpoint"), node_key(F.col(x)).alias("key")) for x in ("source", "target")]))
    return edges.select(F.col("ord").alias("ref_id"), F.col("loaded_at").alias("at"), F.date_format("loaded_at", "yyyy-MM").alias("period"), ends.alias("end")).select("ref_id", "at", "period", "end.endpoint", "end.key")


def node_parents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").select(node_key(F.col("id")).alias("key"), F.col("loaded_at").alias("at"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Edge ends that name no node."""
    states = orphans.resolve_references(edge_references(spark, d), node_parents(spark, d))
    return states.where("state = 'missing'").select(F.col("ref_id").alias("ord"), "endpoint").distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, end and month of loading."""
    states = orphans.resolve_references(edge_references(spark, d), node_parents(spark, d))
    return orphans.report(states, "edges")


QUERIES = {f.__name__: f for f in (p3_found, p3_hierarchy, p3_descendants, p3_all_descendants, p3_descendant_counts, p6_found, p6_report)}

_WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||" + "||".join(f"chr({ord(c)})" for c in BLANKS if ord(c) > 126)


def sql_key(col: str) -> str:
    return f"nullif(lower(trim({col}, {_WS})), '')"


_LINKS = f"""links AS (SELECT DISTINCT {sql_key("source")} AS parent, {sql_key("target")} AS child FROM edges
  WHERE lower(trim(relation_type, {_WS})) = 'contains' AND {sql_key("source")} IS NOT NULL AND {sql_key("target")} IS NOT NULL)"""

_TREE = f"""WITH RECURSIVE {_LINKS},
reach AS (SELECT parent AS a, child AS b FROM links UNION SELECT r.a, l.child FROM reach r JOIN links l ON l.parent = r.b),
ring AS (SELECT a AS node_id FROM reach WHERE a = b),
part AS (SELECT n.node_id, least(n.node_id, min(coalesce(y.a, n.node_id))) AS cycle_id FROM ring n LEFT JOIN reach x ON x.a = n.node_id LEFT JOIN reach y ON y.a = x.b AND y.b = n.node_id GROUP BY n.node_id),
ups AS (SELECT child, count(*) AS n_parents, coalesce(min(parent) FILTER (WHERE parent NOT IN (SELECT node_id FROM ring)), min(parent)) AS best FROM links WHERE parent <> child GROUP BY child),
tree AS (SELECT child, best FROM ups WHERE child NOT IN (SELECT node_id FROM ring)),
nodes_ AS (SELECT parent AS node_id FROM links UNION SELECT child FROM links),
paths AS (SELECT node_id, [node_id] AS path FROM nodes_ WHERE node_id NOT IN (SELECT child FROM tree) UNION ALL SELECT t.child, list_append(p.path, t.child) FROM paths p JOIN tree t ON t.best = p.node_id),
below AS (SELECT node_id, count(*) AS n FROM (SELECT unnest(path[1:len(path) - 1]) AS node_id FROM paths) GROUP BY 1)"""

SQL = {
    "p3_hierarchy": f"""{_TREE} SELECT p.node_id, p.path[len(p.path) - 1] AS parent_id, coalesce(u.n_parents, 0) AS n_parents, p.path[1] AS root_id, CAST(len(p.path) - 1 AS INTEGER) AS depth, p.path,
  coalesce(b.n, 0) AS n_descendants, r.cycle_id FROM paths p LEFT JOIN ups u ON u.child = p.node_id LEFT JOIN below b USING (node_id) LEFT JOIN part r USING (node_id)""",
    "p3_descendants": f"""{_TREE}, places AS (SELECT node_id, path, unnest(range(1, len(path))) AS i FROM paths)
SELECT path[i] AS ancestor_id, node_id, CAST(len(path) - i AS INTEGER) AS distance FROM places""",
    "p3_all_descendants": f"""WITH RECURSIVE {_LINKS}, reach AS (SELECT parent AS a, child AS b FROM links UNION SELECT r.a, l.child FROM reach r JOIN links l ON l.parent = r.b)
SELECT a AS ancestor_id, b AS node_id FROM reach WHERE a <> b""",
    "p3_descendant_counts": f"""WITH RECURSIVE {_LINKS}, reach AS (SELECT parent AS a, child AS b FROM links UNION SELECT r.a, l.child FROM reach r JOIN links l ON l.parent = r.b),
nodes_ AS (SELECT parent AS node_id FROM links UNION SELECT child FROM links)
SELECT node_id, count(b) AS n_descendants FROM nodes_ LEFT JOIN reach ON a = node_id AND a <> b GROUP BY 1""",
    "p3_found": f"""WITH RECURSIVE {_LINKS},
reach AS (SELECT parent AS a, child AS b FROM links UNION SELECT r.a, l.child FROM reach r JOIN links l ON l.parent = r.b),
ring AS (SELECT a AS node_id FROM reach WHERE a = b)
SELECT least(n.node_id, min(coalesce(y.a, n.node_id))) AS cycle_id, n.node_id
FROM ring n LEFT JOIN reach x ON x.a = n.node_id LEFT JOIN reach y ON y.a = x.b AND y.b = n.node_id GROUP BY n.node_id""",
    "p6_found": f"""WITH ends AS (SELECT ord, 'source' AS endpoint, {sql_key("source")} AS k FROM edges UNION ALL SELECT ord, 'target', {sql_key("target")} FROM edges)
SELECT DISTINCT ord, endpoint FROM ends WHERE k IS NOT NULL AND k NOT IN (SELECT {sql_key("id")} FROM nodes WHERE {sql_key("id")} IS NOT NULL)""",
    "p6_report": f"""WITH ends AS (SELECT 'source' AS endpoint, {sql_key("source")} AS k, loaded_at FROM edges UNION ALL SELECT 'target', {sql_key("target")}, loaded_at FROM edges),
p AS (SELECT {sql_key("id")} AS k, min(coalesce(loaded_at, TIMESTAMP '1000-01-01')) AS since FROM nodes WHERE {sql_key("id")} IS NOT NULL GROUP BY 1)
SELECT 'edges' AS table_name, endpoint, strftime(loaded_at, '%Y-%m') AS period, count(*) AS reference_rows,
  count(*) FILTER (WHERE p.k IS NULL) AS missing_rows, count(*) FILTER (WHERE p.since > ends.loaded_at) AS later_rows
FROM ends LEFT JOIN p ON p.k = ends.k WHERE ends.k IS NOT NULL GROUP BY 1, 2, 3""",
}
