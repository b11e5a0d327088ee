"""Concepts of several books to one graph below a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions.text import compressed, domain_key
from lexforge.operators.prefix import numbered, running
from lexforge.schemas import ACTIONS, IMPORTANCE
from lexforge.session import keep

#: Share of the definitions' characters that may stay.
TARGET = 0.30


#: Number of a pair from 0 in the order of all pairs; while it is given, the pairs are narrow.
NUMBER = "no"


def numbered_pairs(pairs: DataFrame) -> DataFrame:
    return numbered(pairs, [F.col("a_ord"), F.col("b_ord")], NUMBER)


def rule_judgements(pairs: DataFrame, nodes: DataFrame, same_from: float) -> DataFrame:
    """Pairs with is_same, confidence, action and best_source as a judge without a model gives them: by similarity, the longer definition being the better. Numbers that pairs have stay."""
    text = nodes.select("id", "name", F.coalesce(F.length("definition"), F.lit(0)).alias("n"))
    both = pairs.join(text.withColumnsRenamed({"id": "a", "n": "na", "name": "a_name"}), "a").join(text.withColumnsRenamed({"id": "b", "n": "nb", "name": "b_name"}), "b")
    same = F.col("similarity") >= same_from
    return both.select("a", "b", "a_ord", "b_ord", "a_name", "b_name", "similarity", same.alias("is_same"), F.lit(0.9).alias("confidence"), F.when(same, "merge").otherwise("keep").alias("action"), F.when(F.col("na") >= F.col("nb"), "a").otherwise("b").alias("best_source"), F.lit("").alias("reason"), *[c for c in pairs.columns if c == NUMBER])


def judge_prompts(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs with names and prompt, the question about a pair as one JSON object."""
    text = nodes.select("id", "name", "definition", "textbook_id")
    left, right = (text.withColumnsRenamed({"id": e, "name": f"{e}_name", "definition": f"{e}_def", "textbook_id": f"{e}_book"}) for e in "ab")
    about = lambda e: F.struct(F.col(f"{e}_name").alias("name"), F.col(f"{e}_def").alias("definition"), F.col(f"{e}_book").alias("textbook"))
    body = F.to_json(F.struct(about("a").alias("node_a"), about("b").alias("node_b"), F.round("similarity", 4).alias("similarity")), {"ignoreNullFields": "false"})
    return pairs.join(left, "a").join(right, "b").select("a", "b", "a_ord", "b_ord", "a_name", "b_name", "similarity", body.alias("prompt"))


def parsed_judgements(answers: DataFrame) -> DataFrame:
    """Answered pairs with is_same, confidence, action, best_source and reason, from the JSON object in ``raw``.

    An answer without an object, or with a broken one, keeps both nodes at a confidence
    of one half. A missing field takes its default. An action outside the vocabulary or
    a confidence outside 0 to 1 keeps both too, and the reason says so.
    """
    body = F.regexp_extract(F.coalesce("raw", F.lit("")), r"(?s)\{.*\}", 0)
    v = F.try_parse_json(F.when(body != "", body))
    rows = answers.withColumn("_v", v)
    text = lambda name: F.try_variant_get("_v", f"$.{name}", "string")
    action, confidence = F.coalesce(text("action"), F.lit("keep")), F.coalesce(text("confidence"), F.lit("0.5")).try_cast("double")
    # what counts as true: true, a number that isn't 0, a text that isn't empty
    said = text("is_same")
    same = F.coalesce(~F.lower(said).isin("false", "0", "0.0", ""), F.lit(False))
    wrong = F.when(F.col("_v").isNull(), F.when(body == "", "没有 JSON 回答").otherwise("JSON 解析失败")).when(~action.isin(ACTIONS), F.concat(F.lit("未知的操作："), action)).when(confidence.isNull() | ~confidence.between(0, 1), F.lit("置信度不在 0 到 1 之间"))
    ok = wrong.isNull()
    return rows.select(
        "a", "b", "a_ord", "b_ord", "a_name", "b_name", "similarity", F.when(ok, same).otherwise(False).alias("is_same"), F.when(ok, confidence).otherwise(0.5).alias("confidence"),
        F.when(ok, action).otherwise("keep").alias("action"), F.coalesce(text("best_source"), F.lit("a")).alias("best_source"), F.coalesce(wrong, text("reason"), F.lit("")).alias("reason"),
    )


def decisions(judged: DataFrame) -> DataFrame:
    """decision_no, decision_id, action, affected_nodes, affected_names, result_node, reason and confidence of judged pairs in their order.

    A pair merges if the judge says merge and that both are the same; the better source
    stays, a if none is named and b if another is. Everything else is kept, removals too.
    Pairs that have their number already (numbered_pairs) aren't moved again.
    """
    merge = (F.col("action") == "merge") & F.col("is_same")
    first = F.coalesce("best_source", F.lit("a")) == "a"
    rows = judged if NUMBER in judged.columns else numbered_pairs(judged)
    pair = lambda a, b: F.when(merge & ~first, F.array(b, a)).otherwise(F.array(a, b))
    return rows.select(
        (F.col(NUMBER) + 1).alias("decision_no"),
        F.format_string("%s_%04d", F.when(merge, "merge").otherwise("keep"), F.col(NUMBER) + 1).alias("decision_id"),
        F.when(merge, "merge").otherwise("keep").alias("action"),
        pair("a", "b").alias("affected_nodes"),
        pair("a_name", "b_name").alias("affected_names"),
        F.when(merge, F.when(first, F.col("a")).otherwise(F.col("b"))).alias("result_node"),
        F.when(merge, F.coalesce("reason", F.lit(""))).otherwise(F.concat(F.format_string("不同概念，各自保留。相似度 %.2f，", "similarity"), F.coalesce("reason", F.lit("")))).alias("reason"),
        F.when(merge, F.least("confidence", "similarity")).otherwise(F.col("confidence")).alias("confidence"),
    )


def kept_nodes(nodes: DataFrame, decided: DataFrame, intent: bool = True) -> DataFrame:
    """Nodes that stay: results of merges, and nodes that no decision touches.

    With ``intent`` a node of a keep decision stays too unless a merge replaced it;
    without, as observed, every touched node that is no result goes.
    """
    touched = decided.select("action", "result_node", F.explode("affected_nodes").alias("id"))
    results = touched.where("action = 'merge' and id = result_node").select("id").distinct()
    gone = touched.where("action = 'merge' and (result_node is null or id <> result_node)") if intent else touched
    free = nodes.join(gone.select("id").distinct(), "id", "left_anti").select("id")
    return nodes.join(free.union(results).distinct(), "id", "left_semi")


#: Begin of the id of the record that says definitions were shortened; it merges no nodes.
COMPRESSED = "compress_"


def budget(kept: DataFrame, original_chars: int, first_no: int = 0, target: float = TARGET) -> tuple[DataFrame, DataFrame]:
    """The kept nodes after three passes, and a decision for everything that went or was shortened.

    Supplementary nodes go first, whatever the size. If definitions then are over budget,
    those of important nodes are shortened, which is one decision that names the first
    five. Then important nodes go from the last, by id, until the budget holds. Decisions
    are numbered on from ``first_no``, the number of those before.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, IMPORTANCE[:2])), F.col("importance_level")), F.lit(0))
    ranked = keep(kept.withColumn("_rank", rank).withColumn("_n", F.coalesce(F.length("definition"), F.lit(0))))
    base, spark = max(original_chars, 1), kept.sparkSession

    def removed(victims: DataFrame, order: list[Column], start: int, prefix: str, reason: str, confidence: float) -> DataFrame:
        placed = numbered(victims.select("id", "name"), order, "no")
        return placed.select((F.col("no") + start + 1).alias("decision_no"), F.format_string(prefix + "_%04d", F.col("no") + start).alias("decision_id"), F.lit("remove").alias("action"), F.array("id").alias("affected_nodes"), F.array("name").alias("affected_names"), F.lit(None).cast("string").alias("result_node"), F.lit(reason).alias("reason"), F.lit(confidence).alias("confidence"))

    extra = ranked.where("_rank = 0")
    told, number = removed(extra, [F.col("id")], first_no, "purge_supp", "第一步：移除补充级知识点", 0.95), first_no + extra.count()
    left = ranked.where("_rank > 0")
    chars = left.agg(F.sum("_n")).first()[0] or 0
    if chars / base > target:
        important = left.where("_rank = 2")
        few = [r.id for r in important.select("id").orderBy("id").limit(5).collect()]
        shorter = F.when(F.col("_rank") == 2, compressed(F.col("definition"))).otherwise(F.col("definition"))
        left = keep(left.withColumn("definition", shorter).withColumn("_n", F.coalesce(F.length("definition"), F.lit(0))))
        chars = left.agg(F.sum("_n")).first()[0] or 0
        said = [(number + 1, f"{COMPRESSED}important_{number:04d}", "merge", few, ["重要级知识点批量压缩"], None, f"第二步：压缩 {important.count()} 个重要级知识点的定义至 100 字以内", 0.95)]
        told = told.unionByName(spark.createDataFrame(said, "decision_no long, decision_id string, action string, affected_nodes array<string>, affected_names array<string>, result_node string, reason string, confidence double"))
        number += 1
    if chars / base > target:
        important = running(left.where("_rank = 2"), [F.desc("id")], F.col("_n"), to="_before")
        over = (F.lit(chars) - F.col("_before")) / base > target
        told = told.unionByName(removed(important.where(over), [F.desc("id")], number, "trim_important", "第三步：为达成压缩目标移除重要级知识点", 0.85))
        left = left.where("_rank = 1").unionByName(important.where(~over).drop("_before"))
    return left.drop("_rank", "_n"), told


def within_budget(kept: DataFrame, original_chars: int, target: float = TARGET) -> DataFrame:
    """The nodes that budget() leaves."""
    return budget(kept if "name" in kept.columns else kept.withColumn("name", F.lit(None).cast("string")), original_chars, 0, target)[0].select(*kept.columns)


def original_chars(nodes: DataFrame) -> int:
    return nodes.agg(F.sum(F.length("definition"))).first()[0] or 0


def stats(nodes: DataFrame, final: DataFrame, decided: DataFrame, intent: bool = True) -> DataFrame:
    """One row of counts, characters and the compression reached.

    ``decided`` has all decisions. The record of shortened definitions is counted as a
    merge as observed; with ``intent`` it is in the total only.
    """
    before = nodes.agg(F.countDistinct("textbook_id").alias("textbook_count"), F.count("*").alias("original_nodes"), F.coalesce(F.sum(F.length("definition")), F.lit(0)).alias("original_chars"))
    after = final.agg(F.count("*").alias("merged_nodes"), F.coalesce(F.sum(F.length("definition")), F.lit(0)).alias("merged_chars"))
    real = ~F.coalesce(F.col("decision_id"), F.lit("")).startswith(COMPRESSED) if intent and "decision_id" in decided.columns else F.lit(True)
    acts = decided.agg(F.count("*").alias("total_decisions"), *[F.count_if((F.col("action") == a) & real).alias(f"{a}_count") for a in ACTIONS])
    ratio = F.round(F.col("merged_chars") / F.greatest("original_chars", F.lit(1)), 4)
    # three single rows
    return before.crossJoin(after).crossJoin(acts).withColumn("compression_ratio", ratio)


def merged_edges(edges: DataFrame, decided: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges between kept nodes after one hop from merged nodes to their results, one of each kind, the first description."""
    moves = decided.where("action = 'merge' and result_node is not null").select("decision_no", "result_node", F.explode("affected_nodes").alias("id")).where("id <> result_node")
    map_ = moves.groupBy("id").agg(F.max_by("result_node", "decision_no").alias("to"))
    ids = kept.select("id").distinct()
    out = edges
    for end in ("source", "target"):
        out = out.join(map_.withColumnRenamed("id", end), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        out = out.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return out.groupBy("source", "target", "relation_type").agg(F.min_by(F.struct("description"), "ord").alias("d")).select("source", "target", "relation_type", "d.description")


def domain_coverage(nodes: DataFrame, top: int = 8, names: int = 5) -> DataFrame:
    """domain, concepts and sample of the domains with most concepts; the first seen go before others of the same count.

    Only the first names of a domain are gathered, from the first of each batch of rows.
    """
    rows = nodes.where("chapter is not null").select(domain_key(F.col("chapter")).alias("domain"), "name", "ord")
    counts = rows.groupBy("domain").agg(F.count("*").alias("concepts"), F.min("ord").alias("first")).orderBy(F.desc("concepts"), "first").limit(top)
    part = rows.join(F.broadcast(counts), "domain")
    # first of each batch of rows, then of all batches at once
    few = part.groupBy("domain", F.floor(F.col("ord") / 1000).alias("s")).agg(_first_names(names).alias("x"))
    few = few.groupBy("domain", F.floor(F.col("s") / 1000).alias("s")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("x"))), 1, names).alias("x"))
    sample = few.groupBy("domain").agg(F.slice(F.array_sort(F.flatten(F.collect_list("x"))), 1, names).alias("x"))
    text = F.concat(F.array_join(F.transform("x", lambda s: s["name"]), ", ", ""), F.when(F.col("concepts") > names, "...").otherwise(""))
    return counts.join(sample, "domain").select("domain", "concepts", text.alias("sample"), "first").orderBy(F.desc("concepts"), "first").drop("first")


def _first_names(names: int) -> Column:
    return F.slice(F.array_sort(F.collect_list(F.struct("ord", "name"))), 1, names)


def book_graphs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """textbook_id, node_count and edge_count of every book's own graph, the head of its file; graph_rows has the rest."""
    n = nodes.groupBy("textbook_id").agg(F.count("*").alias("node_count"))
    e = edges.groupBy("textbook_id").agg(F.count("*").alias("edge_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return n.join(e, "textbook_id", "full_outer").select("textbook_id", zero("node_count"), zero("edge_count"))


def graph_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """textbook_id, kind and json: every book's own graph as one JSON object a node or edge, to be written by book."""
    n = nodes.select("textbook_id", F.lit("node").alias("kind"), F.to_json(F.struct("id", "name", "definition", F.col("importance_level").alias("importance"), "chapter", "page")).alias("json"))
    e = edges.select("textbook_id", F.lit("edge").alias("kind"), F.to_json(F.struct("source", "target", "relation_type", "description")).alias("json"))
    return n.unionByName(e)


def completeness(nodes: DataFrame, final: DataFrame, decided: DataFrame) -> DataFrame:
    """One row: critical nodes before, and of these how many are there still or have what they were merged into."""
    critical = nodes.where(F.col("importance_level") == IMPORTANCE[0]).select("id").distinct()
    moved = decided.where("action = 'merge' and result_node is not null").select(F.explode("affected_nodes").alias("id"), "result_node").groupBy("id").agg(F.max("result_node").alias("to"))
    there = final.select(F.col("id").alias("to")).distinct().withColumn("there", F.lit(1))
    return critical.join(moved, "id", "left").withColumn("to", F.coalesce("to", "id")).join(there, "to", "left").agg(F.count("*").alias("critical_nodes"), F.count("there").alias("critical_kept"))


def report(stat: DataFrame, coverage: DataFrame, decided: DataFrame, complete: DataFrame, cases: int = 5, generated_at: str | None = None) -> DataFrame:
    """One row with a Markdown report: overview, decisions by kind, domains, the first merges with confidence and reason, and what is complete."""
    place = F.struct((-F.col("concepts")).alias("c"), F.col("domain"))
    row = F.concat(F.lit("| "), "domain", F.lit(" | "), F.col("concepts").cast("string"), F.lit(" | "), "sample", F.lit(" |"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), row.alias("t")))), lambda x: x["t"]), "\n")
    domains = coverage.agg(lines.alias("domains"))
    some = decided.where("action = 'merge'").orderBy("decision_no").limit(cases)
    names = F.transform("affected_names", lambda n: F.coalesce(n, F.lit("")))
    case = F.concat(F.lit("：合并 — "), F.array_join(F.slice(names, 1, 3), ", "), F.lit("\n\n- **涉及知识点**: "), F.array_join(names, ", "), F.format_string("\n- **置信度**: %.2f\n- **理由**: ", "confidence"), F.coalesce("reason", F.lit("")))
    merges = some.agg(F.array_sort(F.collect_list(F.struct("decision_no", case.alias("t")))).alias("m")).select(F.array_join(F.transform("m", lambda x, i: F.concat(F.lit("### 案例 "), (i + 1).cast("string"), x["t"])), "\n\n").alias("merges"))
    count = lambda c: F.format_number(F.col(c), 0)
    text = F.concat(
        F.lit("# 学科知识整合报告\n\n"),
        F.lit(f"> 生成时间：{generated_at}\n\n" if generated_at else ""),
        F.lit("## 整合概览\n\n| 指标 | 数值 |\n|------|------|\n"),
        F.format_string("| 原始教材数量 | %d 本 |\n| 整合前知识点数 | %d |\n| 整合后知识点数 | %d |\n", "textbook_count", "original_nodes", "merged_nodes"),
        F.lit("| 原始总字数 | "), count("original_chars"), F.lit(" 字 |\n| 整合后字数 | "), count("merged_chars"),
        F.format_string(" 字 |\n| **压缩比** | **%.1f%%** |\n\n", F.col("compression_ratio") * 100),
        F.lit("## 整合决策摘要\n\n| 决策类型 | 数量 |\n|----------|------|\n"),
        F.format_string("| merge（合并） | %d |\n| keep（保留） | %d |\n| remove（删除） | %d |\n| **合计** | **%d** |\n\n", "merge_count", "keep_count", "remove_count", "total_decisions"),
        F.lit("## 知识域覆盖\n\n| 知识域 | 保留知识点数 | 代表性概念 |\n|--------|------------|-----------|\n"), F.coalesce("domains", F.lit("")),
        F.lit("\n\n## 重点整合案例\n\n"), F.when(F.coalesce("merges", F.lit("")) == "", F.lit("（无合并案例）")).otherwise(F.col("merges")),
        F.format_string("\n\n## 教学完整性说明\n\n- 关键级知识点：保留 %d / %d\n", "critical_kept", "critical_nodes"),
    )
    return stat.crossJoin(domains).crossJoin(merges).crossJoin(complete).select(text.alias("report_markdown"))


def overridden(decided: DataFrame, overrides: DataFrame) -> DataFrame:
    """Decisions with the action and result that a later dialogue set; ``overrides`` has decision_id, action and result_node."""
    new = overrides.select("decision_id", F.col("action").alias("new_action"), F.col("result_node").alias("new_result"))
    out = decided.join(new, "decision_id", "left")
    return out.withColumn("result_node", F.when(F.col("new_action").isNull(), F.col("result_node")).otherwise(F.col("new_result"))).withColumn("action", F.coalesce("new_action", "action")).drop("new_action", "new_result")
