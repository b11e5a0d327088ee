"""Parent-child links to full hierarchies, with cycles found, by tree contraction.

Every round rakes the nodes at which links end (no child, or no parent) and
compresses chains of nodes with one parent and one child. What can't be contracted
further is a core of cycles; chains of cycles shrink to loops on the way. Reversing
the recorded rounds gives paths, so the number of rounds grows with the logarithm of
the depth and not with the depth. The strongly connected parts of a small core are
found by one task, those of a large one by colours spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.session import cut, cut_counted, ship

#: Rakes of one round of contraction.
RAKES = 2
#: Links that one task may take to find parts of what contraction leaves; more are gone through by all tasks, to the same result.
ONE_TASK = 500_000
#: Sets of new paths that are looked through before they become one table.
PATH_SETS = 6


def clean_links(links: DataFrame, parent: str = "parent", child: str = "child") -> DataFrame:
    """Distinct links with both ends."""
    return links.select(F.col(parent).cast("string").alias("parent"), F.col(child).cast("string").alias("child")).where("parent is not null and child is not null").distinct()


def _unary(links: DataFrame, turn: int) -> DataFrame:
    """Nodes with one parent and one child; ``goes`` marks those that rank below both neighbours, so that no two of them touch."""
    ends = links.select(F.col("child").alias("node"), F.col("parent").alias("up"), F.lit(None).cast("string").alias("down")).unionByName(
        links.select(F.col("parent").alias("node"), F.lit(None).cast("string").alias("up"), F.col("child").alias("down"))
    )
    unary = ends.groupBy("node").agg(F.count("up").alias("ups"), F.count("down").alias("downs"), F.max("up").alias("up"), F.max("down").alias("down")).where("ups = 1 and downs = 1").select("node", "up", "down", F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("n")).alias("rank"))
    above, below = (unary.select(F.col("node").alias(end), F.col("rank").alias(f"{end}_rank")) for end in ("up", "down"))
    lower = [F.col(f"{end}_rank").isNull() | (F.col("rank") < F.col(f"{end}_rank")) for end in ("up", "down")]
    return unary.join(above, "up", "left").join(below, "down", "left").select("node", "up", (lower[0] & lower[1]).alias("goes"))


def _marked(links: DataFrame, unary: DataFrame) -> DataFrame:
    """Links with a mark at those that lead to a node that goes."""
    return links.join(unary.where("goes").select(F.col("node").alias("child"), F.lit(True).alias("gone")), "child", "left").select("parent", "child", "via", "gone")


def _bypass(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links with the marked nodes taken out, and a record (node, up, via) of each of them."""
    above = marked.where("gone").select(F.col("parent").alias("new_parent"), F.col("child").alias("parent"), F.col("via").alias("above_via"))
    rest = marked.where("gone is null").select("parent", "child", "via").join(above, "parent", "left")
    joined = rest.select(
        F.coalesce("new_parent", "parent").alias("parent"),
        "child",
        F.when(F.col("new_parent").isNull(), F.col("via")).otherwise(F.concat("above_via", F.array("parent"), "via")).alias("via"),
    )
    return joined, above.select(F.col("parent").alias("node"), F.col("new_parent").alias("up"), F.col("above_via").alias("via"))


def _with_via(links: DataFrame) -> DataFrame:
    return links.select("parent", "child", F.array().cast("array<string>").alias("via"))


def _contract_forest(links: DataFrame) -> list[DataFrame]:
    """Contract trees to nothing; each step's record of the nodes it took out, in order."""
    taken, turn, live = [], 0, _with_via(links)
    while True:
        # the rake in which a link comes off, if any
        raked = live.withColumn("step", F.lit(None).cast("int"))
        for k in range(RAKES):
            inner = raked.where("step is null").select(F.col("parent").alias("child")).distinct().withColumn("inner", F.lit(True))
            raked = raked.join(inner, "child", "left").withColumn("step", F.when(F.col("step").isNull() & F.col("inner").isNull(), F.lit(k)).otherwise(F.col("step"))).drop("inner")
            if k == 0:
                raked, left = cut_counted(raked)
                if not left:
                    return taken
        raked = cut(raked)
        taken += [raked.where(F.col("step") == k).select(F.col("child").alias("node"), F.col("parent").alias("up"), "via") for k in range(RAKES)]
        kept = raked.where("step is null").select("parent", "child", "via")
        marked = cut(_marked(kept, _unary(kept, turn)))
        live, records = _bypass(marked)
        taken.append(records)
        turn += 1


def _contract_graph(links: DataFrame) -> tuple[DataFrame, int, DataFrame | None]:
    """Contract until only a core of cycles is left; the core, its links, and the loops that came off on the way."""
    loops, turn = None, 0
    live, left = cut_counted(_with_via(links))
    while left:
        kept = live
        for _ in range(RAKES):
            inner, fed = kept.select(F.col("parent").alias("child")).distinct(), kept.select(F.col("child").alias("parent")).distinct()
            kept = kept.join(inner, "child", "left_semi").join(fed, "parent", "left_semi").select("parent", "child", "via")
        kept, stay = cut_counted(kept)
        merged = cut(_bypass(_marked(kept, _unary(kept, turn)))[0].groupBy("parent", "child").agg(F.array_distinct(F.flatten(F.collect_list("via"))).alias("via")))
        rings = merged.where("parent = child").select(F.col("parent").alias("node"), "via")
        counts = merged.agg(F.count("*").alias("all"), F.count_if(F.col("parent") == F.col("child")).alias("rings")).first()
        if counts["all"] == stay == left:
            # links are distinct, and of any unary nodes one at least would have gone
            return kept, left, loops
        if counts["rings"]:
            loops = rings if loops is None else loops.unionByName(rings)
        live, left = merged.where("parent <> child"), counts["all"] - counts["rings"]
        turn += 1
    return live, left, loops


def _in_one_task(rows: DataFrame, find: Callable[[list, list], list[tuple[str, str]]], names: tuple[str, str]) -> DataFrame:
    """Both columns of few rows to one task, and the pairs that it finds."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for batch in batches:
            a += batch.column(0).to_pylist()
            b += batch.column(1).to_pylist()
        found = find(a, b)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.string())], list(names))

    return cut(rows.repartition(1).mapInArrow(run, f"{names[0]} string, {names[1]} string"))


def _parts_of(parents: list[str], children: list[str]) -> list[tuple[str, str]]:
    """Node and smallest node of its strongly connected part, of parts with two nodes or more; by depth-first search with a stack of its own."""
    names = sorted({*parents, *children})
    at = {n: i for i, n in enumerate(names)}
    out: list[list[int]] = [[] for _ in names]
    for p, c in zip(parents, children, strict=True):
        out[at[p]].append(at[c])
    seen, low, open_, stack, found = [-1] * len(names), [0] * len(names), [False] * len(names), [], []
    count = 0
    for root in range(len(names)):
        if seen[root] >= 0:
            continue
        todo = [(root, 0)]
        while todo:
            v, k = todo.pop()
            if k == 0:
                seen[v] = low[v] = count
                count += 1
                stack.append(v)
                open_[v] = True
            else:
                low[v] = min(low[v], low[out[v][k - 1]])
            for j in range(k, len(out[v])):
                w = out[v][j]
                if seen[w] < 0:
                    todo += [(v, j + 1), (w, 0)]
                    break
                if open_[w]:
                    low[v] = min(low[v], seen[w])
            else:
                if low[v] == seen[v]:
                    part = []
                    while not part or part[-1] != v:
                        part.append(stack.pop())
                        open_[part[-1]] = False
                    if len(part) > 1:
                        first = names[min(part)]
                        found += [(names[w], first) for w in part]
    return found


def _groups_of(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """Smallest name of a group and each of its names, of names linked directly or by others."""
    top: dict[str, str] = {}

    def find(x: str) -> str:
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for x, y in zip(a, b, strict=True):
        x, y = find(x), find(y)
        if x != y:
            top[max(x, y)] = min(x, y)
    return [(find(x), x) for x in list(top)]


def cycles(links: DataFrame) -> DataFrame:
    """cycle_id and node_id of every node from which links lead back to itself.

    ``links`` has parent and child; other columns are ignored. Links with a null end
    are left out, repeated links count once, a link of a node to itself is a cycle of
    one. cycle_id is the smallest node of those that lead to the node and are led to
    by it. No links, or none on a cycle, give an empty result.
    """
    plain = clean_links(links)
    own = plain.where("parent = child").select(F.col("parent").alias("node"), F.array().cast("array<string>").alias("via"))
    core, left, loops = _contract_graph(plain.where("parent <> child"))
    rings = own if loops is None else own.unionByName(loops)
    # a loop hangs on a node which may lie inside a larger part, or inside the chain of another loop
    pairs = rings.select(F.col("node").alias("at"), F.explode(F.array_union(F.array("node"), "via")).alias("node"))
    if left:
        parts = strong_parts(core)
        # the chain behind a link inside one part belongs to it
        head, tail = parts.select(F.col("node").alias("parent"), F.col("part").alias("a")), parts.select(F.col("node").alias("child"), F.col("part").alias("b"))
        behind = core.join(head, "parent").join(tail, "child").where("a = b").select(F.col("a").alias("at"), F.explode("via").alias("node"))
        pairs = pairs.unionByName(parts.select(F.col("part").alias("at"), "node")).unionByName(behind)
    return _merge_parts(pairs)


def _merge_parts(pairs: DataFrame) -> DataFrame:
    """Rings that share a node are one; the smallest node names it."""
    ids, count = cut_counted(pairs.distinct())
    if count <= ONE_TASK:
        return _in_one_task(ids.select("at", "node"), _groups_of, ("cycle_id", "node_id"))
    links = ids.select(F.col("at").alias("a"), F.col("node").alias("b"))
    label = cut(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("label", F.col("node")))
    both = cut(links.union(links.select("b", "a")).distinct())
    while True:
        best = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("seen")).withColumnRenamed("a", "node")
        new = cut(label.join(best, "node", "left").select("node", F.least("label", F.coalesce("seen", "label")).alias("new"), "label"))
        moved = new.where("new <> label").limit(1).count()
        label = new.select("node", F.col("new").alias("label"))
        if not moved:
            break
    return label.select(F.col("label").alias("cycle_id"), F.col("node").alias("node_id"))


def strong_parts(links: DataFrame) -> DataFrame:
    """node and part (its smallest node) of strongly connected parts with at least two nodes.

    Few links are gone through by one task. Of more, colours are the smallest node that
    leads to a node; of each colour the nodes that lead back to it are one part. Found
    parts leave, and the rest goes on.
    """
    live, count = cut_counted(links.select("parent", "child").where("parent <> child").distinct())
    if count <= ONE_TASK:
        return _in_one_task(live, _parts_of, ("node", "part"))
    found = live.select(F.col("parent").alias("node"), F.col("child").alias("part")).limit(0)
    while not live.isEmpty():
        colour = cut(live.select(F.col("parent").alias("node")).union(live.select("child")).distinct().withColumn("colour", F.col("node")))
        while True:
            seen = live.join(colour.withColumnRenamed("node", "parent"), "parent").groupBy("child").agg(F.min("colour").alias("seen")).withColumnRenamed("child", "node")
            new = cut(colour.join(seen, "node", "left").select("node", F.least("colour", F.coalesce("seen", "colour")).alias("new"), "colour"))
            moved = new.where("new <> colour").limit(1).count()
            colour = new.select("node", F.col("new").alias("colour"))
            if not moved:
                break
        within = cut(live.join(colour.withColumnRenamed("node", "parent").withColumnRenamed("colour", "a"), "parent").join(colour.withColumnRenamed("node", "child").withColumnRenamed("colour", "b"), "child").where("a = b").select("parent", "child", F.col("a").alias("part")))
        back = cut(within.select(F.col("part").alias("node"), "part").distinct())
        size = back.count()
        while True:
            more = within.join(back.select(F.col("node").alias("child"), "part"), ["child", "part"]).select(F.col("parent").alias("node"), "part")
            back = cut(back.unionByName(more).distinct())
            if (now := back.count()) == size:
                break
            size = now
        real = back.groupBy("part").count().where("count > 1").select("part")
        found = cut(found.unionByName(back.join(real, "part", "left_semi").select("node", "part")))
        # a colour's first node is done, alone or with its part
        done = back.select("node")
        live = cut(live.join(done.withColumnRenamed("node", "parent"), "parent", "left_anti").join(done.withColumnRenamed("node", "child"), "child", "left_anti"))
    return found


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def hierarchy(links: DataFrame) -> DataFrame:
    """One row per node: node_id, parent_id, n_parents, root_id, depth, path, n_descendants, cycle_id.

    ``links`` has parent and child; other columns are ignored. A node with several
    parents hangs below the smallest of those that are on no cycle, or else below the
    smallest; n_parents counts all. Nodes on a cycle have cycle_id and no parent, and
    are the roots of what hangs below them. depth of a root is 0; path leads from the
    root to the node. n_descendants counts the nodes below. Links with a null end are
    left out; no links give an empty result.
    """
    plain = cut(clean_links(links))
    ring = cut(cycles(plain))
    nodes = plain.select(F.col("parent").alias("node_id")).union(plain.select("child")).distinct()
    on = ring.select(F.col("node_id").alias("parent"), F.lit(1).alias("from_ring"))
    ups = plain.where("parent <> child").join(on, "parent", "left").groupBy("child").agg(F.count("*").cast("long").alias("n_parents"), F.min(F.struct(F.coalesce("from_ring", F.lit(0)).alias("r"), F.col("parent").alias("p"))).alias("best"))
    tree = cut(ups.join(ring.select(F.col("node_id").alias("child")), "child", "left_anti").select("child", F.col("best.p").alias("parent")))
    taken = _contract_forest(tree)
    roots = nodes.join(tree.select(F.col("child").alias("node_id")), "node_id", "left_anti")
    known = [cut(roots.select("node_id", F.array("node_id").alias("path")))]
    for records in reversed(taken):
        paths = _union(known)
        more, count = cut_counted(records.join(paths.withColumnRenamed("node_id", "up"), "up").select(F.col("node").alias("node_id"), F.concat("path", "via", F.array("node")).alias("path")))
        if count:
            known.append(more)
        if len(known) > PATH_SETS:
            known = [cut(_union(known))]
    paths = _union(known)
    below = paths.select(F.explode(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("below"))
    return (
        paths.join(below, "node_id", "left")
        .join(ups.select(F.col("child").alias("node_id"), "n_parents"), "node_id", "left")
        .join(ring, "node_id", "left")
        .select(
            "node_id",
            F.try_element_at("path", F.lit(-2)).alias("parent_id"),
            F.coalesce("n_parents", F.lit(0)).alias("n_parents"),
            F.element_at("path", 1).alias("root_id"),
            (F.size("path") - 1).alias("depth"),
            "path",
            F.coalesce("below", F.lit(0)).alias("n_descendants"),
            "cycle_id",
        )
    )


def descendants(paths: DataFrame) -> DataFrame:
    """ancestor_id, node_id and distance for every node below another, from the rows of hierarchy."""
    at = paths.select("node_id", "depth", F.posexplode("path").alias("place", "ancestor_id"))
    return at.where("place < depth").select("ancestor_id", "node_id", (F.col("depth") - F.col("place")).alias("distance"))


def _closure(links: DataFrame) -> DataFrame | None:
    """parent and child of every link and every chain of links without cycles; None without links.

    ``step`` holds the chains of 1, 2, 4... links and ``known`` all shorter ones, so the
    number of rounds grows with the logarithm of the longest chain.
    """
    known = None
    step, left = cut_counted(links.select("parent", "child"))
    while left:
        start = step.select("parent", F.col("child").alias("mid"))
        if known is None:
            known = step
        else:
            longer = start.join(known.withColumnRenamed("parent", "mid"), "mid").select("parent", "child")
            known = cut(known.unionByName(step).unionByName(longer).distinct())
        step, left = cut_counted(start.join(step.withColumnRenamed("parent", "mid"), "mid").select("parent", "child").distinct())
    return known


def _reached_parts(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """node_id and part of every node (nodes that lead to each other are one part), and which parts lead to which others."""
    plain = cut(clean_links(links))
    ring = cycles(plain).withColumnRenamed("cycle_id", "part")
    nodes = plain.select(F.col("parent").alias("node_id")).union(plain.select("child")).distinct()
    member = cut(nodes.join(ring, "node_id", "left").select("node_id", F.coalesce("part", "node_id").alias("part")))
    above, below = (member.select(F.col("node_id").alias(end), F.col("part").alias(f"{end}_part")) for end in ("parent", "child"))
    between = plain.join(above, "parent").join(below, "child").where("parent_part <> child_part")
    return member, _closure(between.select(F.col("parent_part").alias("parent"), F.col("child_part").alias("child")).distinct())


def all_descendants(links: DataFrame) -> DataFrame:
    """ancestor_id and node_id for every node that another leads to, over any of its parents and through cycles.

    Nodes on one cycle are each other's descendants; no node is its own.
    """
    member, parts = _reached_parts(links)
    above, below = member.select(F.col("node_id").alias("ancestor_id"), F.col("part").alias("parent")), member.withColumnRenamed("part", "child")
    out = above.join(below, F.col("parent") == F.col("child")).where("ancestor_id <> node_id").select("ancestor_id", "node_id")
    if parts is not None:
        out = out.unionByName(parts.join(above, "parent").join(below, "child").select("ancestor_id", "node_id"))
    return out


def descendant_counts(links: DataFrame) -> DataFrame:
    """node_id and n_descendants of every node: how many rows of all_descendants it has, without making them."""
    member, parts = _reached_parts(links)
    sizes = member.groupBy("part").agg(F.count("*").alias("size"))
    per = sizes.select("part", (F.col("size") - 1).alias("n"))
    if parts is not None:
        per = per.unionByName(parts.join(sizes.withColumnRenamed("part", "child"), "child").select(F.col("parent").alias("part"), F.col("size").alias("n")))
    return member.join(per.groupBy("part").agg(F.sum("n").alias("n_descendants")), "part").select("node_id", "n_descendants")
