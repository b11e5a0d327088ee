"""Similar pairs and nearest rows, exactly."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexforge.session import cut, ship

#: Rows of one block of the pair join, questions that go to every task, and questions that are scored at once.
BLOCK, QUESTIONS, TOGETHER = 8192, 4096, 256
#: Blocks of the pair join from which they rather grow, up to so many numbers; rows of a tile that fits the cache, and rows after which pairs are handed on.
MOST_BLOCKS, LARGEST, TILE, STRIPE = 16, 1 << 21, (512, 256), 4096
#: Sampled rows that decide how many components are multiplied, and of how many multiplied components one more pair costs as much.
HEAD_SAMPLE, PAIR_COST = 1024, 6000
#: Rows for each pivot of the pair join, most pivots, and sampled rows for each of them.
PER_PIVOT, MOST_PIVOTS, PIVOT_SAMPLE = 2048, 1024, 16
#: Rows of a block of chunks that meets a block of questions.
CHUNKS = 65_536


def _unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows that have one of the dimension, and which they are."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = np.flatnonzero(np.asarray(column.value_lengths().fill_null(-1)) == dim)
    m = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    size = np.sqrt((m * m).sum(1))
    good = np.isfinite(size) & (size > 0)
    return m[good] / size[good, None], rows[good]


def _pivots(rows: DataFrame, dim: int, total: int, count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors around which the rows are put in cells, and the sampled rows; they decide how much is compared, never a result."""
    total = max(1, total)
    wanted = max(count * PIVOT_SAMPLE, 4 * HEAD_SAMPLE)
    got = rows.select("embedding").sample(min(1.0, 1.3 * wanted / total), seed=seed).limit(2 * wanted).toArrow()
    x = _unit_rows(got["embedding"], dim)[0] if got.num_rows else np.empty((0, dim))
    if not len(x):
        return np.eye(1, dim), x
    centres = x[np.random.default_rng(seed).choice(len(x), min(count, len(x)), replace=False)]
    for _ in range(3):
        near, sums = (x @ centres.T).argmax(1), np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-12), centres)
    return centres, x


def _basis(x: np.ndarray, dim: int, least: float) -> tuple[np.ndarray, int]:
    """Directions in order of what the sampled rows have in them, and how many of them are multiplied for every pair.

    Of the others only the length is: what two rows have there adds at most the product
    of the lengths, so no pair is missed. The fewer directions, the more pairs pass that don't hold.
    """
    x = np.random.default_rng(7).permutation(x)
    # what is judged isn't what the directions are learnt from
    judged = min(HEAD_SAMPLE, len(x) // 2)
    if judged < 2:
        return np.eye(dim), dim
    basis = np.linalg.eigh(x[judged:].T @ x[judged:])[1][:, ::-1]
    z = x[:judged] @ basis
    others = ~np.eye(len(z), dtype=bool)

    def cost(head: int) -> float:
        rest = np.linalg.norm(z[:, head:], axis=1)
        over = z[:, :head] @ z[:, :head].T + np.outer(rest, rest) >= least
        return head + (head < dim) + PAIR_COST * float(over[others].mean())

    return basis, min([dim, *range(max(1, dim // 4), dim, max(1, dim // 16))], key=cost)


def _body(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def _blocks(rows: DataFrame, dim: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """block and body, one row and one partition for each block of rows, sorted by cell and ord; the pivots of the cells; sampled rows."""
    total = rows.count()
    pivots, sampled = _pivots(rows, dim, total, int(min(MOST_PIVOTS, max(1, -(-total // PER_PIVOT)))))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(pivots), np.int64)
        for batch in batches:
            v, _ = _unit_rows(batch["embedding"], dim)
            held += np.bincount((v @ pivots.T).argmax(1), minlength=len(pivots))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pivots))), pa.array(held)], ["cell", "held"])

    held = np.zeros(len(pivots), np.int64)
    for r in rows.select("embedding").mapInArrow(measure, "cell long, held long").groupBy("cell").agg(F.sum("held").alias("held")).collect():
        held[r.cell] = r.held
    most = int(max(BLOCK, min(LARGEST // dim, -(-held.sum() // MOST_BLOCKS))))
    # a large cell is cut into blocks, small ones share one
    parts, first, block, room = np.maximum(1, -(-held // most)), np.zeros(len(pivots), np.int64), -1, 0
    for c in range(len(pivots)):
        if parts[c] > 1:
            first[c], block, room = block + 1, block + parts[c], 0
        else:
            if held[c] > room or block < 0:
                block, room = block + 1, most
            first[c], room = block, room - held[c]
    count = max(1, int(block) + 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, at = _unit_rows(batch["embedding"], dim)
            if len(v):
                batch, own = batch.take(pa.array(at)), (v @ pivots.T).argmax(1)
                mix = (pd.util.hash_array(batch["ord"].to_numpy(zero_copy_only=False)) >> np.uint64(2)).astype(np.int64)
                where = first[own] + mix % parts[own]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype("int32")), pa.array(where.astype("int32"))], [*batch.schema.names, "cell", "block"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if got := list(batches):
            t = pa.Table.from_batches(got).sort_by([("cell", "ascending"), ("ord", "ascending")])
            yield pa.RecordBatch.from_arrays([t["block"].combine_chunks()[:1], pa.array([_body(t.drop_columns(["block"]))], pa.binary())], ["block", "body"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = rows.mapInArrow(place, f"{kind}, cell int, block int").repartitionById(count, "block")
    return cut(placed.mapInArrow(pack, "block int, body binary")), pivots, sampled


def candidate_pairs(nodes: DataFrame, dim: int, least: float = 0.70) -> DataFrame:
    """a, b, a_ord, b_ord, similarity of rows of different books with a cosine of at least the bound, the earlier first.

    ``nodes`` has id, book, ord (unique) and embedding, and is read a few times. The join
    is exact. Rows lie in cells around pivots, and cells in blocks, each of which is
    stored once; a task reads two blocks. Two cells meet only if the angle between the
    pivots, less the cells' radii, is within the bound, so cells that can't hold a
    partner are never compared. Vectors without structure have wide cells and are
    compared all with all. Products of the first components in single precision, with
    a bound on the rest, choose; double decides. A task holds its rows once as they came
    and once in single precision.
    """
    ship(nodes.sparkSession)
    rows = nodes.select("id", "book", "ord", "embedding").where("embedding is not null and book is not null")
    packed, pivots, sampled = _blocks(rows, dim)
    basis, head = _basis(sampled, dim, least)
    angle = float(np.arccos(min(1.0, max(-1.0, least)))) + 1e-6
    # what single precision may be off
    bar = np.float32(least - 1e-5 - 1.2e-7 * dim)
    apart = np.arccos(np.clip(pivots @ pivots.T, -1, 1))

    def opened(body: pa.Buffer) -> tuple:
        """Rows, their ord, vectors as they came, lengths, what is multiplied, and of each cell its number, radius and range of rows."""
        t = pa.ipc.open_stream(body).read_all().combine_chunks()
        raw = t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        t = t.drop_columns(["embedding"])
        cell, size, near, f = np.asarray(t["cell"]), np.empty(len(raw)), np.empty(len(raw)), np.empty((len(raw), head + (head < dim)), np.float32)
        for s in range(0, len(raw), STRIPE):
            e = s + STRIPE
            v = raw[s:e].astype(np.float64)
            size[s:e] = np.sqrt((v * v).sum(1))
            v /= size[s:e, None]
            near[s:e] = (v * pivots[cell[s:e]]).sum(1)
            z = v @ basis
            f[s:e, :head] = z[:, :head]
            f[s:e, head:] = np.linalg.norm(z[:, head:], axis=1, keepdims=True)
        starts = np.flatnonzero(np.diff(cell, prepend=-1))
        cells = list(zip(cell[starts].tolist(), np.arccos(np.clip(np.minimum.reduceat(near, starts), -1, 1)).tolist(), starts.tolist(), [*starts[1:].tolist(), len(raw)], strict=True))
        return t, np.asarray(t["ord"]), raw, size, f, cells

    def hits(f: np.ndarray, g: np.ndarray, room: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the one and the other whose product reaches the bar, tile by tile; ``room`` holds a tile and what is over."""
        x, y = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for r in range(0, len(g), TILE[1]):
            other = g[r : r + TILE[1]].T
            for s in range(0, len(f), TILE[0]):
                part = f[s : s + TILE[0]]
                n = len(part) * other.shape[1]
                product, over = room[0][:n], room[1][: -(-n // 64) * 64]
                np.matmul(part, other, out=product.reshape(len(part), -1))
                np.greater_equal(product, bar, out=over[:n])
                over[n:] = False
                # 64 results at once, few of them have any
                some = np.flatnonzero(np.packbits(over).view(np.uint64))
                if len(some):
                    at = (some[:, None] * 64 + np.arange(64)).reshape(-1)
                    at = at[over[at]]
                    x.append(s + at // other.shape[1])
                    y.append(r + at % other.shape[1])
        return np.concatenate(x), np.concatenate(y)

    def ranges(first: np.ndarray, wanted: np.ndarray) -> list[tuple[int, int]]:
        """Begin and end of the runs that are wanted; ``first`` marks where a run begins."""
        at = np.flatnonzero(first).tolist()
        return [(x, y) for x, y in zip(at, [*at[1:], len(first)], strict=True) if wanted[x]]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = np.empty(TILE[0] * TILE[1], np.float32), np.empty(-(-TILE[0] * TILE[1] // 64) * 64, bool)
        for batch in batches:
            for low, high, left, right in zip(*(batch[c] for c in ("l", "r", "left", "right")), strict=True):
                same = low.as_py() == high.as_py()
                one = opened(left.as_buffer())
                two = one if same else opened(right.as_buffer())
                (t, t_ord, v, v_size, f, own), (u, u_ord, w, w_size, g, others) = one, two
                books = pa.chunked_array([*t["book"].chunks, *u["book"].chunks]).combine_chunks().dictionary_encode().indices
                t_book, u_book = np.asarray(books)[: len(v)], np.asarray(books)[len(v) :]
                close = apart[np.ix_([c[0] for c in own], [c[0] for c in others])] - np.array([c[1] for c in own])[:, None] - np.array([c[1] for c in others]) <= angle
                # cells side by side that meet the same ones are compared at once
                for i, i_end in ranges(np.r_[True, (close[1:] != close[:-1]).any(1)], np.ones(len(own), bool)):
                    for j, j_end in ranges(np.r_[True, close[i, 1:] != close[i, :-1]], close[i]):
                        for s in range(own[i][2], own[i_end - 1][3], STRIPE):
                            e = min(own[i_end - 1][3], s + STRIPE)
                            # within one block later rows only
                            start = max(s, others[j][2]) if same else others[j][2]
                            a, b = hits(f[s:e], g[start : others[j_end - 1][3]], room)
                            a, b = a + s, b + start
                            keep = (t_book[a] != u_book[b]) & (t_ord[a] != u_ord[b]) & ((a < b) | (not same))
                            a, b = a[keep], b[keep]
                            for k in range(0, len(a), STRIPE * 16):
                                x, y = a[k : k + STRIPE * 16], b[k : k + STRIPE * 16]
                                sim = (v[x].astype(np.float64) / v_size[x, None] * (w[y].astype(np.float64) / w_size[y, None])).sum(1)
                                x, y, sim = x[sim >= least], y[sim >= least], sim[sim >= least]
                                if len(x):
                                    yield pairs(t.take(pa.array(x)), u.take(pa.array(y)), t_ord[x] < u_ord[y], sim)

    def pairs(x: pa.Table, y: pa.Table, first: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
        both = lambda c, p, q: pc.if_else(first, p[c], q[c]).combine_chunks()
        first = pa.array(first)
        return pa.RecordBatch.from_arrays([both("id", x, y), both("id", y, x), both("ord", x, y), both("ord", y, x), pa.array(sim)], ["a", "b", "a_ord", "b_ord", "similarity"])

    # each two blocks meet once, as many in the one order as in the other
    turn = (F.col("l") == F.col("r")) | ((F.col("l") < F.col("r")) == ((F.col("l") + F.col("r")) % 2 == 0))
    left, right = packed.select(F.col("block").alias("l"), F.col("body").alias("left")), packed.select(F.col("block").alias("r"), F.col("body").alias("right"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    met = left.hint("shuffle_replicate_nl").join(right, turn)
    return met.mapInArrow(meet, f"a {kind['id']}, b {kind['id']}, a_ord {kind['ord']}, b_ord {kind['ord']}, similarity double")


def _best_rows(q: np.ndarray, ids: np.ndarray, dim: int, k: int) -> Callable:
    """The k best of some rows for every question, ties by ord."""

    def prune(found: tuple) -> tuple:
        n, s, o, keys = found
        order = np.lexsort((o, -s, n))
        rank = np.arange(len(n)) - np.searchsorted(n[order], n[order])
        keep = order[rank < k]
        return n[keep], s[keep], o[keep], keys.take(pa.array(keep))

    def run(batches: Iterator[pa.RecordBatch | pa.Table]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            v, rows = _unit_rows(batch["embedding"], dim)
            if not len(v) or not len(q):
                continue
            order, keys = np.asarray(batch["ord"])[rows], batch["key"].take(pa.array(rows))
            keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
            for a in range(0, len(q), TOGETHER):
                score = q[a : a + TOGETHER] @ v.T
                # all that tie with the k-th stay until the last cut
                bar = np.partition(score, len(v) - k, axis=1)[:, len(v) - k] if len(v) > k else np.full(len(score), -np.inf)
                n, at = np.nonzero(score >= bar[:, None])
                part = (n + a, score[n, at], order[at], keys.take(pa.array(at)))
                best = part if best is None else tuple(np.concatenate([x, y]) for x, y in zip(best[:3], part[:3], strict=True)) + (pa.chunked_array([best[3], part[3]]).combine_chunks(),)
            best = prune(best)
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[2]), best[3], pa.array(best[1])], ["qid", "ord", "key", "score"])

    return run


def top_per_question(questions: DataFrame, chunks: DataFrame, dim: int, k: int) -> DataFrame:
    """qid, ord, key, score: the k best rows of every question, ties by ord.

    ``questions`` has qid and embedding, ``chunks`` has ord, key and embedding. A few
    questions go to every task, and the chunks stay where they are; of more, blocks of
    questions meet blocks of chunks. Either way a task keeps its own k best only.
    """
    ship(chunks.sparkSession)
    kind = {c: chunks.schema[c].dataType.simpleString() for c in ("ord", "key")}
    asks = questions.schema["qid"].dataType.simpleString()
    schema = f"qid {asks}, ord {kind['ord']}, key {kind['key']}, score double"
    count = questions.count()
    rows = chunks.select("ord", "key", "embedding")
    if count <= QUESTIONS:
        asked = questions.select("qid", "embedding").toArrow().sort_by("qid")
        q, at = _unit_rows(asked["embedding"], dim)
        found = rows.mapInArrow(_best_rows(q, asked["qid"].to_numpy()[at], dim, k), schema)
    else:
        groups, parts = -(-count // QUESTIONS), max(1, -(-chunks.count() // CHUNKS))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = questions.select("qid", "embedding", F.pmod(F.xxhash64("qid"), F.lit(groups)).alias("g")).withColumn("p", every(parts))
        # new columns, in case the questions are rows of the chunks
        right = rows.select("ord", "key", F.transform("embedding", lambda x: x).alias("embedding")).withColumn("p", F.pmod(F.xxhash64("ord"), F.lit(parts))).withColumn("g", every(groups))

        none = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

        def meet(asked: pa.Table, part: pa.Table) -> pa.Table:
            got = []
            if asked.num_rows and part.num_rows:
                q, at = _unit_rows(asked["embedding"], dim)
                got = list(_best_rows(q, np.asarray(asked["qid"])[at], dim, k)([part]))
            return pa.Table.from_batches(got) if got else none

        found = left.groupBy("g", "p").cogroup(right.groupBy("g", "p")).applyInArrow(meet, schema)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "ord"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def best_per_key(found: DataFrame, top: int) -> DataFrame:
    """Of the rows found for a question the best of each key, and of these the first ones, with place from 1."""
    first = F.row_number().over(Window.partitionBy("qid", "key").orderBy(F.desc("score"), "ord"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "ord"))
    return found.withColumn("first", first).where("first = 1").drop("first").withColumn("place", place).where(F.col("place") <= top)
