"""Most similar vectors for every vector: inverted lists with an adaptive dimension scan.

Vectors are normalised and turned by a random rotation, so that any leading columns
are a fair sample of the whole distance. Each vector is stored in the list of its
nearest centre and asks the lists of its nearest few. Inside a list, distances are
summed up one block of columns at a time; after each block a hypothesis test drops
the candidates whose partial distance shows that the whole one will be too large.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.session import keep

#: Vectors per list aimed at, most lists, and sampled vectors per list from which centres are fitted.
LIST_SIZE, MOST_LISTS, SAMPLE_PER_LIST = 400, 16_384, 32
#: Sampled vectors per coarse cell; cells are as many as the square root of the lists, so the driver holds 8,192 vectors at most.
SAMPLE_PER_CELL = 64
#: Share of nearest vectors of the sample that the probed lists shall hold, and sampled vectors that ask.
WANTED, ASKERS = 0.93, 512
#: Parts into which the copies of one vector are split.
SPLITS = 32
#: Most vectors of a list, and most askers, that meet in one task; larger lists are cut into such blocks.
BLOCK = 20_000
#: Columns of a scan block, and the strictness of the test (larger abandons later).
COLUMNS, EPSILON = 16, 2.1
#: Stored vectors, evenly spread over a list, that give a first bound for the k nearest, and the share of candidates below which they are followed one by one.
FIRST, FEW = 256, 0.1


@dataclass(frozen=True)
class Index:
    """What samples decide: rotation, centres, how many vectors each list is expected to hold, and lists to probe for nearest ones."""

    rotation: np.ndarray
    centres: np.ndarray
    sizes: np.ndarray
    probes: int = 1


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of the usable vectors, and which rows they are."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    rows = np.flatnonzero(lengths == dim)
    flat = column.take(pa.array(rows)).flatten().cast(pa.float32()).to_numpy(zero_copy_only=False)
    m = flat.reshape(-1, dim).astype(np.float64)
    norm = np.linalg.norm(m, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return (m[good] / norm[good, None]).astype(np.float32), rows[good]


def _means(x: np.ndarray, count: int, rng: np.random.Generator, rounds: int = 4) -> np.ndarray:
    """Centres of unit vectors by a few rounds of spherical k-means."""
    centres = x[rng.choice(len(x), min(count, len(x)), replace=False)]
    for _ in range(rounds):
        sums, near = np.zeros_like(centres), _nearest(x, centres, 1)[0][:, 0]
        np.add.at(sums, near, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-9), centres)
    return centres


def _sample(vectors: DataFrame, share: float, most: int, seed: int) -> DataFrame:
    return vectors.select("embedding").sample(min(1.0, share), seed=seed).limit(most)


def fit(vectors: DataFrame, dim: int, seed: int = 7, list_size: int = LIST_SIZE, lists: int | None = None) -> Index:
    """Fit centres on a bounded sample: SAMPLE_PER_LIST vectors for each of at most MOST_LISTS lists.

    Coarse cells are fitted on the driver from few vectors; each cell's share of the
    sample then is divided into lists by a task of its own, so the sample stays where
    it is. How many lists nearest vectors need is read off the few: so many that
    WANTED of the nearest ones among them lie in the lists that are probed.
    """
    total = max(1, vectors.count())
    lists = lists or int(min(MOST_LISTS, max(1, total // list_size)))
    cells = int(np.ceil(np.sqrt(lists)))
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0].astype(np.float32)
    few = cells * SAMPLE_PER_CELL
    rows = _sample(vectors, 1.3 * few / total, 2 * few, seed).toArrow()
    sample = _matrix(rows["embedding"], dim)[0] @ rotation if rows.num_rows else np.empty((0, dim), np.float32)
    if not len(sample):
        return Index(rotation, np.zeros((1, dim), np.float32), np.full(1, float(total)))
    coarse = _means(sample, cells, rng)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch["embedding"], dim)[0] @ rotation
            near = _nearest(x, coarse, 1)[0][:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(near.astype("int32")), _binary(x)], ["cell", "vec"])

    def divide(group: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(group["vec"].to_pylist()), np.float32).reshape(-1, dim)
        x = x[np.lexsort(x[:, :2].T)]  # rows come in no order
        centres = _means(x, max(1, round(len(x) / SAMPLE_PER_LIST)), np.random.default_rng(seed))
        held = np.bincount(_nearest(x, centres, 1)[0][:, 0], minlength=len(centres))
        return pa.table({"cell": pa.array(np.full(len(centres), group["cell"][0].as_py(), np.int32)), "centre": _binary(centres), "held": pa.array(held)})

    wanted = lists * SAMPLE_PER_LIST
    made = vectors.select("embedding").sample(min(1.0, 1.1 * wanted / total), seed=seed + 1).mapInArrow(place, "cell int, vec binary").groupBy("cell").applyInArrow(divide, "cell int, centre binary, held long").toArrow().sort_by([("cell", "ascending"), ("centre", "ascending")])
    if not made.num_rows:
        return Index(rotation, coarse, np.full(len(coarse), total / len(coarse)))
    centres = np.frombuffer(b"".join(made["centre"].to_pylist()), np.float32).reshape(-1, dim)
    held = np.asarray(made["held"]).astype(float)
    return Index(rotation, centres, held / held.sum() * total, _probes(sample, centres, rng))


def _probes(sample: np.ndarray, centres: np.ndarray, rng: np.random.Generator) -> int:
    """How many lists hold WANTED of the nearest vectors in the sample, whose own ones are further away than those in all."""
    if len(sample) < 2 or len(centres) < 2:
        return len(centres)
    asks = rng.choice(len(sample), min(ASKERS, len(sample)), replace=False)
    sims = sample[asks] @ sample.T
    sims[np.arange(len(asks)), asks] = -2
    # copies of the asker are found in any case
    sims[sims > 1 - 1e-5] = -2
    at = _nearest(sample[sims.argmax(1)], centres, 1)[0][:, 0]
    near = sample[asks] @ centres.T
    rank = (near > near[np.arange(len(asks)), at][:, None]).sum(1)
    return int(min(len(centres), np.quantile(rank, WANTED, method="higher") + 1))


def _binary(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x, np.float32)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1] * 4), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())


def _nearest(x: np.ndarray, centres: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centres of every row, best first, and their cosines."""
    count = min(count, len(centres))
    out, sims = np.empty((len(x), count), np.int64), np.empty((len(x), count), np.float32)
    for a in range(0, len(x), 4096):
        s = x[a : a + 4096] @ centres.T
        if count == 1:
            top = s.argmax(1)[:, None]
        else:
            top = np.argpartition(-s, count - 1, axis=1)[:, :count]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1), 1)
        out[a : a + 4096], sims[a : a + 4096] = top, np.take_along_axis(s, top, 1)
    return out, sims


def _spread(index: Index, dim: int, probes: int, margin: float, asking: float) -> Callable:
    """Rows to lists: a stored row for the nearest list, and a question for every probed one.

    Stored rows are cut into blocks by how many a list holds, questions by how many of
    all rows ask, so a stored row is copied only for as many blocks as questions fill.
    """
    blocks = np.maximum(1, np.ceil(index.sizes / BLOCK)).astype(np.int64)
    q_blocks = np.maximum(1, np.ceil(index.sizes * asking * min(probes, len(index.centres)) / BLOCK)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, rows = _matrix(batch["embedding"], dim)
            if not len(x):
                continue
            x = x @ index.rotation
            ids, asks = batch["id"].take(pa.array(rows)), np.asarray(batch["asks"].take(pa.array(rows)).fill_null(False))
            near, sims = _nearest(x, index.centres, probes)
            # which block a row goes to depends on its id only, so that a task run again sends the same
            mix = (pd.util.hash_array(ids.to_numpy(zero_copy_only=False)) >> np.uint64(2)).astype(np.int64)
            own = near[:, 0]
            parts = []  # row, list, member block, question block, stored, asks
            mine, q_own = mix % blocks[own], q_blocks[own]
            for q in range(int(q_own.max())):
                pick = np.flatnonzero(q_own > q)
                # a row that asks the block it is stored in travels once
                parts.append((pick, own[pick], mine[pick], np.full(len(pick), q), np.ones(len(pick), bool), asks[pick] & ((mix // 7) % q_own == q)[pick]))
            for p in range(near.shape[1]):
                m_p, q_p = blocks[near[:, p]], q_blocks[near[:, p]]
                wanted = asks & (sims[:, p] >= sims[:, 0] - margin)
                for m in range(int(m_p.max())):
                    pick = np.flatnonzero(wanted & (m_p > m) & ((p > 0) | (mine != m)))
                    parts.append((pick, near[pick, p], np.full(len(pick), m), ((mix // 7) % q_p)[pick], np.zeros(len(pick), bool), np.ones(len(pick), bool)))
            row, at, mb, qb, stored, ask = (np.concatenate(c) for c in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at.astype("int32")), pa.array(mb.astype("int32")), pa.array(qb.astype("int32")), ids.take(pa.array(row)), pa.array(stored), pa.array(ask), _binary(x[row])],
                ["list_no", "m_block", "q_block", "id", "stored", "asks", "vec"],
            )

    return run


def _meet(dim: int, least: float | None, k: int | None) -> Callable:
    """One block of a list: every asker against every stored vector, column block by column block."""

    def run(group: pa.Table) -> pa.Table:
        vec = np.frombuffer(b"".join(group["vec"].to_pylist()), np.float32).reshape(-1, dim)
        stored, asks = np.asarray(group["stored"]), np.asarray(group["asks"])
        ids = group["id"].combine_chunks()
        m_rows, q_rows = np.flatnonzero(stored), np.flatnonzero(asks)
        found_q, found_m, found_c = [], [], []
        for a in range(0, len(q_rows), 512):
            q = vec[q_rows[a : a + 512]]
            bound = np.full(len(q), 2 - 2 * least, np.float32) if least is not None else _bound(q, vec[m_rows], k)
            for b in range(0, len(m_rows), 2048):
                m = vec[m_rows[b : b + 2048]]
                i, j, dist = _scan(q, m, bound)
                same = q_rows[a + i] == m_rows[b + j]
                i, j, dist = i[~same], j[~same], dist[~same]
                found_q.append(q_rows[a + i])
                found_m.append(m_rows[b + j])
                found_c.append(1 - dist / 2)
                if k is not None and len(i):
                    # the k-th best so far bounds what comes
                    order = np.lexsort((dist, i))
                    first = np.searchsorted(i[order], np.arange(len(q)))
                    kth = first + k - 1
                    has = (kth < len(order)) & (i[order[np.minimum(kth, len(order) - 1)]] == np.arange(len(q)))
                    bound[has] = np.minimum(bound[has], dist[order[kth[has]]])
        if not found_q:
            found_q = found_m = [np.empty(0, np.int64)]
            found_c = [np.empty(0, np.float32)]
        fq, fm, fc = np.concatenate(found_q), np.concatenate(found_m), np.concatenate(found_c)
        if k is not None and len(fq):
            order = np.lexsort((-fc, fq))
            fq, fm, fc = fq[order], fm[order], fc[order]
            # ties with the k-th stay; the last cut over all lists decides
            kth = fc[np.minimum(np.searchsorted(fq, fq) + k - 1, np.searchsorted(fq, fq, side="right") - 1)]
            keep = fc >= kth
            fq, fm, fc = fq[keep], fm[keep], fc[keep]
        return pa.table({"id": ids.take(pa.array(fq)), "other": ids.take(pa.array(fm)), "cosine": pa.array(fc.astype("float64"))})

    return run


def _bound(q: np.ndarray, m: np.ndarray, k: int) -> np.ndarray:
    """The distance within which k stored rows lie beside one that may be the asker itself, from a few rows of the whole list."""
    few = m[np.unique(np.linspace(0, len(m) - 1, min(len(m), max(FIRST, 4 * (k + 1)))).astype(int))] if len(m) else m
    if len(few) <= k:
        return np.full(len(q), np.inf, np.float32)
    return np.partition(2 - 2 * (q @ few.T), k, axis=1)[:, k] + 1e-4


def _scan(q: np.ndarray, m: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Askers, stored rows and squared distances that pass all tests against each asker's bound.

    While many candidates are left, a block of columns is summed for all of them at
    once; when few are, each is followed by itself.
    """
    dim = q.shape[1]

    def limit(d: int) -> np.ndarray:
        return bound * (d / dim) * (1 + EPSILON / np.sqrt(d)) ** 2 if d < dim else bound + 1e-5

    part = np.zeros((len(q), len(m)), np.float32)
    to, alive = 0, np.ones(part.shape, bool)
    while to < dim:
        d, to = to, min(to + COLUMNS, dim)
        x, y = q[:, d:to], m[:, d:to]
        part += (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
        alive &= part <= limit(to)[:, None]
        if to < dim and np.count_nonzero(alive) < FEW * alive.size:
            break
    i, j = np.nonzero(alive)
    dist = part[i, j]
    while to < dim:
        d, to = to, min(to + COLUMNS, dim)
        dist = dist + ((q[i, d:to] - m[j, d:to]) ** 2).sum(1)
        keep = dist <= limit(to)[i]
        i, j, dist = i[keep], j[keep], dist[keep]
    return i, j, ((q[i] - m[j]) ** 2).sum(1)


def usable(dim: int) -> Column:
    """Whether an embedding can be compared."""
    return (F.size("embedding") == dim) & F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def search(vectors: DataFrame, dim: int, *, least: float | None = None, k: int | None = None, probes: int | None = None, margin: float = 2.0, asks: str = "true", index: Index | None = None) -> DataFrame:
    """id, other and cosine: for every asking row the k most similar other rows, or all of at least a cosine.

    ``vectors`` has id string and embedding array<float>; other columns are ignored.
    ``asks`` is a condition for the rows that ask. Vectors that are null, of another
    length, all zero or not finite are no candidates and don't ask. Repeated rows of
    an id count once (for the k most similar, its smallest usable vector), and an id is
    never its own neighbour. Ties at the k-th place go to the smallest ids. No usable
    vectors give an empty result. ``probes`` lists are asked at most (by default as many
    as the index found to be needed), of those whose centre is within ``margin`` of the
    nearest one.
    """
    if (least is None) == (k is None):
        raise ValueError("give either least or k")
    rows = vectors.where("id is not null").select("id", "embedding", F.expr(asks).alias("asks"))
    index = index or fit(rows, dim)
    probes = probes or index.probes
    asking = rows.agg(F.avg(F.col("asks").cast("double"))).first()[0] or 0.0
    if k is not None:
        # places are counted in rows from here on, so copies of an id leave before the lists are scanned
        rows = rows.where(usable(dim)).groupBy("id").agg(F.min("embedding").alias("embedding"), F.max("asks").alias("asks"))
    sent = rows.mapInArrow(_spread(index, dim, probes, margin, asking), "list_no int, m_block int, q_block int, id string, stored boolean, asks boolean, vec binary")
    met = sent.groupBy("list_no", "m_block", "q_block").applyInArrow(_meet(dim, least, k), "id string, other string, cosine double")
    pairs = met.where("id <> other")
    if k is None:
        return pairs.groupBy("id", "other").agg(F.max("cosine").alias("cosine"))
    best = F.array_sort(F.collect_set(F.struct((-F.col("cosine")).alias("c"), "other")))
    # an id is stored once, so a pair comes out once; at most probes * blocks * (k and ties) rows an id meet here
    return pairs.groupBy("id").agg(F.slice(best, 1, k).alias("best")).select("id", F.explode("best").alias("b")).select("id", F.col("b.other").alias("other"), (-F.col("b.c")).alias("cosine"))


def linked(vectors: DataFrame, dim: int, least: float, **options) -> tuple[DataFrame, DataFrame]:
    """Links of at least a cosine without making every pair of copies: membership, and pairs of classes.

    Rows with equal vectors are one class, named by its smallest id. The first frame has
    id, class_id and n_links (how many other ids are at least so similar) of every id
    with a usable vector; the second has class_a, class_b (smaller first) and cosine.
    Repeated rows of an id count once, by its smallest vector. An empty table gives
    empty results.
    """
    rows = keep(vectors.where("id is not null").where(usable(dim)).groupBy("id").agg(F.min("embedding").alias("embedding")))
    # fitted on the vectors as they lie in their files, so that a run repeats
    index = options.pop("index", None) or fit(vectors, dim)
    heads = keep(rows.groupBy("embedding").agg(F.min("id").alias("class_id"), F.count("*").alias("size")))
    found = search(heads.withColumnRenamed("class_id", "id"), dim, least=least, index=index, **options)
    # a link that one of two classes finds is one of both
    pairs = keep(found.unionByName(found.select(F.col("other").alias("id"), F.col("id").alias("other"), "cosine")).groupBy("id", "other").agg(F.max("cosine").alias("cosine")))
    sizes = heads.select("class_id", "size")
    others = pairs.join(sizes.withColumnRenamed("class_id", "other"), "other").groupBy(F.col("id").alias("class_id")).agg(F.sum("size").alias("near"))
    told = heads.join(others, "class_id", "left").select("embedding", "class_id", (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    split = F.pmod(F.xxhash64("id"), F.lit(SPLITS)).cast("int")
    members = rows.withColumn("_s", split).join(told.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1)))), ["embedding", "_s"])
    return members.select("id", "class_id", "n_links"), pairs.where("id < other").select(F.col("id").alias("class_a"), F.col("other").alias("class_b"), "cosine")
