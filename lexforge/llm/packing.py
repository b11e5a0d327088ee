"""Filling containers of fixed capacity with items of varying length.

The lengths of all items make one histogram, which is no longer than the capacity.
Dynamic programming over it chooses bucket boundaries with the least padding; inside
the buckets, largest first, token-budget batches are formed by counts alone: a batch
takes as many items of its bucket as fit, and room that would stay empty is offered
to the smaller buckets. Items then find their container from their rank in their
bucket. Only histograms and batch recipes, whose size the capacity bounds, are on the
driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.session import cut

#: Buckets of a capacity, and items of a bucket that are ranked in one task.
BUCKETS, RANKED = 256, 100_000


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Upper bounds of the buckets that need the least padding, by dynamic programming over the histogram.

    ``lengths`` are distinct and ascending. A bucket costs what its items lack to its
    upper bound. The best cost is convex in the number of buckets, so a price for each
    bucket is sought at which the wanted number is a best one; for one price the best
    predecessor of a length is the lowest of lines in that length, kept as a hull.
    """
    m = len(lengths)
    if m <= buckets:
        return lengths
    # in units so small that the number of buckets decides between equal costs
    unit = m + 1
    n = [0, *(unit * np.cumsum(counts)).tolist()]
    s = [0, *(unit * np.cumsum(counts * lengths)).tolist()]
    size = [0, *lengths.tolist()]
    low, high = 0, 2 * size[-1] * int(counts.sum()) + 1  # costs and prices are whole numbers
    while low < high:
        mid = (low + high) // 2
        if len(_cheapest(n, s, size, mid * unit + 1)) - 1 <= buckets:
            high = mid
        else:
            low = mid + 1
    few = _cheapest(n, s, size, low * unit + 1)
    # at a price lower by one the fewest buckets are the most that are still cheapest at this one
    many = _cheapest(n, s, size, (low - 1) * unit + 1) if low else few
    return np.array([size[j] for j in _blend(few, many, buckets)[1:]])


def _cheapest(n: list[int], s: list[int], size: list[int], price: int) -> list[int]:
    """Ends of the buckets of the cheapest division at a price for each bucket, from 0 to the last."""
    m = len(n) - 1
    best, before = [0] * (m + 1), [0] * (m + 1)
    # the line of a predecessor i at length x is best[i] + s[i] - n[i] x; slopes fall and lengths grow
    hull, head = [0], 0
    for j in range(1, m + 1):
        x = size[j]
        while head + 1 < len(hull):
            a, b = hull[head], hull[head + 1]
            if best[b] + s[b] - n[b] * x > best[a] + s[a] - n[a] * x:
                break
            head += 1
        i = before[j] = hull[head]
        best[j] = best[i] + s[i] - n[i] * x + x * n[j] - s[j] + price
        c = best[j] + s[j]
        while len(hull) - head > 1:
            a, b = hull[-2], hull[-1]
            if (best[b] + s[b] - best[a] - s[a]) * (n[j] - n[b]) < (c - best[b] - s[b]) * (n[b] - n[a]):
                break
            hull.pop()
        hull.append(j)
    out = [m]
    while out[-1]:
        out.append(before[out[-1]])
    return out[::-1]


def _blend(few: list[int], many: list[int], buckets: int) -> list[int]:
    """Of two cheapest divisions at one price one with a number of buckets between.

    Where a bucket of the few holds one of the many, the start of the many and the rest
    of the few go together at the same cost.
    """
    more = buckets - (len(few) - 1)
    if more <= 0:
        return few
    if len(many) - 1 <= buckets:
        return many
    for i in range(len(few) - 1):
        if few[i] <= many[i + more] and many[i + more + 1] <= few[i + 1]:
            return [*many[: i + more + 1], *few[i + 1 :]]
    return few


@dataclass
class Plan:
    """Segments of ranks by bucket: items from rank start on go, take at a time, to containers from first on."""

    bounds: np.ndarray
    starts: list[np.ndarray]
    takes: list[np.ndarray]
    firsts: list[np.ndarray]
    containers: int


def recipes(bounds: np.ndarray, counts: np.ndarray, capacity: int) -> Plan:
    """Batches by counts: each recipe is repeated until one of its buckets runs out."""
    left, used = counts.astype(np.int64).copy(), np.zeros(len(bounds), np.int64)
    segments: list[list[tuple[int, int, int]]] = [[] for _ in bounds]
    container = 0
    for j in range(len(bounds) - 1, -1, -1):
        while left[j] > 0:
            room, takes = capacity, {}
            i = j
            while i >= 0 and room >= bounds[0]:
                i = min(i, int(np.searchsorted(bounds, room, side="right")) - 1)
                if i < 0:
                    break
                if left[i] > 0:
                    t = int(min(left[i], room // bounds[i]))
                    if t:
                        takes[i] = t
                        room -= t * int(bounds[i])
                i -= 1
            times = max(1, min(int(left[i] // t) for i, t in takes.items()))
            for i, t in takes.items():
                segments[i].append((int(used[i]), t, container))
                used[i] += t * times
                left[i] -= t * times
            container += times
    cols = [np.array(s, np.int64).reshape(-1, 3) for s in segments]
    return Plan(bounds, [c[:, 0] for c in cols], [c[:, 1] for c in cols], [c[:, 2] for c in cols], container)


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """doc_id, piece_no, token_start, n_tokens and container_id: every item in a container of the capacity.

    ``items`` has doc_id (unique) and n_tokens; other columns are ignored. An item
    longer than the capacity is cut into full containers and a rest, others are never
    divided. Items of no or null size take no room and don't come out. An empty table
    gives an empty result. Equal lengths are ranked by hash and id, so a run repeats.
    """
    whole = items.where("n_tokens > 0").select("doc_id", F.col("n_tokens").cast("long").alias("size"))
    full = F.explode(F.sequence(F.lit(0), F.floor(F.col("size") / capacity).cast("int") - 1))
    fulls = whole.where(F.col("size") >= capacity).select("doc_id", full.alias("piece_no")).select(
        "doc_id", "piece_no", (F.col("piece_no").cast("long") * capacity).alias("token_start"), F.lit(capacity).cast("long").alias("n_tokens"), F.concat(F.lit("full_"), F.col("doc_id").cast("string"), F.lit("_"), F.col("piece_no").cast("string")).alias("container_id")
    )
    rest = cut(whole.select("doc_id", F.floor(F.col("size") / capacity).cast("int").alias("piece_no"), (F.col("size") % capacity).alias("n_tokens")).where("n_tokens > 0"))
    hist = sorted((r[0], r[1]) for r in rest.groupBy("n_tokens").count().collect())  # fewer rows than the capacity
    if not hist:
        return fulls
    lengths, counts = (np.array(x, np.int64) for x in zip(*hist, strict=True))
    bounds = boundaries(lengths, counts)
    place = np.searchsorted(bounds, lengths)
    per = np.bincount(place, counts, len(bounds)).astype(np.int64)
    plan = recipes(bounds, per, capacity)
    splits = np.maximum(1, -(-per // RANKED))

    @F.pandas_udf("int")
    def bucket_of(size: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, size.to_numpy()).astype(np.int32))

    @F.pandas_udf("int")
    def splits_of(bucket: pd.Series) -> pd.Series:
        return pd.Series(splits[bucket.to_numpy()].astype(np.int32))

    placed = rest.withColumn("bucket", bucket_of("n_tokens"))
    placed = cut(placed.withColumn("split", F.pmod(F.xxhash64("doc_id"), splits_of("bucket")).cast("int")))
    # items / RANKED + buckets rows
    first_split = np.concatenate([[0], np.cumsum(splits)[:-1]])
    sizes = np.zeros(int(splits.sum()), np.int64)
    for r in placed.groupBy("bucket", "split").count().collect():
        sizes[first_split[r[0]] + r[1]] = r[2]
    before = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    offset = before - np.repeat(before[first_split], splits)
    ranked = placed.withColumn("row", F.row_number().over(Window.partitionBy("bucket", "split").orderBy("doc_id")) - 1)

    @F.pandas_udf("long")
    def container_of(bucket: pd.Series, split: pd.Series, row: pd.Series) -> pd.Series:
        out = np.empty(len(bucket), np.int64)
        b = bucket.to_numpy()
        rank = row.to_numpy() + offset[first_split[b] + split.to_numpy()]
        for x in np.unique(b):
            own = b == x
            seg = np.searchsorted(plan.starts[x], rank[own], side="right") - 1
            out[own] = plan.firsts[x][seg] + (rank[own] - plan.starts[x][seg]) // plan.takes[x][seg]
        return pd.Series(out)

    batched = ranked.select("doc_id", "piece_no", (F.col("piece_no").cast("long") * capacity).alias("token_start"), "n_tokens", F.concat(F.lit("batch_"), container_of("bucket", "split", "row").cast("string")).alias("container_id"))
    return fulls.unionByName(batched)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, and the share of room unused."""
    return packed.agg(F.countDistinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens")).select("containers", "tokens", F.round(1 - F.col("tokens") / (F.col("containers") * capacity), 6).alias("unused_share"))
