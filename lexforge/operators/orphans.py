"""References to records that don't exist, or not yet.

Parent keys are cut into ranges; each range is one sorted array. References travel
to the range that could hold their key and are looked up there by binary search, a
batch at a time. Ranges that receive many references are split by salt: their parent
array, whose size is bounded, is sent to each split. Ranges of too many keys are cut
into parts by the hash of the key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.session import keep

#: Parent keys that one range should hold, and the most ranges for which bounds are kept on the driver.
KEYS_PER_RANGE, MOST_RANGES = 10_000, 10_000
#: Parent keys from which on a range is cut into parts by hash, each with an array of its own.
KEYS_PER_PART = 1_000_000
#: References that one split of a range should receive.
REFERENCES_PER_SPLIT = 500_000
#: Keys up to this length are held in arrays of fixed width.
LONG_KEY = 100


def range_bounds(parents: DataFrame, key: str, keys_per_range: int = KEYS_PER_RANGE) -> list[str]:
    """Upper bounds of key ranges, from a bounded sample of distinct keys.

    The sample decides only how evenly work is spread, never a result.
    """
    total = parents.count()
    ranges = int(min(MOST_RANGES, max(1, -(-total // keys_per_range))))
    if ranges == 1:
        return []
    wanted = min(total, ranges * 20)
    sample = sorted(r[0] for r in parents.select(key).sample(min(1.0, 1.2 * wanted / total), seed=7).limit(2 * wanted).collect())
    step = max(1, len(sample) // ranges)
    return sorted(set(sample[step::step]))[: ranges - 1]


def _range_of(key: Column, bounds: list[str]) -> Column:
    """The number of bounds that are not above the key."""
    if not bounds:
        return F.lit(0)

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(_sortable(pa.array(bounds)), _sortable(pa.array(keys, pa.string()).fill_null("")), side="right").astype("int32"))

    return place(key)


def _sortable(keys: pa.Array) -> np.ndarray:
    """Keys as an array that sorts by code point; of fixed width unless one of them is long."""
    plain = keys.to_numpy(zero_copy_only=False)
    longest = pc.max(pc.utf8_length(keys)).as_py() or 0
    return plain.astype(str) if longest <= LONG_KEY and len(plain) else plain


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by range and split, parents first; parent arrays are kept for one split only."""
    place, parts, keys, times = None, [], np.empty(0, object), np.empty(0, "int64")
    for batch in batches:
        group = batch["place"].to_numpy(zero_copy_only=False)
        is_parent = batch["is_parent"].to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.diff(group)) + 1
        for start, end in zip([0, *edges], [*edges, len(group)], strict=True):
            if start == end:
                continue
            if group[start] != place:
                place, parts = group[start], []
                keys, times = np.empty(0, object), np.empty(0, "int64")
            middle = start + int(is_parent[start:end].sum())
            if middle > start:
                parts.append((_sortable(batch["key"].slice(start, middle - start)), batch["at"].slice(start, middle - start).fill_null(np.iinfo("int64").min).to_numpy(zero_copy_only=False)))
            if middle == end:
                continue
            if parts:
                keys = np.concatenate([keys, *(p[0] for p in parts)] if len(keys) else [p[0] for p in parts])
                times = np.concatenate([times, *(p[1] for p in parts)])
                order = np.argsort(keys, kind="stable")
                keys, times, parts = keys[order], times[order], []
            asked = _sortable(batch["key"].slice(middle, end - middle))
            if len(keys):
                at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                known, since = keys[at] == asked, times[at]
            else:
                known, since = np.zeros(len(asked), bool), np.zeros(len(asked), "int64")
            when = batch["at"].slice(middle, end - middle).fill_null(np.iinfo("int64").max).to_numpy(zero_copy_only=False)
            state = np.where(~known, "missing", np.where(since > when, "later", "known"))
            part = batch.slice(middle, end - middle)
            yield pa.RecordBatch.from_arrays([part["ref_id"], part["endpoint"], part["period"], pa.array(state, pa.string())], ["ref_id", "endpoint", "period", "state"])


def resolve_references(references: DataFrame, parents: DataFrame, keys_per_range: int = KEYS_PER_RANGE, references_per_split: int = REFERENCES_PER_SPLIT, keys_per_part: int = KEYS_PER_PART) -> DataFrame:
    """State of every reference: known, later (its parent was loaded after it) or missing.

    ``references`` has ref_id bigint, endpoint string, key string, at timestamp and
    period string; ``parents`` has key string and at timestamp. Keys are compared as
    they are. Rows with a null key are no references and don't come out. Repeated
    parents count as one with the earliest time; a null parent time counts as always
    loaded, a null reference time as loaded last. Repeated references stay repeated.
    Other columns are ignored. Empty tables give an empty result, or all missing.
    """
    parents = keep(parents.where(F.col("key").isNotNull()).groupBy("key").agg(F.min(F.coalesce(F.unix_micros(F.col("at").cast("timestamp")), F.lit(-(2**62)))).alias("at")))
    references = references.where(F.col("key").isNotNull())
    bounds = range_bounds(parents, "key", keys_per_range)
    refs = references.select("ref_id", "endpoint", "key", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "period").withColumn("range_no", _range_of(F.col("key"), bounds))
    placed = parents.withColumn("range_no", _range_of(F.col("key"), bounds))
    # a range of very many keys, beyond MOST_RANGES of them, is cut by hash; its references go to their key's part
    parts = {r["range_no"]: -(-r["count"] // keys_per_part) for r in placed.groupBy("range_no").count().where(F.col("count") > keys_per_part).collect()}
    splits = {r["range_no"]: -(-r["count"] // references_per_split) for r in refs.groupBy("range_no").count().where(F.col("count") > references_per_split).collect()}

    def of(counts: dict[int, int]) -> Column:
        return F.coalesce(F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])[F.col("range_no")], F.lit(1)) if counts else F.lit(1)

    part = F.pmod(F.xxhash64("key"), of(parts)).cast("long")
    place = lambda split: (F.col("range_no").cast("long") * 1_000_000 + part) * 1_000_000 + split
    refs = refs.withColumn("place", place(F.pmod(F.xxhash64("ref_id", "endpoint"), of(splits)).cast("long"))).withColumn("is_parent", F.lit(0)).drop("range_no")
    known = placed.withColumn("split_no", F.explode(F.sequence(F.lit(0), of(splits).cast("int") - 1))).select(
        F.lit(None).cast(references.schema["ref_id"].dataType).alias("ref_id"), F.lit(None).cast("string").alias("endpoint"), "key", "at", F.lit(None).cast("string").alias("period"), place(F.col("split_no").cast("long")).alias("place"), F.lit(1).alias("is_parent")
    )
    both = refs.select(*known.columns).unionByName(known).repartition("place").sortWithinPartitions("place", F.desc("is_parent"))
    kind = references.schema["ref_id"].dataType.simpleString()
    return both.mapInArrow(_probe, f"ref_id {kind}, endpoint string, period string, state string")


def report(states: DataFrame, table: str) -> DataFrame:
    """References and orphans counted per table, end and period."""
    return states.groupBy(F.lit(table).alias("table_name"), "endpoint", "period").agg(
        F.count("*").alias("reference_rows"),
        F.count_if(F.col("state") == "missing").alias("missing_rows"),
        F.count_if(F.col("state") == "later").alias("later_rows"),
    )
