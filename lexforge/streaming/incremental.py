"""Runs over what arrived since the last one, that can stop and go on at any time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexforge.schemas import schema

#: Column of a result that holds the number of the batch its row came in.
ARRIVAL = "arrival"


def run_new(spark: SparkSession, source: str, table: str, step: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, key: str = "textbook_id", on_batch: Callable[[int], None] | None = None) -> StreamingQuery:
    """Apply a step to rows of new Parquet files and write the result by key and batch; ends when nothing new is left.

    Every batch has folders of its own under those of the keys (column ``arrival``), so
    rows of a key that arrive later leave the earlier ones alone. A batch that is run
    again writes the same folders again, so a lost run leaves no doubles. Rows delivered
    again in a later batch come out again; the operators count them once. ``on_batch``
    is told the number of every batch that is done.
    """
    arrived = spark.readStream.schema(schema(table)).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        step(batch).withColumn(ARRIVAL, F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key, ARRIVAL).parquet(target)
        if on_batch:
            on_batch(number)

    query = arrived.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def pending(all_keys: DataFrame, done: DataFrame, key: str = "textbook_id") -> DataFrame:
    """Keys without a finished result."""
    return all_keys.select(key).distinct().join(done.select(key).distinct(), key, "left_anti")
