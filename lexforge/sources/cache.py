"""Results kept by the content they were made from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _there(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def cached(rows: DataFrame, content: str, step: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """The rows with what ``step`` makes of them; contents that were seen before are taken from the table at ``path``.

    ``step`` gets content_key and the content column, each content once, and gives
    content_key and its results. A content under another name is found, and another
    content under the same name is made anew.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("content_key", F.sha2(F.coalesce(F.col(content).cast("binary"), F.lit("").cast("binary")), 256))
    new = keyed.select("content_key", content).dropDuplicates(["content_key"])
    if _there(spark, path):
        new = new.join(spark.read.parquet(path).select("content_key").distinct(), "content_key", "left_anti")
    step(new).write.mode("append").parquet(path)
    return keyed.join(spark.read.parquet(path), "content_key").drop("content_key")


def spliced(sections: DataFrame, items: DataFrame) -> DataFrame:
    """Sections with the items that a kept outline has at the same place.

    ``sections`` and ``items`` have book, ch_idx and sec_idx, the places of the chapter and
    of the section in it; sections without kept items stay with none.
    """
    at = ["book", "ch_idx", "sec_idx"]
    held = items.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("ord", "name", "type"))).alias("items"))
    return sections.join(held, at, "left").withColumn("items", F.coalesce("items", F.array().cast("array<struct<ord: int, name: string, type: string>>")))
