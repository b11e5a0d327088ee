"""Tables and texts to files. Parquet is the record; JSON and Markdown are exports."""

from __future__ import annotations

from pyspark.sql import DataFrame


def save(frame: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Replace the partitions that the rows belong to, or the whole table."""
    writer = frame.write.mode("overwrite")
    if by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    writer.parquet(path)


def export_json(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").json(path)


def export_text(frame: DataFrame, path: str) -> None:
    """A frame of one string column to text files."""
    frame.coalesce(1).write.mode("overwrite").text(path)
