"""Texts to overlapping chunks that end at sentence boundaries.

Where a chunk ends decides where the next begins, so the windows of one text are
found in turn; texts are independent of each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a chunk may end, in order of preference.
BOUNDARIES = ("。", "！", "？", "\n\n", "\n", ".", "!", "?")


@dataclass(frozen=True)
class Rule:
    """Size and overlap in characters, the share of the size from which a boundary is sought,
    how far from the start it must lie beyond (the sought place itself if None), the least
    length kept, and whether a text that fits goes through as it is."""

    size: int
    overlap: int
    look_from: float
    beyond: int | None = None
    least: int = 1
    whole_if_short: bool = False
    strip_short: bool = True


BATCHES = Rule(4000, 200, 0.85, whole_if_short=True, strip_short=False)
RETRIEVAL = Rule(600, 80, 0.8, whole_if_short=True)
PAGES = Rule(500, 60, 0.8, beyond=100, least=21)


def windows(text: str, rule: Rule) -> Iterator[tuple[int, int]]:
    """Start and end of every window of a text."""
    start, length = 0, len(text)
    while start < length:
        end = start + rule.size
        if end >= length:
            yield start, length
            return
        sought = int(start + rule.size * rule.look_from) if rule.beyond is not None else start + int(rule.size * rule.look_from)
        limit = start + rule.beyond if rule.beyond is not None else sought
        hits = (text.rfind(b, sought, end) for b in BOUNDARIES)
        end = next((at + 1 for at in hits if at > limit), end)
        yield start, end
        start = end - rule.overlap


def pieces(text: str, rule: Rule) -> Iterator[tuple[int, str]]:
    """Offset and stripped text of every chunk that is kept."""
    if rule.whole_if_short and len(text) <= rule.size:
        kept = text.strip() if rule.strip_short else text
        if kept or not rule.strip_short:
            yield 0, kept
        return
    for start, end in windows(text, rule):
        chunk = text[start:end].strip()
        if len(chunk) >= rule.least:
            yield start, chunk


def chunk(rows: DataFrame, text: str, rule: Rule, keep: list[str]) -> DataFrame:
    """The kept columns with chunk_no, n_chunks, char_offset, chunk; null and empty texts have no chunks."""
    fields = [rows.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, no, of, at, out = [], [], [], [], []
            for i, t in enumerate(batch["_text"].to_pylist()):
                got = list(pieces(t, rule)) if t else []
                row += [i] * len(got)
                no += range(len(got))
                of += [len(got)] * len(got)
                at += [g[0] for g in got]
                out += [g[1] for g in got]
            pick = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch[c].take(pick) for c in keep), pa.array(no, pa.int32()), pa.array(of, pa.int32()), pa.array(at, pa.int32()), pa.array(out, pa.string())], [*keep, "chunk_no", "n_chunks", "char_offset", "chunk"])

    shape = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    return rows.select(*keep, F.col(text).alias("_text")).mapInArrow(run, shape + "chunk_no int, n_chunks int, char_offset int, chunk string")


def page_by_share(first: Column, last: Column, part: Column, whole: Column, span: Column) -> Column:
    """The page at a share of a chapter, not beyond its last one."""
    return F.least(first + F.floor(part / F.greatest(whole, F.lit(1)) * span).cast("int"), last)
