"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies on every machine; a parameter of all functions that count tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how this public vocabulary divides a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a rank file, loaded once in each process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, id_column: str = "doc_id", keep: tuple[str, ...] = (), path: str = VOCABULARY) -> DataFrame:
    """The id, the kept columns and n_tokens of every row, over whole texts; null texts have none."""
    rows = documents.select(F.col(id_column).alias("doc_id"), *keep, "text")
    fields = [f for f in rows.schema.fields if f.name != "text"]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(path)
        for batch in batches:
            sizes = [len(tokenizer.encode_ordinary(t)) if t else 0 for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(sizes, pa.int64())], [*names, "n_tokens"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens long")
