"""Replaceable steps: language model, embedder and text recognition, with answers that need no network."""

from __future__ import annotations

import hashlib
import json
import os
import random
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.session import ship

Messages = list[dict[str, str]]
Model = Callable[[Messages], str]

#: Answers when no model is configured (fixed values of the offline contract).
NO_ANSWER = "（未配置语言模型，无法生成回答。）"


def no_extraction(messages: Messages) -> str:
    return json.dumps({"nodes": [], "edges": []})


def no_merge(messages: Messages) -> str:
    return json.dumps({"is_same": False, "confidence": 0.5, "action": "keep", "best_source": "a", "reason": ""})


def no_answer(messages: Messages) -> str:
    return NO_ANSWER


def hashed_vector(text: str, dim: int = 64) -> list[float]:
    """A unit vector of hashed pairs of characters; a stand-in that needs no model, without meaning."""
    v = np.zeros(dim)
    for k in range(len(text)):
        h = int.from_bytes(hashlib.md5(text[k : k + 2].encode("utf-8", "replace")).digest()[:8], "little")
        v[h % dim] += 1.0 if h >> 63 else -1.0
    norm = np.linalg.norm(v)
    return (v / norm if norm else v).tolist()


def resolve_model(name: str, mirror: Callable[[str], str] | None = None, folders: tuple[str, ...] = ()) -> str:
    """Where a model lies: where a mirror puts it, or a folder of its name, or else the name itself for a hub to resolve."""
    try:
        found = mirror(name) if mirror else ""
        if os.path.isdir(found):
            return found
    except Exception:  # noqa: BLE001 - a mirror that can't be reached is passed over
        pass
    for folder in folders:
        path = os.path.join(folder, name)
        if os.path.isdir(path):
            return path
    return name


_MADE: dict[str, object] = {}


def once(key: str, make: Callable[[], object]) -> object:
    """What ``make`` builds, built once in each Python process."""
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def embed(rows: DataFrame, text: str, make: Callable[[], Callable[[list[str]], list[list[float]]]] | None = None, to: str = "embedding", key: str | None = None) -> DataFrame:
    """Add a vector for a text column.

    ``make`` builds the encoder, once for each task, or with a ``key`` once in each Python process.
    """
    ship(rows.sparkSession)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = (once(key, make) if key else make()) if make else (lambda texts: [hashed_vector(t) for t in texts])
        for batch in batches:
            yield pd.Series(encode([t or "" for t in batch]))

    return rows.withColumn(to, run(F.col(text)))


def backoff(k: int) -> None:
    """Wait longer after every failure, and never as long as another task."""
    time.sleep(2**k + random.uniform(0, 1))


def pace() -> None:
    """A short pause between calls, for services that count them."""
    time.sleep(random.uniform(0.5, 1.5))


class Progress:
    """How many of all calls are done, counted in the tasks, and how long the rest may take."""

    def __init__(self, spark: SparkSession, total: int):
        self.counter, self.total, self.began = spark.sparkContext.accumulator(0), total, time.time()

    @property
    def done(self) -> int:
        return self.counter.value

    def share(self) -> float:
        return self.done / max(self.total, 1)

    def seconds_left(self, now: float | None = None) -> float | None:
        """None before anything is done."""
        gone = (now if now is not None else time.time()) - self.began
        return gone / self.done * max(self.total - self.done, 0) if self.done else None


def ask(rows: DataFrame, prompt: str, make: Callable[[], Model], to: str = "raw", tries: int = 5, wait: Callable[[int], None] | None = backoff, system: str = "", between: Callable[[], None] | None = None, progress: Progress | None = None, retry_on: tuple[type[BaseException], ...] = (OSError,)) -> DataFrame:
    """Add the answer to a prompt column, and the error where all tries failed.

    Failures of the network (OSError and what derives from it) are tried again after a
    wait; any other error is the row's own and is told at once, so one row never stops
    the others. Write the result before it is used twice: a lazy plan would ask again.
    """
    ship(rows.sparkSession)
    counter = progress.counter if progress else None

    @F.pandas_udf("struct<raw: string, error: string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            out = []
            for text in batch:
                answer, error = None, None
                messages = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": text or ""}]
                for k in range(tries):
                    try:
                        answer, error = model(messages), None
                        break
                    except retry_on as x:
                        error = str(x)
                        if wait and k + 1 < tries:
                            wait(k)
                    except Exception as x:  # noqa: BLE001
                        error = str(x)
                        break
                out.append((answer, error))
                if counter is not None:
                    counter.add(1)
                if between:
                    between()
            yield pd.DataFrame(out, columns=["raw", "error"])

    return rows.withColumn("_a", run(F.col(prompt))).withColumn(to, F.col("_a.raw")).withColumn(f"{to}_error", F.col("_a.error")).drop("_a")
