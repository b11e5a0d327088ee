"""Mixing sources to target weights, by entropy balancing.

Every document gets a rate, its expected number of copies. Of all rates below the cap
those are wanted that give each source its tokens and are otherwise as even as
possible. The dual of this convex problem has one multiplier for each source of a
mix; Newton steps find them, and the odds of a document come out tilted exponentially
by its length. A rate depends on nothing but source and length, so the steps run on the
counts of documents by length, each source in a task of its own. Rates are rounded to
copies by a threshold that is common to a source and makes its tokens come out right.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from lexforge.functions.text import strip
from lexforge.session import cut, keep

#: Newton steps at most, and the relative error at which a source is done.
STEPS, ENOUGH = 100, 1e-6
#: Thresholds tried at once, and passes over them.
TRIES, PASSES = 4096, 2


def source_key(source: Column) -> Column:
    """A source's name in lower case, without blanks at its ends, with underscores between words."""
    key = F.regexp_replace(F.lower(strip(source)), r"[\s\-_]+", "_")
    return F.when(key != "", key)


@dataclass
class State:
    """A source of a mix: wanted tokens, cap, tilt and threshold shift."""

    mix: str
    source: str
    share: float
    cap: int
    held: int
    docs: int
    wanted: float = 0.0
    tilt: float = 0.0
    shift: float = 0.0
    done: bool = False


_SENT = "mix string, source string, cap double, mean double, tilt double, shift double, lo double, step double, wanted double"


def _send(frame: DataFrame, states: list[State], lo: dict | None = None, step: float = 0.0) -> DataFrame:
    """The states, no more rows than target rows, beside the documents of their source."""
    rows = [(s.mix, s.source, float(s.cap), s.held / max(s.docs, 1), s.tilt, s.shift, (lo or {}).get((s.mix, s.source), 0.0), step, s.wanted) for s in states]
    small = frame.sparkSession.createDataFrame(rows, _SENT)
    return frame.join(F.broadcast(small), "source")


def _odds() -> Column:
    """The rate as a share of the cap."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-600.0), F.least(F.lit(600.0), F.col("tilt") * F.col("n_tokens") / F.col("mean")))))


def mix(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """mix, source, doc_id, n_tokens and copies of every document that is drawn.

    ``documents`` has doc_id (unique), source and n_tokens; ``targets`` has mix, source,
    target_share and max_repeats, and is small (its rows are held on the driver). Other
    columns are ignored. Sources compare by source_key; target rows of one mix and
    source add up. The total is the largest at which no source needs more than
    max_repeats of what it holds; a source without tokens can't have its share, and the
    others keep their proportions. Documents without source or tokens aren't drawn.
    Null shares and repeats count as none. Empty tables give an empty result. A source
    whose multiplier can't be found raises an error.
    """
    docs = keep(documents.where("n_tokens > 0").select("doc_id", source_key(F.col("source")).alias("source"), F.col("n_tokens").cast("double").alias("n_tokens")).where("source is not null"))
    lengths = cut(docs.groupBy("source", "n_tokens").agg(F.count("*").alias("docs")))
    states = _states(lengths, targets)
    _balance(lengths, states)
    _round(docs, states)
    live = [s for s in states if s.wanted > 0]
    drawn = _send(docs, live).withColumn("copies", _copies(F.col("shift")))
    return drawn.where("copies > 0").select("mix", "source", "doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), "copies")


def _states(lengths: DataFrame, targets: DataFrame) -> list[State]:
    wanted: list[Row] = targets.where("mix is not null").groupBy("mix", source_key(F.col("source")).alias("source")).agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("cap")).collect()
    names = {w.source for w in wanted}
    held = {r.source: (r.held, r.docs) for r in lengths.where(F.col("source").isin([n for n in names if n])).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("docs")).alias("held"), F.sum("docs").alias("docs")).collect()}
    states = [State(w.mix, w.source, w.share, w.cap, *held.get(w.source, (0, 0))) for w in wanted]
    for name in {s.mix for s in states}:
        own = [s for s in states if s.mix == name and s.share > 0 and s.cap > 0 and s.held > 0]
        total = min((s.cap * s.held / s.share for s in own), default=0.0)
        for s in own:
            s.wanted = s.share * total
    return states


def _newton(steps: int) -> Callable:
    """The multiplier of one source of a mix; a step that leaves its bracket is replaced by halving."""

    def run(group: pa.Table) -> pa.Table:
        n, docs = np.asarray(group["n_tokens"]), np.asarray(group["docs"]).astype(float)
        first = {name: group[name][0].as_py() for name in ("mix", "source", "cap", "mean", "wanted")}
        tilt, low, high, off = 0.0, -400.0, 400.0, np.inf
        for _ in range(steps):
            odds = 1 / (1 + np.exp(-np.clip(tilt * n / first["mean"], -600, 600)))
            tokens = first["cap"] * odds * n * docs
            off = tokens.sum() - first["wanted"]
            if abs(off) <= ENOUGH * first["wanted"]:
                break
            low, high = (low, tilt) if off > 0 else (tilt, high)
            slope = (tokens * (1 - odds) * n / first["mean"]).sum()
            step = tilt - off / slope if slope > 0 else np.nan
            tilt = step if low < step < high else (low + high) / 2
        return pa.table({"mix": [first["mix"]], "source": [first["source"]], "tilt": [float(tilt)], "off": [float(abs(off) / first["wanted"])]})

    return run


def _balance(lengths: DataFrame, states: list[State]) -> None:
    """Find every multiplier."""
    for s in states:
        if s.wanted >= s.cap * s.held * (1 - 1e-9):
            s.tilt, s.done = 1e6, True
        elif s.wanted <= 0:
            s.done = True
    live = [s for s in states if not s.done]
    if not live:
        return
    found = {(r.mix, r.source): r for r in _send(lengths, live).select("mix", "source", "cap", "mean", "wanted", "n_tokens", "docs").groupBy("mix", "source").applyInArrow(_newton(STEPS), "mix string, source string, tilt double, off double").collect()}
    for s in live:
        r = found[s.mix, s.source]
        if r.off > ENOUGH:
            raise RuntimeError(f"no multiplier gives source {s.source} of mix {s.mix} its tokens: off by {r.off:.2g} of them after {STEPS} steps")
        s.tilt, s.done = r.tilt, True


def _at() -> Column:
    """A document's rate and a number in [0, 1) that is its own."""
    own = (F.xxhash64("doc_id", "mix").bitwiseAND(F.lit((1 << 40) - 1))) / float(1 << 40)
    return F.col("cap") * _odds() + own


def _whole(x: Column) -> Column:
    return F.least(F.col("cap"), F.greatest(F.lit(0.0), x))


def _copies(shift: Column) -> Column:
    """Whole copies: the rate, the document's own number, and the shift, rounded down; within the cap."""
    return _whole(F.floor(_at() + shift)).cast("int")


def _pick(tries: int) -> Callable:
    """Of one source the threshold whose tokens come nearest, and the last one that doesn't exceed them."""

    def run(group: pa.Table) -> pa.Table:
        tokens = np.zeros(tries + 1)
        np.add.at(tokens, np.asarray(group["j"]), np.asarray(group["tokens"]))
        first = {name: group[name][0].as_py() for name in ("mix", "source", "lo", "step", "wanted")}
        off = np.cumsum(tokens) - first["wanted"]
        best, below = int(np.abs(off).argmin()), max(0, int(np.searchsorted(off, 0, side="right")) - 1)
        return pa.table({"mix": [first["mix"]], "source": [first["source"]], "shift": [first["lo"] + first["step"] * best], "lo": [first["lo"] + first["step"] * below]})

    return run


def _round(docs: DataFrame, states: list[State]) -> None:
    """For each source the shift at which its copies hold the wanted tokens.

    A document's copies grow by one where its rate, its own number and the shift make
    up a whole number. These places are counted in TRIES steps of the shift, for all
    sources in one pass; the next pass looks into one step of each.
    """
    live = [s for s in states if s.wanted > 0]
    if not live:
        return
    lo, wide = {(s.mix, s.source): -1.0 for s in live}, 2.0
    for _ in range(PASSES):
        step = wide / TRIES
        at = _send(docs, live, lo, step).withColumn("x", _at()).withColumn("base", F.floor(F.col("x") + F.col("lo")))
        grows = [F.struct(F.ceil((F.col("base") + 1 + e - F.col("x") - F.col("lo")) / F.col("step")).cast("int").alias("j"), ((_whole(F.col("base") + 1 + e) - _whole(F.col("base") + e)) * F.col("n_tokens")).alias("tokens")) for e in range(int(-(-wide // 1)))]
        starts = F.struct(F.lit(0).alias("j"), (_whole(F.col("base")) * F.col("n_tokens")).alias("tokens"))
        events = at.select("mix", "source", "lo", "step", "wanted", F.explode(F.array(starts, *grows)).alias("e")).select("mix", "source", "lo", "step", "wanted", F.greatest("e.j", F.lit(0)).alias("j"), "e.tokens")
        sums = events.where((F.col("tokens") > 0) & (F.col("j") <= TRIES)).groupBy("mix", "source", "lo", "step", "wanted", "j").agg(F.sum("tokens").alias("tokens"))
        for r in sums.groupBy("mix", "source").applyInArrow(_pick(TRIES), "mix string, source string, shift double, lo double").collect():
            lo[r.mix, r.source] = r.lo
            for s in live:
                if (s.mix, s.source) == (r.mix, r.source):
                    s.shift = r.shift
        wide = step


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """mix, source, target_share, tokens, actual_share, documents and most_copies of every target row."""
    want = targets.where("mix is not null").groupBy("mix", source_key(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    got = drawn.groupBy("mix", "source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    whole = got.groupBy("mix").agg(F.sum("tokens").alias("all_tokens"))
    return want.join(got, ["mix", "source"], "left").join(whole, "mix", "left").select("mix", "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("actual_share"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
