"""Per-document text statistics, and the type of text they speak for.

Statistics are computed for whole texts, a batch of documents at a time on arrays of
code points. Thresholds on them are labelling functions that are each right only
mostly; how far each can be trusted for each type of text is learnt from how they
agree, by expectation-maximisation over the counts of their joint answers, and the
posterior of the types comes out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.functions.text import strip
from lexforge.session import cut

TYPES = ["prose", "list", "table", "junk"]
#: The types of the kinds of text that are told apart in learning: prose; lists with marks, and of bare lines; tables of
#: cells, and of markup; junk that is no text, that says one thing again and again, and of words in no order.
KINDS = ["prose", "list", "list", "table", "table", "junk", "junk", "junk"]
#: The share of each kind from which learning starts.
SHARES = [0.8, 0.04, 0.04, 0.04, 0.02, 0.03, 0.02, 0.01]
#: Documents of each kind that the expectations in RULES count for, beside all that are seen.
PRIOR = 20.0
#: Buckets of the tables of character pairs and of words; the tables have this size whatever the corpus.
BUCKETS = 1 << 20
#: A pair or word is common from this share of all pairs or words.
COMMON_PAIR, COMMON_WORD = 1e-6, 2e-6
#: Characters in a window of the repetition measure.
WINDOW = 12
#: Chinese characters and English words that hold sentences together.
FUNCTION_CHARS = "的了是在也与不这其而以为所并之和或可从将但就会它们当则被受即由使到"
FUNCTION_WORDS = "the of and to in is that a an for it as be on not are with by this has had been was were so let us such when no only at all if its can although but or from which into than their these those there we you he she they i do does did will would should could may might must have".split()
#: Signs that end a sentence or a clause, marks before list items, and separators of cells.
ENDS, CLAUSES, MARKS, CELLS = "。！？.!?…", "，、；：,;:", "-*•→□·▪◦‣>+", "|\t"
#: Signs of program text and markup.
CODE = "{}[]()<>=;_/\\|#&$@*+~^`'\""

# classes of code points; Han stands for all letters that are written without blanks between words
_OTHER, _HAN, _LATIN, _DIGIT, _SPACE, _LINE, _END, _CLAUSE, _SYMBOL = range(9)
#: Names in Unicode of scripts that are written without blanks between words.
UNSPACED = ("CJK", "HIRAGANA", "KATAKANA", "BOPOMOFO", "THAI", "LAO", "KHMER", "MYANMAR", "TIBETAN", "YI ")


def _class_of(point: int) -> int:
    c = chr(point)
    if c == "\n":
        return _LINE
    if c in ENDS:
        return _END
    if c in CLAUSES:
        return _CLAUSE
    if c in "“”‘’\"'()（）《》【】「」-":
        return _OTHER
    kind = unicodedata.category(c)
    if c.isspace():
        return _SPACE
    if kind == "Nd":
        return _DIGIT
    if kind[0] in "LM":
        return _HAN if unicodedata.name(c, "").startswith(UNSPACED) else _LATIN
    return _SYMBOL


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower-case form of the code points that fit in two bytes."""
    kinds = np.array([_class_of(p) for p in range(65536)], np.uint8)
    lower = np.arange(65536)
    for p in np.flatnonzero(kinds == _LATIN):
        small = chr(p).lower()
        if len(small) == 1:
            lower[p] = ord(small)
    return kinds, lower


@lru_cache(maxsize=16)
def _among(chars: str) -> np.ndarray:
    """Which code points that fit in two bytes are among some characters."""
    out = np.zeros(65536, bool)
    out[[ord(c) for c in chars]] = True
    return out


@lru_cache(maxsize=64)
def _powers(count: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[1], np.full(count - 1, 1_000_003)]).astype(np.uint64))


def _weights(longest: int) -> np.ndarray:
    """Powers of the base of hashes, at least so many; tables grow by doubling."""
    return _powers(max(64, 1 << int(longest).bit_length()))


def word_hash(word: str) -> int:
    code = np.array([ord(c) for c in word.lower()], np.uint64)
    return int((code * _weights(len(code))[: len(code)]).sum())


_FUNCTION_HASHES = np.array(sorted(word_hash(w) for w in FUNCTION_WORDS), np.uint64)


class Points:
    """A batch of texts as one array of code points; every text is followed by a line end of its own."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts) + "\n"
        raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.raw = raw
        self.code = raw.astype(np.int64)
        kinds, lower = _tables()
        high = np.flatnonzero(raw > 65535)
        # larger code points stand as 0 where tables are looked up
        self.near = near = np.where(raw > 65535, 0, raw).astype(np.uint16)
        self.lower, self.kind = lower[near], kinds[near]
        if len(high):
            points, which = np.unique(raw[high], return_inverse=True)
            self.kind[high] = np.array([_class_of(int(p)) for p in points], np.uint8)[which]
            self.lower[high] = raw[high]
        length = np.array([len(t) + 1 for t in texts])
        self.start = np.concatenate([[0], np.cumsum(length)[:-1]])
        self.size = length - 1
        self.doc = np.repeat(np.arange(len(texts)), length)
        self.count = len(texts)

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask, self.start, dtype=np.int64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Document and bucket of every two characters of a script without blanks that stand together."""
        at = np.flatnonzero((self.kind[:-1] == _HAN) & (self.kind[1:] == _HAN))
        bucket = (self.code[at] * 40_503 + self.code[at + 1] * 65_599) & (BUCKETS - 1)
        return self.doc[at], bucket

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, hash and length of every run of letters of a script with blanks between words."""
        latin = self.kind == _LATIN
        edge = np.diff(latin.astype(np.int8), prepend=0)
        first = np.flatnonzero(edge == 1)
        if not len(first):
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
        at = np.flatnonzero(latin)
        number = np.cumsum(edge[at] == 1) - 1
        place = at - first[number]
        value = self.lower[at].astype(np.uint64) * _weights(int(place.max()) + 1)[place]
        begin = np.flatnonzero(edge[at] == 1)
        return self.doc[first], np.add.reduceat(value, begin), np.bincount(number)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return ((hashes ^ (hashes >> np.uint64(29))) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of one partition: pairs in the lower buckets, words in the upper ones."""
    total = np.zeros(2 * BUCKETS, np.int64)
    for batch in batches:
        texts = [t for t in batch["text"].to_pylist() if t]
        for part in _parts(list(range(len(texts))), texts):
            p = Points([texts[i] for i in part])
            total[:BUCKETS] += np.bincount(p.pairs()[1], minlength=BUCKETS)
            total[BUCKETS:] += np.bincount(_bucket(p.words()[1]), minlength=BUCKETS)
    at = np.flatnonzero(total)
    for a in range(0, len(at), 65_536):
        part = at[a : a + 65_536]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["bucket", "n"])


def common_tables(documents: DataFrame) -> np.ndarray:
    """Which buckets hold common pairs (lower half) and common words, over all documents; two million flags at most."""
    rows = documents.select("text").mapInArrow(_tally, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(2 * BUCKETS, np.int64)
    count[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    pairs, words = count[:BUCKETS], count[BUCKETS:]
    return np.concatenate([pairs >= max(2, COMMON_PAIR * pairs.sum()), words >= max(3, COMMON_WORD * words.sum())])


STATS = ["n_chars", "n_words", "mean_word_length", "symbol_share", "digit_share", "n_lines", "mean_line_length", "line_end_share", "marked_line_share", "cells_per_line", "distinct_line_share", "common_share", "known_share", "ends_per_100", "distinct_window_share", "distinct_windows", "tag_share", "code_share", "code_line_share", "listed_share"]


def statistics(texts: list[str], common: np.ndarray) -> dict[str, np.ndarray]:
    """All statistics of a batch of texts that aren't blank."""
    p = Points(texts)
    kind, doc = p.kind, p.doc
    solid = p.per_doc((kind != _SPACE) & (kind != _LINE))
    some = np.maximum(solid, 1)
    han = p.per_doc(kind == _HAN)
    wd, wh, wl = p.words()
    words = np.bincount(wd, minlength=p.count)
    pd_, pb = p.pairs()
    pairs = np.bincount(pd_, minlength=p.count)
    known = np.bincount(pd_, common[:BUCKETS][pb], p.count) + np.bincount(wd, common[BUCKETS:][_bucket(wh)], p.count)
    function = p.per_doc(_among(FUNCTION_CHARS)[p.near]) + np.bincount(wd, np.isin(wh, _FUNCTION_HASHES), p.count)
    # letters of the scripts whose common words are listed
    written = p.per_doc((kind == _HAN) | (kind == _LATIN))
    listed = p.per_doc(((p.code >= 0x4E00) & (p.code < 0xA000)) | ((p.lower >= 97) & (p.lower <= 122)))
    # lines without blank ones
    breaks = np.flatnonzero(kind == _LINE)
    first = np.concatenate([[0], breaks[:-1] + 1])
    dense = np.concatenate([[0], np.cumsum((kind != _SPACE) & (kind != _LINE))])
    filled = dense[breaks] > dense[first]
    first, last, of = first[filled], breaks[filled], doc[breaks[filled]]
    lines = np.maximum(np.bincount(of, minlength=p.count), 1)
    solid_at = np.flatnonzero((kind != _SPACE) & (kind != _LINE))
    begin, end = solid_at[dense[first]], solid_at[dense[last] - 1]
    closes = _among(ENDS + "”」）)：")[p.near[end]]
    coded = _among(";{}>)")[p.near[end]] & np.isin(p.kind[begin], [_LATIN, _SYMBOL, _OTHER])
    after = p.kind[np.minimum(begin + 1, len(kind) - 1)]
    marked = _among(MARKS)[p.near[begin]] & (after == _SPACE)
    marked |= ((kind[begin] == _DIGIT) | (p.code[begin] == 40)) & _numbered(p, begin)
    cell = _among(CELLS + ",")[p.near] | ((kind == _SPACE) & (np.concatenate([kind[1:], [_LINE]]) == _SPACE))
    cells = np.concatenate([[0], np.cumsum(cell)])
    in_line = cells[end] - cells[begin]
    text_hash = np.concatenate([[0], np.cumsum(p.code * 2_654_435_761 % 1_000_000_007)])
    shape = (text_hash[end + 1] - text_hash[begin]) * 64 + (end - begin) % 64
    distinct = _distinct(of, shape, p.count)
    # windows: all of every text, however long
    roll = np.zeros(max(0, len(kind) - WINDOW + 1), np.uint64)
    for k in range(WINDOW if len(roll) else 0):
        roll += p.code[k : k + len(roll)].astype(np.uint64) * _weights(WINDOW)[k]
    inside = doc[: len(roll)] == doc[WINDOW - 1 : WINDOW - 1 + len(roll)] if len(roll) else np.empty(0, bool)
    pick = np.flatnonzero(inside)
    windows = np.bincount(doc[pick], minlength=p.count)
    unlike = _distinct(doc[pick], roll[pick].astype(np.int64), p.count)
    opens = np.flatnonzero(p.near == 60)
    after = np.minimum(opens + 1, len(kind) - 1)
    tags = np.bincount(doc[opens[(kind[after] == _LATIN) | (p.near[after] == 47)]], minlength=p.count)
    nan = lambda a, b, other: np.where(b > 0, a / np.maximum(b, 1), other)
    return {
        "n_chars": p.size.astype(float),
        "n_words": (words + han).astype(float),
        "mean_word_length": nan(np.bincount(wd, wl, p.count), words, 0.0),
        "symbol_share": p.per_doc(kind == _SYMBOL) / some,
        "digit_share": p.per_doc(kind == _DIGIT) / some,
        "n_lines": lines.astype(float),
        "mean_line_length": solid / lines,
        "line_end_share": np.bincount(of, closes, p.count) / lines,
        "marked_line_share": np.bincount(of, marked, p.count) / lines,
        "cells_per_line": np.bincount(of, in_line, p.count) / lines,
        "distinct_line_share": distinct / lines,
        "common_share": nan(function, words + han, 0.0),
        "known_share": nan(known, pairs + words, 0.0),
        "ends_per_100": 100 * p.per_doc((kind == _END)) / some,
        "distinct_window_share": nan(unlike, windows, 1.0),
        "distinct_windows": unlike,
        "tag_share": 100 * tags / some,
        "code_line_share": np.bincount(of, coded, p.count) / lines,
        "listed_share": nan(listed, written, 1.0),
        "code_share": p.per_doc(_among(CODE)[p.near]) / some,
    }


def _numbered(p: Points, begin: np.ndarray) -> np.ndarray:
    """Whether a line starts with digits and a dot, bracket or comma, or with digits in brackets."""
    out = np.zeros(len(begin), bool)
    at, live = begin.copy(), np.ones(len(begin), bool)
    top = len(p.code) - 1
    at = np.where(p.code[at] == 40, np.minimum(at + 1, top), at)
    for _ in range(6):
        here = p.kind[at]
        stop = live & (here != _DIGIT)
        out |= stop & np.isin(p.code[at], [ord(c) for c in ".)、）"]) & (at > begin)
        live &= here == _DIGIT
        at = np.minimum(at + 1, top)
    return out


def _distinct(group: np.ndarray, value: np.ndarray, count: int) -> np.ndarray:
    """Number of distinct values in each group; values are mixed so that group and value sort as one number."""
    if not len(group):
        return np.zeros(count)
    bits = np.uint64(max(1, int(count - 1).bit_length()))
    mixed = value.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    key = np.sort(((mixed >> bits) << bits) | group.astype(np.uint64))
    new = np.concatenate([[True], key[1:] != key[:-1]])
    return np.bincount((key[new] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), minlength=count).astype(float)


#: Labelling functions: a threshold on statistics, and for each kind how often it should hold, from which learning starts.
RULES: list[tuple[str, Callable, tuple[float, ...]]] = [
    ("few_function_words", lambda s: (s["common_share"] < 0.06) & (s["listed_share"] >= 0.5), (0.02, 0.95, 0.9, 0.5, 0.7, 0.85, 0.25, 0.1)),
    ("unknown_words", lambda s: s["known_share"] < 0.6, (0.02, 0.05, 0.05, 0.05, 0.05, 0.5, 0.02, 0.97)),
    ("repeats_itself", lambda s: (s["distinct_window_share"] < 0.5) & (s["distinct_windows"] < 400), (0.001, 0.03, 0.03, 0.03, 0.05, 0.05, 0.98, 0.01)),
    ("says_one_thing", lambda s: (s["distinct_window_share"] < 0.75) & (s["distinct_windows"] < 120), (0.001, 0.02, 0.02, 0.02, 0.05, 0.05, 0.95, 0.01)),
    ("many_symbols", lambda s: s["symbol_share"] > 0.1, (0.02, 0.2, 0.05, 0.6, 0.9, 0.95, 0.05, 0.05)),
    ("many_digits", lambda s: s["digit_share"] > 0.2, (0.01, 0.2, 0.2, 0.4, 0.4, 0.4, 0.03, 0.05)),
    ("no_sentences", lambda s: s["ends_per_100"] < 0.5, (0.02, 0.4, 0.95, 0.3, 0.5, 0.5, 0.3, 0.5)),
    ("short_lines", lambda s: (s["mean_line_length"] < 16) & (s["n_lines"] >= 3) & ((s["ends_per_100"] < 1) | (s["ends_per_100"] > 6)), (0.02, 0.8, 0.7, 0.1, 0.1, 0.4, 0.05, 0.05)),
    ("marked_lines", lambda s: (s["marked_line_share"] > 0.6) & (s["n_lines"] >= 3), (0.01, 0.95, 0.05, 0.02, 0.02, 0.03, 0.01, 0.01)),
    ("many_cells", lambda s: (s["cells_per_line"] * 12 > s["mean_line_length"]), (0.02, 0.3, 0.2, 0.95, 0.2, 0.2, 0.03, 0.02)),
    ("same_lines", lambda s: (s["distinct_line_share"] < 0.7) & (s["n_lines"] >= 3), (0.01, 0.03, 0.03, 0.03, 0.1, 0.05, 0.1, 0.01)),
    ("tags", lambda s: s["tag_share"] > 1.0, (0.005, 0.01, 0.01, 0.01, 0.95, 0.1, 0.01, 0.01)),
    ("many_ends", lambda s: s["ends_per_100"] > 12, (0.005, 0.2, 0.03, 0.03, 0.03, 0.1, 0.1, 0.02)),
    ("program_text", lambda s: s["code_share"] > 0.15, (0.005, 0.15, 0.05, 0.3, 0.9, 0.9, 0.03, 0.01)),
    ("program_lines", lambda s: s["code_line_share"] > 0.5, (0.003, 0.05, 0.02, 0.05, 0.5, 0.3, 0.05, 0.02)),
    ("lines_end", lambda s: s["line_end_share"] > 0.6, (0.7, 0.3, 0.05, 0.05, 0.05, 0.2, 0.6, 0.2)),
    ("letters_without_words", lambda s: (s["known_share"] < 0.6) & (s["symbol_share"] + s["digit_share"] < 0.1), (0.01, 0.05, 0.02, 0.02, 0.02, 0.05, 0.02, 0.95)),
]


def _describe(common: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch["doc_id"], batch["text"].to_pylist()
            full = [i for i, t in enumerate(texts) if t and t.strip(" \t\n\r\x0b\x0c　\xa0​﻿")]
            out = {name: np.full(len(texts), np.nan) for name in STATS}
            answers = np.full(len(texts), -1, np.int32)
            for part in _parts(full, texts):
                got = statistics([texts[i] for i in part], common)
                for name in STATS:
                    out[name][part] = got[name]
                answers[part] = sum(rule(got).astype(np.int32) << k for k, (_, rule, _) in enumerate(RULES))
            yield pa.RecordBatch.from_arrays([ids, pa.array(answers), *(pa.array(out[n], from_pandas=True) for n in STATS)], ["doc_id", "answers", *STATS])

    return run


def _parts(full: list[int], texts: list[str], most: int = 1 << 20) -> Iterator[list[int]]:
    """Rows in groups of about a million characters; a longer text is a group of its own, and whole."""
    part, size = [], 0
    for i in full:
        if part and size + len(texts[i]) > most:
            yield part
            part, size = [], 0
        part.append(i)
        size += len(texts[i])
    if part:
        yield part


def learn(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the kinds and, for each rule and kind, how often the rule holds, by expectation-maximisation.

    The expectations in RULES are where it starts, and weigh as much as PRIOR documents
    of each kind, however many there are.
    """
    fires = (patterns[:, None] >> np.arange(len(RULES))) & 1
    start = np.array([r[2] for r in RULES])
    share, theta = np.array(SHARES), start.copy()
    for _ in range(rounds):
        post = posterior(fires, share, theta)
        mass = post * counts[:, None]
        new = ((fires.T @ mass) + PRIOR * start) / (mass.sum(0) + PRIOR)
        share = (mass.sum(0) + 1) / (counts.sum() + len(KINDS))
        if np.abs(new - theta).max() < 1e-6:
            break
        theta = new
    return share, theta


def posterior(fires: np.ndarray, share: np.ndarray, theta: np.ndarray) -> np.ndarray:
    log = fires @ np.log(theta) + (1 - fires) @ np.log(1 - theta) + np.log(share)
    log -= log.max(1, keepdims=True)
    p = np.exp(log)
    return p / p.sum(1, keepdims=True)


def describe(documents: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row per row: doc_id, the statistics, text_type, and the posterior of every type.

    ``documents`` has the id column and text; other columns are ignored. Null and
    blank texts have null statistics and the type empty. Repeated rows stay repeated.
    Ties between types go to the first of TYPES. An empty table gives an empty result.
    """
    rows = documents.select(F.col(id_column).alias("doc_id"), "text")
    common = common_tables(rows)
    kind = rows.schema["doc_id"].dataType.simpleString()
    stats = cut(rows.mapInArrow(_describe(common), f"doc_id {kind}, answers int, " + ", ".join(f"{n} double" for n in STATS)))
    seen = stats.where("answers >= 0").groupBy("answers").count().collect()  # no more than 2 to the number of rules
    patterns, counts = np.array([r[0] for r in seen], np.int64), np.array([r[1] for r in seen], float)
    if not len(patterns):
        table = [(-2, "", *[0.0] * len(TYPES))]
    else:
        share, theta = learn(patterns, counts)
        kinds = posterior((patterns[:, None] >> np.arange(len(RULES))) & 1, share, theta)
        post = np.stack([kinds[:, [k == t for k in KINDS]].sum(1) for t in TYPES], axis=1)
        table = [(int(a), TYPES[int(p.argmax())], *map(float, p)) for a, p in zip(patterns, post, strict=True)]
    said = documents.sparkSession.createDataFrame(table, "answers int, text_type string, " + ", ".join(f"p_{t} double" for t in TYPES))
    return stats.join(F.broadcast(said), "answers", "left").select("doc_id", *STATS, F.coalesce("text_type", F.lit("empty")).alias("text_type"), *(f"p_{t}" for t in TYPES))


def agreement(described: DataFrame, labels: DataFrame) -> DataFrame:
    """kind, text_type and judgements: how often raters of a kind meet documents of each learnt type.

    ``labels`` has doc_id, kind and rater. Letter case and blanks at the ends of kinds
    don't count; a rater's equal judgements of a document count once, null kinds not at all.
    """
    kind = F.lower(strip(F.col("kind")))
    once = labels.where("kind is not null").select("doc_id", kind.alias("kind"), "rater").distinct()
    return once.join(described.select("doc_id", "text_type").distinct(), "doc_id").groupBy("kind", "text_type").agg(F.count("*").alias("judgements"))
