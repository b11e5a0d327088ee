"""The best representative of each group of duplicate records.

Records are grouped by the canonical form of their name, in which corpus statistics
repair misread characters; records of one name whose vectors point elsewhere are
another concept. Within a group the values are aligned progressively, every column
votes with the trust in each value, and the existing value closest to this consensus
survives. Groups of any size are cut into blocks whose consensuses are merged.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions.text import width_pairs
from lexforge.llm.groups import hash_to_min
from lexforge.session import cut

#: Records of a group that are aligned in one task; larger groups are cut into such blocks.
BLOCK = 256
#: Vectors of a name that are compared in one task; those of larger names meet two such slots at a time.
VECTORS = 2048
#: A character is a misreading of another if it is at most this share as frequent where the two stand in for each other.
MISREAD_SHARE = 0.1
#: Cosine below which two records of one name are different concepts.
SAME_CONCEPT = 0.4
#: Share of a name's pairs of characters that a definition of it holds beside the name.
ON_TOPIC = 0.34
#: A clause of this length in at least this share of the definitions (and so many) belongs to none of them.
CLAUSE_CHARS, CLAUSE_SHARE, CLAUSE_LEAST = 10, 0.001, 5
#: Signs that end a sentence, and what stands for a character that was lost.
ENDS = "。！？.!?"
LOST = re.compile(r"&#x?;|[□�]|(?<=[^\x00-\x7f])\?|\?(?=[^\x00-\x7f])")
#: Forms of markup around a text.
MARKUP = re.compile(r"</?[a-zA-Z][^<>]*>|&[a-z]+;|```|\{\s*\"|\"\s*\}")
#: Importance from low to high (fixed values of the data model).
LEVELS = ["补充", "重要", "关键"]


_NUMBERING = re.compile(r"^(\([一二三四五六七八九十\d]{1,3}\)|[①-⑳]|\d+(\.\d+)*([、.)]|(?=\s))|[-*•]+\s)\s*")
_BRACKET = re.compile(r"^([^()]+)\(([^()]+)\)\W*$")
_HIDDEN = re.compile("[\u200b-\u200f\u2060\ufeff]")
_WIDTH = str.maketrans(*width_pairs())


def canonical(name: str | None) -> str | None:
    """The letters and digits of a name without numbering, brackets, particles and case; None if nothing is left.

    A bracket that is shorter than what it follows is a remark and goes; a longer one
    is the head of the name that was moved behind its class, and moves back.
    """
    if not name:
        return None
    key = _NUMBERING.sub("", _HIDDEN.sub("", name.translate(_WIDTH).lower()).strip())
    if key.endswith(")") or "(" in key:
        m = _BRACKET.match(key)
        if m:
            outer, inner = m.groups()
            key = inner + outer if len(inner) >= len(outer) else outer
    return "".join(c for c in key if c.isalnum() and c != "的") or None


def name_key(name: Column, repairs: dict[str, str] | None = None) -> Column:
    """canonical() as a column, with misread characters replaced."""
    table = str.maketrans(repairs or {})

    @F.pandas_udf("string")
    def run(names: pd.Series) -> pd.Series:
        keys = [canonical(n) for n in names]
        return pd.Series([k.translate(table) if k and table else k for k in keys], dtype=object)

    return run(name)


def _gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every character of every key with a hash of what stands around it, in time linear in the length of the key."""
    base, powers = np.uint64(0x9E3779B97F4A7C15), np.ones(1, np.uint64)
    for batch in batches:
        rest, chars = [], []
        for key in batch["key"].to_pylist():
            code = np.frombuffer(key.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            while len(powers) < len(code):
                powers = np.concatenate([powers, powers * (powers[-1:] * np.full(1, base))])
            part = (code + np.uint64(1)) * powers[: len(code)]
            around = part.sum() - part
            # the place and the length tell gaps apart that sum up alike
            mixed = (around ^ (around >> np.uint64(31))) * base + np.arange(len(code), dtype=np.uint64) * np.uint64(1_000_003) + np.uint64(len(code))
            rest.append((mixed ^ (mixed >> np.uint64(29))).astype(np.int64))
            chars.extend(key)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rest) if rest else np.empty(0, np.int64)), pa.array(chars, pa.string())], ["rest", "c"])


def misread(keys: DataFrame, share: float = MISREAD_SHARE) -> dict[str, str]:
    """Characters that stand for another one in otherwise equal keys, and are rare beside it.

    ``keys`` has key. The result is no larger than the alphabet. In a gap only pairs of
    a rare and a far more frequent character are made.
    """
    once = cut(keys.where("key is not null and length(key) >= 2").select("key").distinct())
    gaps = cut(once.mapInArrow(_gaps, "rest long, c string").distinct())
    often = cut(once.select(F.explode(F.split("key", "")).alias("c")).groupBy("c").agg(F.count("*").alias("n")))
    filled = gaps.join(F.broadcast(often), "c").groupBy("rest").agg(F.array_sort(F.collect_list(F.struct("n", "c"))).alias("cs")).where("size(cs) > 1")
    # the most frequent one that could be meant is enough to rule a character out
    rare = F.filter("cs", lambda x: x["n"] <= F.element_at("cs", -1)["n"] * share)
    pairs = filled.select("cs", F.explode(rare).alias("a")).select("a", F.explode(F.filter("cs", lambda x: F.col("a.n") <= x["n"] * share)).alias("b"))
    rows = pairs.groupBy(F.col("a.c").alias("a"), F.col("b.c").alias("b")).agg(F.count("*").alias("count"), F.max("b.n").alias("nb"))
    rows = rows.where(F.col("a").rlike(r"^\p{L}$")).groupBy("a").agg(F.max_by("b", F.struct("count", "nb", "b")).alias("b"))
    return {r.a: r.b for r in rows.collect()}


def common_clauses(records: DataFrame) -> list[str]:
    """Clauses that stand in the definitions of so many names that they can't define any of them.

    ``records`` has key and definition. Rows are counted first, and names only for the
    clauses that stand in enough rows; so a name with many copies makes no clause
    common. At most clauses per definition / CLAUSE_SHARE come out.
    """
    rows = records.where("definition is not null")
    least = max(CLAUSE_LEAST, CLAUSE_SHARE * rows.count())
    clauses = F.explode(F.array_distinct(F.split("definition", r"[。！？：\n]"))).alias("clause")
    often = rows.select(clauses).where(F.length("clause") >= CLAUSE_CHARS).groupBy("clause").count().where(F.col("count") >= least).select("clause")
    found = [r.clause for r in often.collect()]
    if not found:
        return []
    sent = F.broadcast(rows.sparkSession.createDataFrame([(c,) for c in found], "clause string"))
    names = rows.select("key", clauses).join(sent, "clause").groupBy("clause").agg(F.countDistinct("key").alias("names"))
    return [r.clause.strip() for r in names.where(F.col("names") >= least / 2).collect()]


@dataclass
class Value:
    """A text, what is left of it without foreign matter, and how far it can be trusted."""

    plain: str
    clean: bool
    trust: float


def judge(text: str | None, foreign: set[str]) -> Value:
    """Strip a definition of foreign matter, and say whether it was whole and clean."""
    if text is None or not text.strip():
        return Value("", False, 0.0)
    body = MARKUP.sub("", text)
    marked = body != text
    lost = bool(LOST.search(body))
    body = LOST.sub("□", body).strip()
    body = re.sub(r"^(definition\"?\s*[:：]\s*\"?|json\s+)+", "", body)
    parts = [p for p in re.split(r"(?<=[。！？：\n])", body) if p]
    kept = [p for p in parts if p.strip("。！？：\n \t　\"") not in foreign]
    wrapped = marked or len(kept) < len(parts)
    seen: set[str] = set()
    once = [p for p in kept if not (p in seen or seen.add(p))]
    repeats = len(once) < len(kept)
    plain = "".join(once).strip()
    filled = bool(re.search(r"([^\w\s])\1{3,}|_{4,}|-{4,}", plain)) or bool(re.search(r"[…·_.]{6,}", plain))
    whole = len(plain) >= CLAUSE_CHARS and plain[-1] in ENDS and not filled
    plain = re.sub(r"([^\w\s])\1{3,}.*$", "", plain)
    clean = whole and not lost and not wrapped and not repeats
    return Value(plain, clean, 4.0 if clean else 1.0 if plain and len(plain) >= CLAUSE_CHARS else 0.0)


@dataclass
class Profile:
    """Columns of an alignment; each holds the weight of its tokens."""

    columns: list[dict[str, float]] = field(default_factory=list)

    def text(self) -> list[str]:
        return [max(c.items(), key=lambda t: (t[1], t[0] != "", t[0]))[0] for c in self.columns]

    def add(self, tokens: str, weight: float) -> None:
        """Align tokens with the consensus so far and let them vote; what lies beyond their ends gets no vote."""
        if not self.columns:
            self.columns = [{t: 0.0 if t == "□" else weight} for t in tokens]
            return
        now = self.text()
        new, last, i = [], -1, 0
        pairs = align(now, tokens)
        ends = [a for a, b in pairs if a is not None and b is not None]
        # a few tokens that match far behind the rest, such as the last full stop, don't stretch the value to there
        for x in range(len(ends) - 1, 0, -1):
            if len(ends) - x >= 10:
                break
            if ends[x] - ends[x - 1] > 2 * (len(ends) - x) + 3:
                ends = ends[:x]
                break
        lo, hi = (ends[0], ends[-1]) if ends else (0, -1)
        for a, b in pairs:
            if a is None:
                if ends and b is not None:
                    new.append({"": self._around(i), tokens[b]: 0.0 if tokens[b] == "□" else weight})
                continue
            column = self.columns[a]
            if b is not None:
                column[tokens[b]] = column.get(tokens[b], 0.0) + (0.0 if tokens[b] == "□" else weight)
            elif lo < a < hi:
                column[""] = column.get("", 0.0) + weight
            new.append(column)
            i, last = a, a
        if ends:
            self.columns = new

    def _around(self, i: int) -> float:
        """The weight that passed by a new column without holding it; nothing beyond the last column."""
        return sum(self.columns[i].values()) if i + 1 < len(self.columns) else 0.0


#: Cells of a table of matches that are held at once; larger gaps are halved first, with the same number of matches.
CELLS = 40_000


def align(a: list[str], b: str) -> list[tuple[int | None, int | None]]:
    """Columns of two token rows: equal ends, then the longest common subsequence of what lies between."""
    out: list[tuple[int | None, int | None]] = []
    i, m, j, n = 0, len(a), 0, len(b)
    fits = lambda x, y: x == y or y == "□" or x == "□"
    while i < m and j < n and fits(a[i], b[j]):
        out.append((i, j))
        i, j = i + 1, j + 1
    tail = []
    while m > i and n > j and fits(a[m - 1], b[n - 1]):
        m, n = m - 1, n - 1
        tail.append((m, n))
    if i < m and j < n:
        names: dict[str, int] = {}
        left = np.array([names.setdefault(t, len(names)) for t in a[i:m]], np.int32)
        right = np.array([names.setdefault(t, len(names)) for t in b[j:n]], np.int32)
        out.extend((None if x is None else i + x, None if y is None else j + y) for x, y in _common(left, right, 0, 0))
    else:
        out.extend((x, None) for x in range(i, m))
        out.extend((None, y) for y in range(j, n))
    out.extend(reversed(tail))
    return out


def _lengths(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each start of the right row, matches of what follows with all of the left row."""
    best = np.zeros(len(right) + 1, np.int32)
    for t in left[::-1]:
        row = best.copy()
        np.maximum(row[:-1], best[1:] + (right == t), out=row[:-1])
        best = np.maximum.accumulate(row[::-1])[::-1]
    return best


def _common(left: np.ndarray, right: np.ndarray, i: int, j: int) -> list[tuple[int | None, int | None]]:
    """Longest common subsequence of two rows; large ones are divided where both halves have the most matches."""
    m, n = len(left), len(right)
    if not m or not n:
        return [(i + x, None) for x in range(m)] + [(None, j + y) for y in range(n)]
    if m == 1:
        at = np.flatnonzero(right == left[0])
        if not len(at):
            return [(i, None), *((None, j + y) for y in range(n))]
        return [*((None, j + y) for y in range(at[0])), (i, j + int(at[0])), *((None, j + y) for y in range(int(at[0]) + 1, n))]
    if m * n <= CELLS:
        return _cells(left, right, i, j)
    half = m // 2
    before, after = _lengths(left[:half][::-1], right[::-1])[::-1], _lengths(left[half:], right)
    cut_at = int((before + after).argmax())
    return _common(left[:half], right[:cut_at], i, j) + _common(left[half:], right[cut_at:], i + half, j + cut_at)


def _cells(left: np.ndarray, right: np.ndarray, i: int, j: int) -> list[tuple[int | None, int | None]]:
    """Longest common subsequence of a small gap, by rows of matches."""
    m, w = len(left), len(right)
    best = np.zeros((m + 1, w + 1), np.int32)
    for x in range(m - 1, -1, -1):
        gain = best[x + 1, 1:] + (right == left[x])
        row = np.maximum(best[x + 1, :-1], gain)
        best[x, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    out, x, y = [], 0, 0
    while x < m and y < w:
        if left[x] == right[y] and best[x, y] == best[x + 1, y + 1] + 1:
            out.append((i + x, j + y))
            x, y = x + 1, y + 1
        elif best[x + 1, y] >= best[x, y + 1]:
            out.append((i + x, None))
            x += 1
        else:
            out.append((None, j + y))
            y += 1
    out.extend((i + k, None) for k in range(x, m))
    out.extend((None, j + k) for k in range(y, w))
    return out


def _related(a: str, b: str) -> bool:
    """Whether the shorter text is, but for lost characters and few others, a part of the longer one."""
    least = min(len(a), len(b))
    if not least:
        return False
    away = next((k for k in range(least) if a[k] != b[k] and a[k] != "□" and b[k] != "□"), least)
    if away >= 0.9 * least:
        return True
    x, y = ({s[k : k + 2] for k in range(len(s) - 1)} for s in (a, b))
    return len(x & y) >= 0.85 * min(len(x), len(y))


def consensus(values: list[tuple[str, float]]) -> str:
    """The voted text of weighted values; unrelated values make texts of their own, of which the heaviest counts."""
    profiles: list[tuple[Profile, str, list[float]]] = []
    count: Counter = Counter()
    for text, weight in values:
        if text and weight > 0:
            count[text] += weight
    for text, weight in sorted(count.items(), key=lambda t: (-len(t[0]) * min(t[1], 4.0), t[0])):
        for profile, head, total in profiles:
            if _related(head, text):
                profile.add(text, weight)
                total[0] += weight * len(text)
                break
        else:
            p = Profile()
            p.add(text, weight)
            profiles.append((p, text, [weight * len(text)]))
    if not profiles:
        return ""
    best = max(profiles, key=lambda t: (t[2][0], t[1]))
    return "".join(best[0].text())


def distance(target: str, plain: str) -> int:
    """Tokens of the consensus that a value lacks, has otherwise, or has beside it."""
    if target == plain:
        return 0
    return sum(a is None or b is None or target[a] != plain[b] for a, b in align(list(target), plain))


def _topical(name: str | None, plain: str) -> float:
    """Share of the pairs of characters of a name that its definition holds beside the name itself."""
    key = re.sub(r"\W", "", name or "").lower()
    pairs = {key[k : k + 2] for k in range(len(key) - 1)}
    rest = re.sub(r"^[^，,：:]{0,40}[：:]", "", re.split(r"[。.]", plain.lower())[0]).replace(key, "")
    return len({p for p in pairs if p in rest}) / len(pairs) if pairs else 1.0


def _concepts(rows: list[dict], vectors: list, plains: list[str]) -> np.ndarray:
    """Number of the concept of each record of one name.

    Vectors decide. A record without a usable one goes where its wording stands, or
    its book, or to the largest concept, unless its definition is about something else.
    """
    label = np.full(len(rows), -1)
    order = sorted(range(len(rows)), key=lambda i: rows[i]["id"])
    known = [i for i in order if vectors[i] is not None]
    if known:
        v = np.stack([vectors[i] for i in known])
        alike = v @ v.T >= SAME_CONCEPT
        for a, i in enumerate(known):
            if label[i] >= 0:
                continue
            concept, todo = int(label.max()) + 1, [a]
            while todo:
                x = todo.pop()
                if label[known[x]] < 0:
                    label[known[x]] = concept
                    todo.extend(np.flatnonzero(alike[x]).tolist())
    said = [len(p) >= CLAUSE_CHARS for p in plains]
    on_topic = [_topical(r["name"], p) >= ON_TOPIC for r, p in zip(rows, plains, strict=True)]
    # long definitions first, so that those that say something find the concepts
    for i in sorted((i for i in order if label[i] < 0), key=lambda i: (-len(plains[i]), rows[i]["id"])):
        placed = [j for j in order if label[j] >= 0]
        close = [j for j in placed if said[i] and said[j] and _related(plains[i], plains[j])]
        near = close or [j for j in placed if rows[i]["textbook_id"] is not None and rows[j]["textbook_id"] == rows[i]["textbook_id"]]
        if not near and said[i]:
            other = {label[j] for j in placed if said[j] and on_topic[j] != on_topic[i]} - {label[j] for j in placed if said[j] and on_topic[j] == on_topic[i]}
            near = [j for j in placed if label[j] not in other]
        elif not near:
            near = placed
        if near:
            votes = Counter(label[j] for j in near)
            label[i] = max(votes, key=lambda c: (votes[c], -c))
        else:
            label[i] = int(label.max()) + 1
    return label


def _unit(vector, dim: int) -> np.ndarray | None:
    if vector is None or not len(vector) or len(vector) != dim:
        return None
    v = np.asarray(vector, np.float64)
    norm = np.linalg.norm(v)
    return v / norm if np.isfinite(norm) and norm > 0 else None


_OUT = "key string, concept int, block int, first_id string, best_id string, n_ids long, n_clean long, text string, weight double, best_text string, name string, importance_level string, textbook_id string, page int"


def _per_block(foreign: set[str], split: bool, dim: int) -> Callable:
    """One block of one name: its concepts, and of each the consensus, the survivor and the best value of every field."""

    def run(keys: tuple, group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        rows = list({r["id"]: r for r in sorted(rows, key=lambda r: (r["id"], r["definition"] or ""))}.values())
        values = [judge(r["definition"], foreign) for r in rows]
        if split:
            label = _concepts(rows, [_unit(r["embedding"], dim) for r in rows], [v.plain for v in values])
        else:
            label = np.array([r["concept"] for r in rows])
        out = []
        for c in sorted(set(label.tolist())):
            own = [i for i in range(len(rows)) if label[i] == c]
            ids = [rows[i]["id"] for i in own]
            if len(own) == 1:
                i = own[0]
                out.append((keys[0].as_py(), c, rows[i].get("block", 0), ids[0], ids[0], 1, int(values[i].clean), values[i].plain, values[i].trust, i))
                continue
            target = consensus([(values[i].plain, values[i].trust) for i in own])
            best = min(own, key=lambda i: (not values[i].clean, distance(target, values[i].plain), -len(values[i].plain), rows[i]["id"]))
            out.append((keys[0].as_py(), c, rows[best].get("block", 0), min(ids), rows[best]["id"], len(ids), sum(values[i].clean for i in own), target, sum(values[i].trust for i in own), best))
        def level(c):
            found = [LEVELS.index(r["importance_level"].strip()) for i, r in enumerate(rows) if label[i] == c and r["importance_level"] and r["importance_level"].strip() in LEVELS]
            return LEVELS[max(found)] if found else None

        def page(c):
            return min((r["page"] for i, r in enumerate(rows) if label[i] == c and r["page"] and r["page"] > 0), default=None)

        def title(c):
            names = Counter(r["name"].strip() for i, r in enumerate(rows) if label[i] == c and r["name"] and r["name"].strip())
            return min(names.items(), key=lambda t: (-t[1], len(t[0]), t[0]))[0] if names else None


        columns = list(zip(*out, strict=True)) if out else [[]] * 10
        best = columns[9]
        data = dict(zip(["key", "concept", "block", "first_id", "best_id", "n_ids", "n_clean", "text", "weight"], columns[:9], strict=True))
        data |= {"best_text": [rows[i]["definition"] for i in best], "name": [title(c) for c in columns[1]], "importance_level": [level(c) for c in columns[1]], "textbook_id": [rows[i]["textbook_id"] for i in best], "page": [page(c) for c in columns[1]]}
        return pa.table(data, schema=_ARROW)

    return run


_ARROW = pa.schema([("key", pa.string()), ("concept", pa.int32()), ("block", pa.int32()), ("first_id", pa.string()), ("best_id", pa.string()), ("n_ids", pa.int64()), ("n_clean", pa.int64()), ("text", pa.string()), ("weight", pa.float64()), ("best_text", pa.string()), ("name", pa.string()), ("importance_level", pa.string()), ("textbook_id", pa.string()), ("page", pa.int32())])


def _repairs_and_sizes(records: DataFrame, block: int) -> tuple[dict[str, str], DataFrame, DataFrame]:
    """Repairs of misread characters, names of nameless records by id, and keys with more rows than a block."""
    first = F.substring_index("definition", "。", 1)
    brief = cut(records.select("id", name_key(F.col("name")).alias("key"), F.when(F.length(first) >= CLAUSE_CHARS, F.xxhash64(first)).alias("first")))
    repairs = misread(brief)
    if repairs:
        brief = brief.withColumn("key", F.translate("key", "".join(repairs), "".join(repairs.values())))
    nameless = brief.where("key is null")
    wanted = nameless.where("first is not null").select("id", "first").distinct()
    told = brief.where("key is not null and first is not null").join(wanted.select("first").distinct(), "first", "left_semi").groupBy("first").agg(F.min("key").alias("told"))
    given = cut(wanted.join(told, "first").groupBy("id").agg(F.min("told").alias("told")))
    sizes = cut(brief.where("key is not null").groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    return repairs, given, sizes


#: Most rows of a table that is sent to every executor.
SENT_ROWS = 50_000


def survivors(records: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per concept: first_id, best_id, n_ids, name, definition, importance_level, textbook_id, page.

    ``records`` has id, name, definition, importance_level, textbook_id, page and
    embedding; other columns are ignored. best_id is the record whose definition is
    closest to the consensus among those that are whole and clean, or among all if
    none is; ties go to the longer text, then to the smaller id. name is the most
    frequent one, importance_level the highest that is valid, page the smallest
    positive one, textbook_id that of best_id. Records without an id are left out,
    repeated rows of an id count once. Records without a name are grouped by their
    first sentence, and alone without one. An empty table gives an empty result.
    """
    records = records.where("id is not null").select("id", "name", "definition", "importance_level", "textbook_id", "page", "embedding")
    repairs, given, sizes = _repairs_and_sizes(records, block)
    foreign = set(common_clauses(records.select(name_key(F.col("name"), repairs).alias("key"), "definition")))
    # vectors of another length than most are no evidence
    dim = records.where("size(embedding) > 0").agg(F.mode(F.size("embedding"), True)).first()[0] or 0
    rows = records.withColumn("key", name_key(F.col("name"), repairs))
    if not given.isEmpty():
        few = given.count() <= SENT_ROWS
        rows = rows.join(F.broadcast(given) if few else given, "id", "left").withColumn("key", F.coalesce("key", "told")).drop("told")
    rows = rows.withColumn("key", F.coalesce("key", F.concat(F.lit("\0"), F.col("id"))))
    usual, hot = rows, None
    if not sizes.isEmpty():
        few = sizes.count() <= SENT_ROWS
        usual = rows.join(F.broadcast(sizes.select("key")) if few else sizes.select("key"), "key", "left_anti")
        hot = rows.join(F.broadcast(sizes) if few else sizes, "key")
    columns = ["key", "id", "name", "definition", "importance_level", "textbook_id", "page", "embedding"]
    done = usual.select(*columns).repartition("key").sortWithinPartitions("key").mapInArrow(_by_runs(foreign, dim), _OUT)
    if hot is not None:
        done = done.unionByName(_large(hot, foreign, block, dim))
    return done.select("first_id", "best_id", "n_ids", "name", F.col("best_text").alias("definition"), "importance_level", "textbook_id", "page")


def _by_runs(foreign: set[str], dim: int) -> Callable:
    """Rows sorted by key: runs of one row pass as they are, the others are groups."""
    one = _per_block(foreign, True, dim)

    def group(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = rows["key"].combine_chunks()
        codes = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)]])
        size = np.diff(starts)
        alone = rows.take(pa.array(starts[:-1][size == 1]))
        if alone.num_rows:
            yield from _alone(alone).to_batches()
        parts = []
        for a, n in zip(starts[:-1][size > 1].tolist(), size[size > 1].tolist(), strict=True):
            parts.append(one((keys[a],), rows.slice(a, n)))
        if parts:
            yield from pa.concat_tables(parts).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]) if rest is not None else rows
            keys = rows["key"].combine_chunks()
            # the last run may go on in the next batch; a run is no longer than a block
            same = pc.index(keys, keys[len(keys) - 1]).as_py()
            rest = rows.slice(same)
            if same:
                yield from group(rows.slice(0, same))
        if rest is not None:
            yield from group(rest)

    return run


def _alone(rows: pa.Table) -> pa.Table:
    """Concepts with one record."""
    n, level = rows.num_rows, pc.utf8_trim_whitespace(rows["importance_level"])
    name = pc.utf8_trim_whitespace(rows["name"])
    none = pa.array([""] * n)
    return pa.table(
        {
            "key": rows["key"], "concept": pa.array(np.zeros(n, np.int32)), "block": pa.array(np.zeros(n, np.int32)), "first_id": rows["id"], "best_id": rows["id"], "n_ids": pa.array(np.ones(n, np.int64)), "n_clean": pa.array(np.zeros(n, np.int64)), "text": none, "weight": pa.array(np.zeros(n)),
            "best_text": rows["definition"], "name": pc.if_else(pc.equal(name, ""), None, name), "importance_level": pc.if_else(pc.is_in(level, pa.array(LEVELS)), level, None), "textbook_id": rows["textbook_id"], "page": pc.if_else(pc.greater(rows["page"], 0), rows["page"], None),
        },
        schema=_ARROW,
    )


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1)


def _components(rows: DataFrame, block: int) -> DataFrame:
    """Rows with their concept: a connected component of cosines of at least SAME_CONCEPT within a name, numbered by smallest id.

    A name is cut into slots. Each finds the components of its own rows, every two of
    them the links between theirs, and components that are linked are one.
    """
    slotted = cut(rows.withColumn("slots", F.ceil(F.col("blocks") * block / F.lit(VECTORS)).cast("int")).withColumn("slot", F.pmod(F.xxhash64("id"), F.col("slots")).cast("int")))

    def within(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        v = _matrix(group["v"])
        label = np.full(len(v), -1)
        for first in range(len(v)):
            if label[first] >= 0:
                continue
            label[first], todo = first, np.array([first])
            while len(todo):
                left = np.flatnonzero(label < 0)
                todo, more = todo[256:], left[(v[left] @ v[todo[:256]].T >= SAME_CONCEPT).any(1)]
                label[more] = first
                todo = np.concatenate([todo, more])
        return pa.table({"key": group["key"], "id": group["id"], "slot": group["slot"], "slots": group["slots"], "part": group["id"].take(pa.array(label)), "v": group["v"]})

    def between(group: pa.Table) -> pa.Table:
        mine = np.asarray(group["slot"]) == np.asarray(group["x"])
        one, two = group.filter(pa.array(mine)), group.filter(pa.array(~mine))
        v, w = _matrix(one["v"]), _matrix(two["v"])
        part = [t["part"].combine_chunks().dictionary_encode() for t in (one, two)]
        a, b = (p.indices.to_numpy() for p in part)
        links, most = [np.empty(0, np.int64)], len(part[1].dictionary)
        for k in range(0, len(v), 512):
            i, j = np.nonzero(v[k : k + 512] @ w.T >= SAME_CONCEPT)
            links.append(np.unique(a[k + i].astype(np.int64) * most + b[j]))
        ends = np.stack(np.divmod(np.unique(np.concatenate(links)), most), axis=1)
        key = group["key"][0].as_py()
        return pa.table({"key": pa.array([key] * len(ends), pa.string()), "a": part[0].dictionary.take(pa.array(ends[:, 0])), "b": part[1].dictionary.take(pa.array(ends[:, 1]))})

    local = cut(slotted.groupBy("key", "id", "slot", "slots").agg(F.min("v").alias("v")).groupBy("key", "slot").applyInArrow(within, "key string, id string, slot int, slots int, part string, v array<double>"))
    pairs = local.where("slots > 1").withColumn("y", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).where("y <> slot").withColumn("x", F.least("slot", "y")).withColumn("z", F.greatest("slot", "y"))
    links = pairs.groupBy("key", "x", "z").applyInArrow(_both(between), "key string, a string, b string").distinct()
    name = lambda c: F.concat_ws("\0", "key", c)
    joined = hash_to_min(links.select(name("a").alias("a"), name("b").alias("b"))).select(F.col("node_id").alias("named"), F.substring_index("group_id", "\0", -1).alias("first"))
    parts = local.select("key", "part").distinct().withColumn("named", name("part")).join(joined, "named", "left").select("key", "part", F.coalesce("first", "part").alias("first"))
    number = parts.select("key", "first").distinct().withColumn("concept", F.row_number().over(_by(["key"]).orderBy("first")) - 1)
    concept = local.select("key", "id", "part").distinct().join(parts, ["key", "part"]).join(number, ["key", "first"]).groupBy("key", "id").agg(F.min("concept").alias("concept"))
    return slotted.drop("slot", "slots").join(concept, ["key", "id"])


def _both(run: Callable) -> Callable:
    """Run on groups that hold rows of both slots; an empty table from others."""
    none = pa.table({c: pa.array([], pa.string()) for c in ("key", "a", "b")})

    def checked(group: pa.Table) -> pa.Table:
        return run(group) if pc.count_distinct(group["slot"]).as_py() == 2 else none

    return checked


def _placed(rest: DataFrame, known: DataFrame, foreign: set[str]) -> DataFrame:
    """Rows without a usable vector with their concept, by the rules of smaller names.

    A row goes where its wording stands (in the longest clean definition of the concept),
    or else with most rows of its book, or else to the largest concept that its
    definition may belong to by its topic. A row that none of these places is a concept
    by its wording; without any vector in the name the first concept takes all.
    """

    @F.pandas_udf("struct<plain: string, trust: double, said: boolean, on_topic: boolean>")
    def read(definition: pd.Series, name: pd.Series) -> pd.DataFrame:
        values = [judge(d, foreign) for d in definition]
        return pd.DataFrame({"plain": [v.plain for v in values], "trust": [v.trust for v in values], "said": [len(v.plain) >= CLAUSE_CHARS for v in values], "on_topic": [_topical(n, v.plain) >= ON_TOPIC for n, v in zip(name, values, strict=True)]})

    @F.pandas_udf("boolean")
    def related(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_related(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    asked, told = cut(rest.withColumn("r", read("definition", "name"))), known.withColumn("r", read("definition", "name"))
    heads = cut(told.groupBy("key", "concept").agg(F.max_by("r.plain", F.struct("r.trust", F.length("r.plain"), "r.plain")).alias("rep"), F.countDistinct("id").alias("n"), F.bool_or(F.col("r.said") & F.col("r.on_topic")).alias("on"), F.bool_or(F.col("r.said") & ~F.col("r.on_topic")).alias("off")))
    most = lambda c: F.max_by("concept", F.struct(c, -F.col("concept")))
    # each wording once, against one text a concept
    texts = asked.where("r.said").select("key", F.col("r.plain").alias("plain")).distinct()
    wording = texts.join(heads.where("rep <> ''"), "key").where(related("plain", "rep")).groupBy("key", "plain").agg(most("n").alias("by_wording"))
    book = known.where("textbook_id is not null").groupBy("key", "textbook_id", "concept").agg(F.countDistinct("id").alias("n")).groupBy("key", "textbook_id").agg(most("n").alias("by_book"))
    fits = lambda mine, other: F.max_by(F.when(F.col(mine) | ~F.col(other), F.col("concept")), F.when(F.col(mine) | ~F.col(other), F.struct("n", -F.col("concept"))))
    topic = heads.groupBy("key").agg(fits("on", "off").alias("if_on"), fits("off", "on").alias("if_off"), most("n").alias("largest"))
    rows = asked.withColumn("plain", F.when(F.col("r.said"), F.col("r.plain"))).join(wording, ["key", "plain"], "left").join(book, ["key", "textbook_id"], "left").join(topic, "key", "left")
    by_topic = F.when(~F.col("r.said"), F.col("largest")).when(F.col("r.on_topic"), F.col("if_on")).otherwise(F.col("if_off"))
    alone = F.when(F.col("largest").isNull(), F.lit(0)).otherwise(-1 - F.abs(F.hash("r.plain") % F.lit(1 << 30)))
    return rows.withColumn("concept", F.coalesce("by_wording", "by_book", by_topic, alone).cast("int")).drop("r", "plain", "by_wording", "by_book", "if_on", "if_off", "largest")


def _large(rows: DataFrame, foreign: set[str], block: int, dim: int) -> DataFrame:
    """Groups larger than a block: concepts by components, consensus by blocks, and the survivor by distance."""
    rows = cut(rows)
    good = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    size = F.sqrt(good)
    rows = rows.withColumn("v", F.when((F.size("embedding") == dim) & (size > 0) & (size < float("inf")), F.transform("embedding", lambda x: x / size)))
    known = _components(rows.where("v is not null"), block)
    rest = _placed(rows.where("v is null"), known, foreign)
    rows = known.unionByName(rest)
    rows = cut(rows.drop("v").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    parts = cut(rows.groupBy("key", "block").applyInArrow(_per_block(foreign, False, dim), _OUT))
    heads = ["key", "concept"]
    texts = parts.select(*heads, "text", "weight", F.xxhash64("block").alias("place"))
    while True:
        groups = texts.groupBy(*heads).count().agg(F.max("count")).first()[0]
        if not groups or groups == 1:
            break
        merged = texts.withColumn("b", F.pmod(F.col("place"), F.ceil(F.count("*").over(_by(heads)) / block)).cast("int"))

        def merge(keys: tuple, group: pd.DataFrame) -> pd.DataFrame:
            text = consensus(list(zip(group["text"], group["weight"], strict=True)))
            return pd.DataFrame({"key": [keys[0]], "concept": [keys[1]], "text": [text], "weight": [float(group["weight"].sum())], "place": [int(keys[2]) * 7919]})

        texts = cut(merged.groupBy(*heads, "b").applyInPandas(merge, "key string, concept int, text string, weight double, place long"))

    @F.pandas_udf("struct<dirty: boolean, away: long, size: long>")
    def score(definition: pd.Series, target: pd.Series) -> pd.DataFrame:
        seen: dict = {}
        out = []
        for d, t in zip(definition, target, strict=True):
            if (d, t) not in seen:
                v = judge(d, foreign)
                seen[d, t] = (not v.clean, distance(t or "", v.plain), -len(v.plain))
            out.append(seen[d, t])
        return pd.DataFrame(out, columns=["dirty", "away", "size"])

    scored = rows.join(texts.select(*heads, F.col("text").alias("target")), heads).withColumn("s", score("definition", "target"))
    best = scored.groupBy(*heads).agg(F.min_by(F.struct("id", "definition", "textbook_id"), F.struct("s.dirty", "s.away", "s.size", "id")).alias("b"), F.countDistinct("id").alias("n_ids"))
    fields = parts.groupBy(*heads).agg(
        F.min("first_id").alias("first_id"),
        F.sum("n_clean").alias("n_clean"),
        F.max_by("name", F.struct("n_ids", "name")).alias("name"),
        F.max_by("importance_level", F.array_position(F.array(*map(F.lit, LEVELS)), F.col("importance_level"))).alias("importance_level"),
        F.min("page").alias("page"),
    )
    return best.join(fields, heads).select(
        "key", "concept", F.lit(0).alias("block"), "first_id", F.col("b.id").alias("best_id"), "n_ids", "n_clean", F.lit("").alias("text"), F.lit(0.0).alias("weight"), F.col("b.definition").alias("best_text"), "name", "importance_level", F.col("b.textbook_id").alias("textbook_id"), "page"
    )


def _by(heads: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*heads)
