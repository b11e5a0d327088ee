"""Repair of text from scanned pages.

Page numbers are sequences that rise over the pages of a chapter in one style. Running
heads and notices are lines at page edges that repeat within the book, misread letters
allowed; the titles of the book and the chapter count as one sighting each. Words are
counted over the whole corpus, away from line ends; the counts tell words that were cut
from compounds that were parted. What scanners take for what is learnt: letters from
rare words beside frequent ones, Chinese characters from what else stands between the
same neighbours. Text can be described line by line, or restored to paragraphs.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions.text import width_pairs
from lexforge.session import cut, keep

#: A word counts from so many times, whatever the corpus.
WORD_LEAST = 3
#: Buckets of the table of character pairs, and flags that tell which words are frequent; of this size whatever the corpus.
BUCKETS, FLAGS = 1 << 20, 1 << 24
#: How many times more frequent the right reading must be.
WORD_ODDS, PAIR_ODDS = 8, 10
#: Different right words, or surroundings, that must speak for a confusion before it is believed.
SUPPORT = 3
#: Share of its occurrences in which a character must be a misreading to be one that scanners make.
MISREAD_SHARE = 0.25
#: For characters that are mostly right: places that must speak, the share of odd occurrences that they explain, and how uneven errors may lie.
PLACES, EXPLAINED, UNEVEN = 10, 0.8, 4.0
#: Share of what stands between two characters from which one of the things is usual there.
USUAL_SHARE = 0.05
#: Letters from which on a row of letters is no word, and stands as it is.
LONGEST_WORD = 256
#: Most rows of a table of books that are sent to every executor.
SENT_ROWS = 20_000
#: The same for pieces of the names of books and of running lines.
SENT_PIECES = 200_000
#: Repetitions that a running line has at least, the share of them at edges, and how near an edge is.
REPEATS_LEAST, EDGE_SHARE, NEAR = 3, 0.8, 2
#: Odds (their logarithm) against a line of the text lying at edges so often by chance.
EVIDENCE = 11.5
#: Share of all books from which on a running line is one of all books.
EVERYWHERE = 0.01
#: Pieces of a line by which lines that may be alike are found.
PIECES = 5
#: How far Roman page numbers may run ahead of the pages.
ROMAN_AHEAD = 2
#: Lines that a page has at least where page numbers are unknown.
PAGE_LINES = 5
#: Signs at a cut word's end.
CUTS = "-‐‑–­¬"

_WIDTH = str.maketrans(*width_pairs())
_LETTERS = re.compile(r"[^\W\d_]+")
_ROMAN = re.compile(r"^(?=[ivxlc])(c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$")
_PAGE = re.compile(r"^(?P<a>[-—–·•\[|~.*]*)(?P<w>第|page|pg\.?|p\.)?(?P<n>[0-9lioszb!|]{1,5})(?P<u>页)?(?P<of>/[0-9lio!|]{1,5})?(?P<z>[-—–·•\]|~.*]*)$")
#: Letters that stand for digits in page numbers.
_DIGITS = str.maketrans("lio!|szb", "11011526")
#: Letters of a page number in any style, at most.
_PAGE_LETTERS = 14
_SIGNS = "-—–·•[]|~.*"
_SMALL = re.compile("[a-z]+")
#: A number before or behind a line.
_BESIDE = re.compile(r"^(\d{1,5})\s|\s(\d{1,5})$")


_WIDE = re.compile("[\uff00-\uffef]")


def letters(text: str) -> str:
    """The letters of a line in lower case and usual width."""
    key = "".join(_LETTERS.findall(text))
    if not key.isascii() and _WIDE.search(key):
        key = "".join(_LETTERS.findall(key.translate(_WIDTH)))
    return key.lower()


def _roman(s: str) -> int | None:
    if not s or not _ROMAN.match(s):
        return None
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    n = [value[c] for c in s]
    return sum(-a if a < b else a for a, b in zip(n, [*n[1:], 0], strict=True))


def page_number(line: str, first: int | None, last: int | None) -> tuple[int, str] | None:
    """The page that a line names if it names nothing else, and the style in which; None outside the known pages."""
    s = re.sub(r"\s+", "", line.translate(_WIDTH).lower())
    lo, hi = first if first is not None else 0, last if last is not None else 10**6
    m = _PAGE.match(s)
    if m and (any(c.isdigit() for c in m["n"]) or s != m["n"] or (len(s) > 1 and set(s) <= set("lio"))):
        n = int(m["n"].translate(_DIGITS))
        if lo <= n <= hi:
            return n, f"{m['a']}{m['w'] or ''}1{m['u'] or ''}{'/' if m['of'] else ''}{m['z']}"
    bare = s.strip(_SIGNS)
    n = _roman(bare)
    # front matter may be counted from the cover
    if n is not None and lo <= n <= hi + ROMAN_AHEAD:
        return n, s.replace(bare, "i")
    return None


@dataclass(frozen=True)
class Number:
    """A line that may be a page number: its place among the filled lines, the page and the style."""

    place: int
    page: int
    style: str

    @property
    def bare(self) -> bool:
        return self.style in ("1", "i")


def rising(numbers: list[Number]) -> list[Number]:
    """The longest sequence of rising pages."""
    ends: list[int] = []
    last: list[Number] = []
    before: dict[Number, Number | None] = {}
    for x in sorted(numbers, key=lambda x: (x.place, -x.page)):
        at = bisect_left(ends, x.page)
        before[x] = last[at - 1] if at else None
        ends[at:at + 1], last[at:at + 1] = [x.page], [x]
    out, now = [], last[-1] if last else None
    while now is not None:
        out.append(now)
        now = before[now]
    return out[::-1]


def sequence(numbers: list[Number], filled: int, known: bool, styles: frozenset[str] = frozenset()) -> list[Number]:
    """The page numbers of a chapter: the longest rising sequence of one style, and what fits in from the book's styles.

    A number that stands alone counts in a style of the book, in one that only page
    numbers have, or as the chapter's first or last line. Where the pages are unknown,
    two numbers at least must lie a page apart.
    """
    by: dict[str, list[Number]] = {}
    for x in numbers:
        by.setdefault(x.style, []).append(x)
    chains = sorted((rising(xs) for xs in by.values()), key=lambda c: (-len(c), c[0].bare, c[0].style not in styles, c[0].place))
    if not chains:
        return []
    main = chains[0]
    if not known:
        gaps = sorted(b.place - a.place for a, b in zip(main, main[1:], strict=False))
        steps = sorted(b.page - a.page for a, b in zip(main, main[1:], strict=False))
        return main if gaps and gaps[len(gaps) // 2] >= PAGE_LINES and steps[len(steps) // 2] <= 2 else []
    trusted = lambda x: x.style in styles or not x.bare
    if len(main) == 1 and not trusted(main[0]) and main[0].place not in (0, filled - 1):
        return []
    out = {x.page: x for x in main}
    for x in sorted((x for c in chains[1:] for x in c if trusted(x)), key=lambda x: x.place):
        if x.page not in out and all((y.place < x.place) == (y.page < x.page) for y in out.values()):
            out[x.page] = x
    return sorted(out.values(), key=lambda x: x.place)


def alike(a: str, b: str, share: float = 0.8) -> bool:
    """Whether two keys differ in few characters."""
    if a == b:
        return bool(a)
    longest = max(len(a), len(b))
    most = int((1 - share) * longest + 1e-9)
    if min(len(a), len(b)) < 3 or abs(len(a) - len(b)) > most:
        return False
    x, y = Counter(a), Counter(b)
    if sum((x & y).values()) < longest - most:
        return False
    # only cells near the diagonal can stay below the bound
    far, n = most + 1, len(b)
    row = [j if j <= most else far for j in range(n + 1)]
    for i, c in enumerate(a, 1):
        lo, hi = max(1, i - most), min(n, i + most)
        new = [far] * (n + 1)
        new[0] = i if i <= most else far
        for j in range(lo, hi + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != b[j - 1]), far)
        if min(new[lo - 1 : hi + 1]) >= far:
            return False
        row = new
    return row[n] <= most


@dataclass
class Chapter:
    book: str
    ord: int
    lines: list[str]
    filled: list[int]
    title: str
    books: list[str]
    first: int | None
    last: int | None

    @property
    def heads(self) -> list[str]:
        """Keys that running heads of this chapter may have by its title and the book's names."""
        both = [x for b in self.books for x in (b + self.title, self.title + b)] if self.title else []
        return [*self.books, *both, *([self.title] if self.title else [])]


def _stem(filename: str | None) -> str:
    return re.sub(r"^\d{1,3}[_\-]", "", re.sub(r"\.[^.]*$", "", filename or ""))


def chapter_of(row: dict) -> Chapter:
    lines = (row["content"] or "").split("\n")
    filled = [i for i, ln in enumerate(lines) if ln.strip()]
    opening = lines[filled[0]].strip() if filled else ""
    title = letters(row["title"] or "") or (letters(opening) if len(opening) < 80 and opening[-1:] not in "。.!?！？" else "")
    books = sorted({letters(row["book_title"] or ""), letters(_stem(row["filename"]))} - {""})
    return Chapter(row["textbook_id"], row["ord"], lines, filled, title, books, row["page_start"], row["page_end"])


def _pieces(key: str) -> list[str]:
    """Few short pieces of a key, the same ones in keys that differ little."""
    size = 2 if any(c >= "⺀" for c in key) else 3
    grams = {key[i : i + size] for i in range(max(1, len(key) - size + 1))}
    return sorted(grams, key=lambda g: zlib.crc32(g.encode("utf-8", "replace")))[:PIECES]


def _may_be(a: str, b: str) -> bool:
    """Cheap test that keys which are alike pass but for rare cases of changes in all three places."""
    longest = max(len(a), len(b))
    return abs(len(a) - len(b)) <= 0.2 * longest + 1e-9 and (a[:3] == b[:3] or a[-3:] == b[-3:] or b[len(b) // 2 - 1 : len(b) // 2 + 2] in a or b[1:4] in a or b[-4:-1] in a)


@dataclass
class Edges:
    """What a chapter's lines say by themselves.

    numbers: lines that may be page numbers. titles: lines like the chapter's title.
    named: lines like a name of the book. near: keys of the other lines at page edges,
    by place; those that only help to compare don't count. beside: of these, lines that
    touch a line that runs, or end the chapter. keys: the key of every line.
    """

    numbers: list[Number]
    titles: set[int]
    near: dict[int, list[tuple[str, bool]]]
    beside: set[int]
    keys: list[str]


def edges_of(c: Chapter) -> Edges:
    keys = [letters(c.lines[i]) for i in c.filled]
    numbers = []
    for k, i in enumerate(c.filled):
        if len(keys[k]) <= _PAGE_LETTERS:
            page = page_number(c.lines[i].strip(), c.first, c.last)
            if page:
                numbers.append(Number(k, *page))
    told = {x.place for x in numbers}
    top = len(keys) - 1
    titles, running, anchors = set(), set(told), set(told) | {0, top}
    heads = [h for h in c.heads if h]
    # which lengths may be like which head
    fits: dict[int, list[str]] = {}
    for h in heads:
        for n in range(int(0.8 * len(h)), int(1.25 * len(h)) + 2):
            fits.setdefault(n, []).append(h)
    latin = {h: bool(_SMALL.search(h)) for h in heads}
    for k, key in enumerate(keys):
        if k in told or not key:
            continue
        like = {h for h in fits.get(len(key), ()) if _may_be(key, h) and alike(key, h)}
        if not like and not key.isascii() and _SMALL.search(key):
            # letters in a Chinese line may be digits
            plain = _SMALL.sub("", key)
            like = {h for h in fits.get(len(plain), ()) if not latin[h] and _may_be(plain, h) and alike(plain, h)}
        if like:
            anchors.add(k)
            running.add(k)
            if c.title in like:
                titles.add(k)
        elif c.first is not None and c.last is not None:
            line = c.lines[c.filled[k]].strip()
            if (line[0].isdecimal() or line[-1].isdecimal()) and (m := _BESIDE.search(line)) and c.first <= int(m[1] or m[2]) <= c.last:
                anchors.add(k)
    near: dict[int, list[tuple[str, bool]]] = {}
    beside: set[int] = set()
    places = np.array(sorted(anchors))
    for k, key in enumerate(keys):
        if k in told or len(key) < 4:
            continue
        at = np.searchsorted(places, k)
        if k in titles or min(abs(int(p) - k) for p in places[max(0, at - 1) : at + 1]) > NEAR:
            continue
        if k in (0, top) or k - 1 in running or k + 1 in running or k in running:
            beside.add(k)
        forms = [(key, True)]
        if c.title and len(key) > len(c.title) + 3:
            for part, rest in ((key[-len(c.title) :], key[: -len(c.title)]), (key[: len(c.title)], key[len(c.title) :])):
                if _may_be(part, c.title) and alike(part, c.title):
                    forms.append((rest, True))
                    break
        # letters in a Chinese line may be digits
        plain = [_SMALL.sub("", f) for f, _ in forms] if not key.isascii() else []
        forms += [(p, False) for p, (f, _) in zip(plain, forms, strict=False) if p != f and len(p) >= 4]
        near[k] = forms
    return Edges(numbers, titles, near, beside, keys)


def furniture(c: Chapter, told: Told) -> list[bool]:
    """For each line whether it is a page number, running head or notice."""
    gone = {x.place for x in sequence(told.numbers, len(c.filled), c.first is not None and c.last is not None, told.styles)}
    out, started = [False] * len(c.lines), False
    for k, i in enumerate(c.filled):
        if k in gone or i in told.running:
            out[i] = True
        elif k in told.titles:
            # the chapter's own heading at its start stays, unless it has a page number
            out[i] = started or _ends_in_page(c.lines[i].strip(), c)
            started = True
        else:
            started = True
    return out


def _ends_in_page(line: str, c: Chapter) -> bool:
    m = re.search(r"(\d+)\s*$", line.translate(_WIDTH))
    return bool(m) and bool(c.first) and c.last is not None and c.first <= int(m[1]) <= c.last and bool(re.search(r"[^\d\W]\W*\s\W*\d+\s*$", line))


def _pair_bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * 40_503 + b * 65_599) & (BUCKETS - 1)


def _is_han(code: np.ndarray) -> np.ndarray:
    return (code >= 0x4E00) & (code < 0xA000)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


_TOKEN = re.compile(r"[^\s　-鿿＀-￯“”‘’]+")
_ENDS = "\"'.,;:?)[]{}—…"
_LETTER = re.compile(r"[^\W\d_]")


def words_of(line: str) -> list[tuple[int, str]]:
    """Places and lower-case forms of the words of a line that hold a letter that isn't Chinese."""
    out = []
    for m in _TOKEN.finditer(line):
        raw = m.group()
        left = len(raw) - len(raw.lstrip(_ENDS))
        word = raw.strip(_ENDS)
        if word.endswith("!") and len(word) > 1:
            word = word[:-1]
        if _LETTER.search(word):
            out.append((m.start() + left, word.lower()))
    return out


#: Letters and signs of a word before a cut, and of what goes on after it.
_BEFORE = re.compile(rf"([0-9A-Za-zÀ-ԯ(!|'~^$@+.-]*[0-9A-Za-zÀ-ԯ!|])[{CUTS}]$")
_AFTER = re.compile(r"[0-9A-Za-zÀ-ԯ(!|'~^$@+-]+")


def parts_at(line: str, follows: str) -> tuple[str, str] | None:
    """The two parts of a word that may be cut between two lines, in lower case."""
    m = _BEFORE.search(line)
    if not m or not follows[:1].isalpha():
        return None
    n = _AFTER.match(follows)
    return (m[1].lower(), n.group().rstrip("-!(").lower()) if n else None


_FIRST = pa.schema(
    [
        ("row_key", pa.int64()), ("textbook_id", pa.string()),
        ("numbers", pa.list_(pa.struct([("place", pa.int32()), ("page", pa.int32()), ("style", pa.string())]))), ("titles", pa.list_(pa.int32())),
        ("near", pa.list_(pa.struct([("line", pa.int32()), ("key", pa.string()), ("counts", pa.bool_()), ("beside", pa.bool_())]))),
        ("styles", pa.list_(pa.string())), ("body", pa.list_(pa.int64())), ("words", pa.list_(pa.string())),
        ("parts", pa.list_(pa.struct([("a", pa.string()), ("b", pa.string())]))),
        ("word", pa.string()), ("gram", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()),
    ]
)
_FIRST_DDL = "row_key long, textbook_id string, numbers array<struct<place: int, page: int, style: string>>, titles array<int>, near array<struct<line: int, key: string, counts: boolean, beside: boolean>>, styles array<string>, body array<long>, words array<string>, parts array<struct<a: string, b: string>>, word string, gram long, bucket long, n long"


def _hashes(keys: list[str]) -> list[int]:
    return pd.util.hash_array(np.array(keys, object), categorize=False).astype(np.int64).tolist() if keys else []


def _about(row: dict, found: list[list[str]]) -> dict:
    """What the first pass keeps of a scanned chapter; ``found`` has the words of every line."""
    c = chapter_of(row)
    e = edges_of(c)
    loose = {x.place for x in e.numbers} | e.titles | e.near.keys()
    chain = max((rising([x for x in e.numbers if x.style == style]) for style in {x.style for x in e.numbers}), key=len, default=[])
    words, parts = set(), set()
    for k, i in enumerate(c.filled):
        line = c.lines[i].strip()
        words.update(found[i])
        if line[-1] in CUTS:
            # what goes on may stand behind running lines
            for at in range(k + 1, len(c.filled)):
                pair = parts_at(line, c.lines[c.filled[at]].strip())
                if pair:
                    parts.add(pair)
                if at not in loose:
                    break
    for a, b in parts:
        words.update((a + b, f"{a}-{b}"))
    body = {key for k, key in enumerate(e.keys) if len(key) >= 4 and k not in e.near and k not in e.titles}
    return {
        "row_key": row["row_key"], "textbook_id": c.book, "numbers": [{"place": x.place, "page": x.page, "style": x.style} for x in e.numbers], "titles": sorted(e.titles), "near": [{"line": c.filled[k], "key": key, "counts": n, "beside": k in e.beside} for k, forms in e.near.items() for key, n in forms],
        "styles": [x.style for x in chain], "body": _hashes(sorted(body)), "words": sorted(words), "parts": [{"a": a, "b": b} for a, b in sorted(parts)],
    }


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for every scanned chapter, then one partition's counts of words, character pairs and threes, from all chapters."""
    words: Counter = Counter()
    pairs, grams = np.zeros(BUCKETS, np.int64), {}
    for batch in batches:
        out, texts = [], []
        for row in batch.to_pylist():
            text = row["content"] or ""
            texts.append(text)
            found = [[w for _, w in words_of(ln)] for ln in text.split("\n")]
            for line in found:
                words.update(line[1:-1])
            if row["scanned"]:
                out.append(_about(row, found))
        code = _codes("\n".join(texts))
        if len(code) > 2:
            han = _is_han(code)
            both = han[:-1] & han[1:]
            pairs += np.bincount(_pair_bucket(code[:-1][both], code[1:][both]), minlength=BUCKETS)
            # a neighbour that is no Chinese character is 0
            own, at = np.where(han, code, 0), np.flatnonzero(han[1:-1] & (han[:-2] | han[2:]))
            for g, n in zip(*(x.tolist() for x in np.unique((own[at] << 32) | (own[at + 1] << 16) | own[at + 2], return_counts=True)), strict=True):
                grams[g] = grams.get(g, 0) + n
        if out:
            yield from pa.Table.from_pylist(out, schema=_FIRST).combine_chunks().to_batches()
    at = np.flatnonzero(pairs)
    yield from _counts("bucket", at.tolist(), pairs[at].tolist())
    yield from _counts("gram", list(grams), list(grams.values()))
    yield from _counts("word", list(words), list(words.values()))


def _counts(name: str, values: list, counts: list[int]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(values), 65_536):
        n = len(values[a : a + 65_536])
        made = {name: values[a : a + n], "n": counts[a : a + n]}
        yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if f.name in made else pa.nulls(n, f.type) for f in _FIRST], schema=_FIRST)


@dataclass
class Corpus:
    """What all chapters tell about characters; of bounded size.

    pairs: counts of character pairs by bucket. looks: characters that scanners make of
    others, and those others.
    """

    pairs: np.ndarray
    looks: dict[str, list[str]] = field(default_factory=dict)

    def pair(self, a: str, b: str) -> int:
        return int(self.pairs[(ord(a) * 40_503 + ord(b) * 65_599) & (BUCKETS - 1)])


@dataclass
class Told:
    """What the first pass and the corpus tell of one chapter.

    numbers and titles: as in Edges. running: lines that repeat in the book. styles: of
    the book's page numbers. readings: of misread words. cuts: parts that are one word.
    """

    numbers: list[Number] = field(default_factory=list)
    titles: set[int] = field(default_factory=set)
    running: set[int] = field(default_factory=set)
    styles: frozenset[str] = frozenset()
    readings: dict[str, str] = field(default_factory=dict)
    cuts: set[tuple[str, str]] = field(default_factory=set)


def misread_han(text: str, corpus: Corpus) -> list[tuple[int, str]]:
    """Places of characters whose neighbours go far better with what scanners make them of, and that."""
    out = []
    for i, c in enumerate(text):
        others = corpus.looks.get(c)
        if not others:
            continue
        before = text[i - 1] if i and "一" <= text[i - 1] <= "鿿" else ""
        after = text[i + 1] if i + 1 < len(text) and "一" <= text[i + 1] <= "鿿" else ""
        if not before and not after:
            continue
        def fit(x: str) -> float:
            return ((corpus.pair(before, x) + 1) if before else 1) * ((corpus.pair(x, after) + 1) if after else 1)
        best = max(others, key=lambda x: (fit(x), x))
        if fit(best) >= PAIR_ODDS * fit(c):
            out.append((i, best))
    return out


def _join(lines: list[tuple[int, str]], told: Told) -> tuple[str, list[int], list[int]]:
    """The text of lines joined, the line of every character, and the lines that end in a cut word."""
    text, owner, cuts = [], [], []
    for k, (no, line) in enumerate(lines):
        s = line.strip()
        follows = lines[k + 1][1].strip() if k + 1 < len(lines) else ""
        pair, glue = parts_at(s, follows) if s and s[-1] in CUTS else None, " "
        if pair:
            glue = ""
            if s[-1] in "­¬" or pair in told.cuts:
                cuts.append(no)
                s = s[:-1]
        elif s and follows and (s[-1] >= "⺀" or follows[0] >= "⺀"):
            glue = ""
        text.append(s + glue)
        owner.extend([no] * len(text[-1]))
    return "".join(text), owner, cuts


def lines_with_kinds(c: Chapter, told: Told, corpus: Corpus) -> list[tuple[int, str]]:
    gone = furniture(c, told)
    out = [(i, "furniture") for i, g in enumerate(gone) if g]
    text = [(i, c.lines[i]) for i in c.filled if not gone[i]]
    joined, owner, cuts = _join(text, told)
    out += [(i, "hyphen") for i in cuts]
    wrong = {owner[i] for i, _ in misread_han(joined, corpus)}
    if told.readings:
        for at, word in words_of(joined):
            right = told.readings.get(word)
            if right:
                place = next((k for k, (x, y) in enumerate(zip(word, right, strict=False)) if x != y), len(word) - 1)
                wrong.add(owner[min(at + place, len(owner) - 1)])
    return out + [(i, "glyph") for i in sorted(wrong)]


def restored(c: Chapter, told: Told, corpus: Corpus) -> str:
    """The chapter's paragraphs, each on a line of its own."""
    gone = furniture(c, told)
    text = [(i, ln) for i, ln in enumerate(c.lines) if not gone[i]]
    widths = sorted(len(ln.strip()) for _, ln in text if ln.strip())
    usual = widths[int(0.9 * (len(widths) - 1))] if widths else 0
    paragraphs, now = [], []
    for k, (i, ln) in enumerate(text):
        if not ln.strip():
            if now:
                paragraphs.append(now)
            now = []
            continue
        if now and (ln.startswith("　　") or ln.startswith("    ")):
            paragraphs.append(now)
            now = []
        now.append((i, ln))
        here, after = ln.strip(), text[k + 1][1].strip() if k + 1 < len(text) else ""
        title = k == 0 and c.title and alike(letters(ln), c.title)
        ends = len(here) < 0.75 * usual and here[-1] in "。！？.!?—"
        # a short line without a sign at its end stands alone, unless the next one goes on with it
        alone = len(here) < 0.5 * usual and here[-1] not in CUTS and not re.search(r"[，,、]", here) and not after[:1].islower()
        if title or ends or alone:
            paragraphs.append(now)
            now = []
    if now:
        paragraphs.append(now)
    out = []
    for p in paragraphs:
        joined, _, _ = _join(p, told)
        chars = list(joined)
        for i, right in misread_han(joined, corpus):
            chars[i] = right
        joined = "".join(chars)
        for at, word in reversed(words_of(joined)):
            right = told.readings.get(word)
            if right:
                was = joined[at : at + len(word)]
                joined = joined[:at] + (right.capitalize() if was[:1].isupper() else right) + joined[at + len(word) :]
        out.append(joined.strip())
    return "\n".join(out)


def _sent(small: DataFrame, most: int = SENT_ROWS) -> DataFrame:
    """Broadcast a table if it has few rows, or else leave the join to a shuffle."""
    return F.broadcast(small) if small.count() <= most else small


def confusions(words: DataFrame) -> dict[str, list[str]]:
    """What scanners make of letters, and what it was: one or two signs for one or two others.

    ``words`` has word and n. A rare word that becomes a frequent one by one change
    inside it speaks for the change; changes that only turn ends into other ends
    (as inflections do) don't count. A change needs SUPPORT different right words, so
    the result is bounded by the alphabet.
    """
    most = words.agg(F.max("n")).first()[0] or 0
    known = words.where((F.col("n") >= WORD_ODDS) | (F.col("n") * WORD_ODDS <= most)).where(F.length("word").between(5, 64))
    slots = F.expr("flatten(transform(sequence(3, length(word) - 2), i -> transform(filter(array(1, 2), m -> i + m <= length(word) - 1), m -> struct(concat(substr(word, 1, i - 1), ' ', substr(word, i + m)) AS slot, substr(word, i, m) AS x))))")
    at = known.select("word", "n", F.explode(slots).alias("s")).select("word", "n", F.col("s.slot").alias("slot"), F.col("s.x").alias("x"))
    right = at.where(F.col("n") >= WORD_ODDS).select("slot", F.col("word").alias("right"), F.col("n").alias("often"), F.col("x").alias("y"))
    plain = F.col("y").rlike(r"^\p{L}+$")
    ends = (F.substring("x", 1, 1) != F.substring("y", 1, 1)) & (F.expr("right(x, 1)") != F.expr("right(y, 1)"))
    pairs = at.join(right, "slot").where((F.col("often") >= F.col("n") * WORD_ODDS) & plain & ends)
    found = pairs.groupBy("x", "y").agg(F.countDistinct("right").alias("support")).where(F.col("support") >= SUPPORT).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: (r.x, r.y)):
        out.setdefault(r.x, []).append(r.y)
    return out


def tries(word: str, confused: dict[str, list[str]]) -> set[str]:
    """What a word may have been: one or two changes of one kind undone, or any letter for a sign inside it."""
    out = set()
    for wrong, rights in confused.items():
        at = word.find(wrong)
        while at >= 0:
            for right in rights:
                once = word[:at] + right + word[at + len(wrong) :]
                out.add(once)
                again = once.find(wrong, at + len(right))
                if again >= 0:
                    out.add(once[:again] + right + once[again + len(wrong) :])
            at = word.find(wrong, at + 1)
    for m in re.finditer(r"[^\w]", word):
        out.update(word[: m.start()] + c + word[m.end() :] for c in "abcdefghijklmnopqrstuvwxyz")
    return {t for t in out if t and all(c.isalpha() for c in t)}


def _flag(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) & (FLAGS - 1) for w in words), np.int64, len(words))


def readings_of(forms: DataFrame, counts: DataFrame, words: DataFrame) -> DataFrame:
    """word and right of misread forms: the most frequent word they may have been, if it is far more frequent.

    ``forms`` has word (distinct), ``counts`` has word and n of all words, ``words`` of
    those that count. Compounds are read part by
    part unless they are frequent themselves. Rows of more than LONGEST_WORD letters
    stand as they are.
    """
    spark = forms.sparkSession
    confused = confusions(counts)
    often = words.where(F.col("n") >= WORD_ODDS)
    flags = np.zeros(FLAGS, bool)
    flags[often.select(F.crc32(F.encode("word", "utf-8")).bitwiseAND(FLAGS - 1).alias("flag")).distinct().toArrow()["flag"].to_numpy()] = True
    shared = spark.sparkContext.broadcast((confused, np.packbits(flags)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        confused, packed = shared.value
        for batch in batches:
            have, may = [], []
            for word in batch["word"].to_pylist():
                got = list(tries(word, confused))
                if got:
                    at = _flag(got)
                    for t, yes in zip(got, (packed[at >> 3] >> (7 - (at & 7))) & 1, strict=True):
                        if yes:
                            have.append(word)
                            may.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(have, pa.string()), pa.array(may, pa.string())], ["word", "may"])

    parts = forms.select(F.explode(F.split("word", "-")).alias("word")).distinct().where(F.length("word").between(2, LONGEST_WORD) & ((F.length("word") >= 4) | F.col("word").rlike(r"[^\p{L}]")))
    may = parts.mapInArrow(run, "word string, may string")
    asked = may.join(words.select(F.col("word").alias("may"), F.col("n").alias("often")), "may").join(words, "word", "left")
    plain = cut(asked.where(F.col("often") >= WORD_ODDS * F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))).groupBy("word").agg(F.max_by("may", F.struct("often", "may")).alias("right")))
    joined = forms.where(F.col("word").contains("-")).join(words, "word", "left").where(F.coalesce("n", F.lit(0)) < 4 * WORD_LEAST).select("word", F.posexplode(F.split("word", "-")).alias("pos", "part"))
    read = joined.join(plain.withColumnRenamed("word", "part"), "part", "left").groupBy("word").agg(F.count("right").alias("changed"), F.array_sort(F.collect_list(F.struct("pos", F.coalesce("right", "part").alias("t")))).alias("ts"))
    return cut(plain.unionByName(read.where("changed > 0").select("word", F.array_join(F.transform("ts", lambda t: t["t"]), "-").alias("right"))))


def cut_pairs(parts: DataFrame, words: DataFrame, readings: DataFrame) -> DataFrame:
    """a and b (distinct pairs) of those that are one word and no compound.

    The whole word and the compound are compared by their counts; where neither is
    known, a pair of words is a compound and anything else a cut word.
    """
    joined = F.concat_ws("-", "a", "b")
    forms = F.array(*[F.struct(F.lit(k).alias("k"), x.alias("word")) for k, x in enumerate((F.col("a"), F.col("b"), F.concat("a", "b"), joined))])
    known = parts.select("a", "b", F.explode(forms).alias("f")).select("a", "b", "f.k", "f.word").join(words, "word", "left").join(readings, "word", "left")
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    wide = known.groupBy("a", "b").agg(*[F.coalesce(pick(k, "n"), F.lit(0)).alias(f"n{k}") for k in range(4)], *[pick(k, "right").alias(f"r{k}") for k in range(3)])
    read = wide.withColumn("word", F.concat_ws("-", F.coalesce("r0", "a"), F.coalesce("r1", "b"))).join(words.select("word", F.col("n").alias("n4")), "word", "left")
    apart = (F.col("n0") > 0) & (F.col("n1") > 0)
    # a compound cut in its last part, or parted at its first hyphen
    inner = F.col("a").contains("-") | F.col("b").contains("-")
    is_cut = (
        F.when((F.col("n2") > 0) | (F.col("n3") > 0), F.col("n2") >= F.col("n3"))
        .when(F.coalesce("n4", F.lit(0)) > 0, False)
        .when(inner, ~apart)
        .otherwise(~apart | F.col("r2").isNotNull())
    )
    return read.where(is_cut).select("a", "b")


def look_alikes(grams: DataFrame, pairs: np.ndarray) -> dict[str, list[str]]:
    """Characters that scanners make of others, and those others.

    ``grams`` has gram (three characters as a number) and n. Where something else is
    usual between the same neighbours and goes far better with them, a character speaks
    for being its misreading. It is one if a good part of all its occurrences do so, in
    SUPPORT surroundings at least; or, a character with a life of its own, if nearly all
    its odd occurrences speak for the same other one and lie evenly over the places of
    that one, as errors of a scanner do. The result is bounded by the alphabet.
    """
    shared = grams.sparkSession.sparkContext.broadcast(pairs)

    @F.pandas_udf("double")
    def fit(gram: pd.Series) -> pd.Series:
        g, table = gram.to_numpy(), shared.value
        p, c, s = g >> 32, (g >> 16) & 0xFFFF, g & 0xFFFF
        return pd.Series(np.where(p > 0, table[_pair_bucket(p, c)] + 1.0, 1.0) * np.where(s > 0, table[_pair_bucket(c, s)] + 1.0, 1.0))

    place = F.shiftleft(F.shiftright("gram", 32), 16).bitwiseOR(F.col("gram").bitwiseAND(0xFFFF))
    at = cut(grams.select(place.alias("place"), F.shiftright("gram", 16).bitwiseAND(0xFFFF).alias("c"), "n", fit("gram").alias("fit")))
    total = at.groupBy("place").agg(F.sum("n").alias("total"))
    usual = cut(at.where("n >= 5").join(total, "place").where(F.col("n") >= USUAL_SHARE * F.col("total")).select("place", F.col("c").alias("d"), F.col("n").alias("often"), F.col("fit").alias("better")))
    right = usual.groupBy("d").agg(F.sum("often").alias("d_often"), F.count("*").alias("d_places"))
    speaks = (F.col("often") >= WORD_ODDS * F.col("n")) & (F.col("better") >= PAIR_ODDS * F.col("fit"))
    both = cut(at.join(usual, "place").where("c <> d").select("place", "c", "d", "n", "often", speaks.alias("speaks")))
    pairs_ = both.groupBy("c", "d").agg(F.count_if("speaks").alias("places"), F.sum(F.when(F.col("speaks"), F.col("n")).otherwise(0)).alias("times"), F.count_if(~F.col("speaks")).alias("against"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n") / F.col("often")).alias("squares"))
    odd = both.where("speaks").groupBy("c", "place").agg(F.max("n").alias("n")).groupBy("c").agg(F.sum("n").alias("odd"))
    all_ = at.groupBy("c").agg(F.sum("n").alias("all"))
    known = pairs_.where(F.col("places") >= SUPPORT).join(all_, "c").join(odd, "c").join(right, "d")
    rate = F.col("n") / F.col("d_often")
    # how unevenly the misreadings lie over all places of the right character, 1 if by chance
    uneven = (F.col("squares") / rate - 2 * F.col("n") + rate * F.col("d_often")) / F.greatest(F.col("d_places") - 1, F.lit(1))
    mostly = F.col("times") >= MISREAD_SHARE * F.col("all")
    sometimes = (F.col("places") >= PLACES) & (F.col("against") <= 0.2 * F.col("places")) & (F.col("times") >= EXPLAINED * F.col("odd")) & (uneven <= UNEVEN)
    out: dict[str, list[str]] = {}
    for r in sorted(known.where(mostly | sometimes).select("c", "d").collect(), key=lambda r: (r.c, r.d)):
        out.setdefault(chr(r.c), []).append(chr(r.d))
    return out


def running_lines(first: DataFrame, about: DataFrame) -> DataFrame:
    """row_key and line of the lines at page edges that repeat.

    Lines whose letters are equal are counted over all books; a key that stands often
    enough, in two chapters at least and nearly always at edges, is a running line of
    every book that has it, and a name of the book is one from its first sighting. Then
    lines of the same book that are alike, misread letters allowed, join it; keys that
    run through many books are compared with the lines of all.
    """
    near = cut(first.where("near is not null").select("row_key", "textbook_id", F.explode("near").alias("e")).select("row_key", "textbook_id", "e.line", "e.key", "e.counts", "e.beside"))

    @F.pandas_udf("long")
    def hashed(keys: pd.Series) -> pd.Series:
        return pd.Series(pd.util.hash_array(keys.to_numpy(object), categorize=False).astype(np.int64))

    # chapters and books first, so that no key's lines meet in one task
    by = near.where("counts").groupBy("key", "textbook_id", "row_key").agg(F.count("*").alias("edge"), F.count_if("beside").alias("beside"))
    by = by.groupBy("key", "textbook_id").agg(F.sum("edge").alias("edge"), F.sum("beside").alias("beside"), F.count("*").alias("chapters"))
    seen = by.groupBy("key").agg(F.sum("edge").alias("edge"), F.sum("beside").alias("beside"), F.sum("chapters").alias("chapters"), F.count("*").alias("books"))
    often = seen.where((F.col("edge") >= REPEATS_LEAST) & (F.col("chapters") >= 2)).withColumn("hash", hashed("key"))
    inside = first.where("body is not null").select(F.explode("body").alias("hash"))
    body = inside.groupBy("hash").agg(F.count("*").alias("inside"))
    lines = near.where("counts").agg(F.count("*").alias("near"), F.count_if("beside").alias("beside")).first()
    total = max(1, lines.near + (first.agg(F.sum(F.size("body"))).first()[0] or 0))

    def odds(times: str, share: float) -> Column:
        """How far the share at edges is from that of all lines, as the logarithm of odds."""
        q, p = F.least(F.col(times) / F.col("all"), F.lit(1 - 1e-9)), min(max(share, 0.02), 0.98)
        return F.when(q > p, F.col("all") * (q * F.log(q / p) + (1 - q) * F.log((1 - q) / (1 - p)))).otherwise(0.0)

    held = often.join(body, "hash", "left").withColumn("all", F.col("edge") + F.coalesce("inside", F.lit(0))).where(F.col("edge") >= EDGE_SHARE * F.col("all"))
    seeds = cut(held.where((odds("edge", lines.near / total) >= EVIDENCE) | (odds("beside", lines.beside / total) >= EVIDENCE)).select("key", "books"))
    books = about.count()
    names = about.select("textbook_id", F.explode(F.array("title_key", "stem_key")).alias("seed")).where("seed <> ''").distinct()
    own = near.select("textbook_id", "key").distinct().join(seeds.select("key"), "key").select("textbook_id", F.col("key").alias("seed"))
    scoped = own.unionByName(names).distinct()
    wide = seeds.where(F.col("books") >= F.greatest(F.lit(REPEATS_LEAST), F.lit(EVERYWHERE * books))).select(F.lit(None).cast("string").alias("textbook_id"), F.col("key").alias("seed"))

    @F.pandas_udf("array<string>")
    def pieces(keys: pd.Series) -> pd.Series:
        return keys.map(_pieces)

    @F.pandas_udf("boolean")
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([alike(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    keys = near.select("textbook_id", "key").distinct().select("textbook_id", "key", F.explode(pieces("key")).alias("piece"))
    long = lambda a, b: F.abs(F.length(a) - F.length(b)) <= 0.2 * F.greatest(F.length(a), F.length(b)) + 1e-9
    of_books = cut(scoped.select("textbook_id", "seed", F.explode(pieces("seed")).alias("piece")))
    by_book = keys.join(_sent(of_books, SENT_PIECES), ["textbook_id", "piece"])
    by_all = keys.join(_sent(cut(wide.select("seed", F.explode(pieces("seed")).alias("piece"))), SENT_PIECES), "piece")
    pairs = by_book.select("textbook_id", "key", "seed").unionByName(by_all.select("textbook_id", "key", "seed")).where(long("key", "seed")).distinct()
    found = pairs.where((F.col("key") == F.col("seed")) | same("key", "seed")).select("textbook_id", "key").distinct()
    return near.join(found, ["textbook_id", "key"]).select("row_key", "line").distinct()


def prepare(chapters: DataFrame, books: DataFrame, others: DataFrame | None = None) -> tuple[DataFrame, Corpus]:
    """Chapters with all that the corpus tells each of them, and the tables of characters."""
    spark = chapters.sparkSession

    @F.pandas_udf("string")
    def key_of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: letters(t or ""))

    @F.pandas_udf("string")
    def stem_of(names: pd.Series) -> pd.Series:
        return names.map(lambda t: letters(_stem(t)))

    about = cut(books.where("textbook_id is not null").groupBy("textbook_id").agg(F.max("title").alias("book_title"), F.max("filename").alias("filename")).withColumn("title_key", key_of("book_title")).withColumn("stem_key", stem_of("filename")))
    rows = chapters.where("textbook_id is not null").select("textbook_id", "ord", "title", "content", "page_start", "page_end").join(_sent(about.select("textbook_id", "book_title", "filename")), "textbook_id", "left")
    rows = rows.withColumn("row_key", F.xxhash64("textbook_id", "ord", "content")).withColumn("scanned", F.lit(True))
    # a chapter is the unit of work, whatever share of them one book has
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = keep(rows.repartition(tasks, "row_key").dropDuplicates(["row_key"]))
    every = rows
    if others is not None:
        more = others.where("content is not null").select("content").dropDuplicates()
        every = rows.unionByName(more.withColumn("scanned", F.lit(False)).repartition(tasks), allowMissingColumns=True)
    first = keep(every.mapInArrow(_first_pass, _FIRST_DDL))
    counts = keep(first.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")))
    words = counts.where(F.col("n") >= WORD_LEAST)
    by_bucket = first.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(BUCKETS, np.int64)
    pairs[by_bucket["bucket"].to_numpy()] = by_bucket["n"].to_numpy()
    pairs = np.minimum(pairs, 2**31 - 1).astype(np.int32)
    looks = look_alikes(first.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")), pairs)
    own = first.where("row_key is not null")
    used = own.select("row_key", F.explode("words").alias("word"))
    readings = readings_of(used.select("word").distinct(), counts, words)
    parts = own.select("row_key", F.explode("parts").alias("p")).select("row_key", "p.a", "p.b")
    cuts = cut_pairs(parts.select("a", "b").distinct(), words, readings)
    styles = own.select("textbook_id", F.explode("styles").alias("style")).groupBy("textbook_id", "style").count()
    many = styles.groupBy("textbook_id").agg(F.sum("count").alias("all"))
    styles = styles.join(many, "textbook_id").where((F.col("count") >= REPEATS_LEAST) & (F.col("count") >= 0.1 * F.col("all"))).groupBy("textbook_id").agg(F.collect_set("style").alias("styles"))
    none = lambda t: F.lit(None).cast(t)
    said = running_lines(first, about).select("row_key", "line", none("string").alias("x"), none("string").alias("y"), F.lit(0).alias("k"))
    said = said.unionByName(used.join(readings, "word").select("row_key", none("int").alias("line"), F.col("word").alias("x"), F.col("right").alias("y"), F.lit(1).alias("k")))
    said = said.unionByName(parts.join(cuts, ["a", "b"]).select("row_key", none("int").alias("line"), F.col("a").alias("x"), F.col("b").alias("y"), F.lit(2).alias("k")))
    texts = lambda k: F.collect_list(F.when(F.col("k") == k, F.struct("x", "y")))
    told = said.groupBy("row_key").agg(F.collect_set("line").alias("running"), texts(1).alias("readings"), texts(2).alias("cuts"))
    rows = rows.join(own.select("row_key", "numbers", "titles"), "row_key").join(told, "row_key", "left").join(_sent(cut(styles)), "textbook_id", "left")
    return rows, Corpus(pairs, looks)


def _told(row: dict) -> Told:
    return Told([Number(x["place"], x["page"], x["style"]) for x in row["numbers"]], set(row["titles"]), set(row["running"] or ()), frozenset(row["styles"] or ()), {r["x"]: r["y"] for r in row["readings"] or ()}, {(r["x"], r["y"]) for r in row["cuts"] or ()})


def _send(rows: DataFrame, corpus: Corpus, each: Callable, schema: str, names: list[str]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(corpus)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int32(), *([pa.int32(), pa.string()] if len(names) == 4 else [pa.string()])]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for row in batch.to_pylist():
                for values in each(chapter_of(row), _told(row), shared.value):
                    for col, v in zip(out, (row["textbook_id"], row["ord"], *values), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    return rows.mapInArrow(run, schema)


def describe_lines(chapters: DataFrame, books: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """textbook_id, ord, line_no and kind (furniture, hyphen, glyph) of lines that scanning spoilt.

    ``chapters`` has textbook_id, ord, title, content, page_start and page_end, for scanned
    books only; ``books`` has textbook_id, title and filename; ``others`` has content of
    the rest of the corpus, for the counts. Repeated deliveries count once; null contents
    have no lines; chapters without a book id are left out. Where the page range is
    unknown, numbers that rise from page to page tell the pages. Ties between readings go
    to the last in order. Other columns are ignored, and empty tables give an empty result.
    """
    rows, corpus = prepare(chapters, books, others)
    return _send(rows, corpus, lines_with_kinds, "textbook_id string, ord int, line_no int, kind string", ["textbook_id", "ord", "line_no", "kind"]).distinct()


def restore(chapters: DataFrame, books: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """textbook_id, ord and text: the chapters in continuous paragraphs, each delivery once; null contents give empty texts."""
    rows, corpus = prepare(chapters, books, others)
    return _send(rows, corpus, lambda c, n, k: [(restored(c, n, k),)], "textbook_id string, ord int, text string", ["textbook_id", "ord", "text"]).distinct()
