"""Text functions that stay inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that Unicode counts as white space.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(col: Column) -> Column:
    """Remove Unicode white space from both ends."""
    return F.btrim(col, F.lit(BLANKS))


def node_key(col: Column) -> Column:
    """The form in which ids compare: without blanks at the ends, in lower case; null for blank ids."""
    key = F.lower(strip(col))
    return F.when(key != "", key)


@lru_cache(maxsize=1)
def width_pairs() -> tuple[str, str]:
    """Full- and half-width forms and the characters they stand for, from the Unicode rule."""
    source, target = [], []
    for point in [0x3000, *range(0xFF01, 0xFFEF)]:
        plain = unicodedata.normalize("NFKC", chr(point))
        if len(plain) == 1 and plain != chr(point):
            source.append(chr(point))
            target.append(plain)
    return "".join(source), "".join(target)


def fold_width(col: Column) -> Column:
    """Bring full- and half-width characters to their usual width."""
    source, target = width_pairs()
    return F.translate(col, source, target)


def wording(col: Column) -> Column:
    """Only the letters of a line, in lower case and usual width."""
    return F.regexp_replace(F.lower(fold_width(col)), r"[^\p{L}]", "")


def visible_length(col: Column) -> Column:
    """Characters but spaces and line ends."""
    return F.length(F.translate(col, "\n ", ""))


def book_title(filename: Column) -> Column:
    """A filename without its suffix and a number of two or three digits before it."""
    return F.regexp_replace(F.regexp_replace(filename, r"\.[^.]*$", ""), r"^\d{2,3}[_\-]", "")


def book_id(filename: Column) -> Column:
    return F.concat(F.lit("book_"), F.substring(F.md5(filename.cast("binary")), 1, 8))


#: Chinese digits, and the largest number that headings spell out.
_CN, _CN_MOST = "一二三四五六七八九", 60


def cn_numbers() -> dict[str, int]:
    """Spelled numbers from 1 to 60."""
    out = {}
    for n in range(1, _CN_MOST + 1):
        tens, ones = divmod(n, 10)
        out[("" if tens == 0 else "十" if tens == 1 else _CN[tens - 1] + "十") + (_CN[ones - 1] if ones else "")] = n
    return out


#: Blanks and digits in patterns are those of Unicode.
_CHAPTER = r"(?U)^第\s*([零一二三四五六七八九十百\d]+)\s*章"


def chapter_number(text: Column) -> Column:
    """The number of a chapter heading at the start of a text: 0 if it can't be read, null if there is no heading."""
    plain = strip(text)
    spelled, arabic = F.regexp_extract(plain, _CHAPTER, 1), F.regexp_extract(plain, r"(?iU)^Chapter\s+(\d+)", 1)
    table = F.create_map(*[F.lit(x) for pair in cn_numbers().items() for x in pair])
    return F.when(spelled != "", F.coalesce(F.try_element_at(table, spelled), ascii_digits(spelled).try_cast("int"), F.lit(0))).when(arabic != "", F.coalesce(ascii_digits(arabic).try_cast("int"), F.lit(0)))


@lru_cache(maxsize=1)
def _digits() -> tuple[str, str]:
    """Digits of all scripts and the plain ones they stand for, from the Unicode rule."""
    found = [chr(p) for p in range(128, 0x10000) if unicodedata.category(chr(p)) == "Nd"]
    return "".join(found), "".join(str(unicodedata.digit(c)) for c in found)


def ascii_digits(col: Column) -> Column:
    """Digits of any script as plain ones."""
    return F.translate(col, *_digits())


def is_footer(text: Column) -> Column:
    """Short lines that are digits only, a page mark, a rights notice, or blank."""
    plain = strip(text)
    return (F.length(plain) < 30) & (plain.rlike(r"(?U)^\d+$") | plain.rlike(r"(?U)^第\s*\d+\s*页") | plain.rlike("^版权所有") | (plain == ""))


def page_mark(text: Column) -> Column:
    """The page of the first [第N页] mark, 0 without one."""
    return F.coalesce(ascii_digits(F.regexp_extract(text, r"(?U)\[第(\d+)页\]", 1)).try_cast("int"), F.lit(0))


def without_page_marks(text: Column, most: int = 800) -> Column:
    return F.substring(F.regexp_replace(text, r"(?U)\[第\d+页\]\s*", ""), 1, most)


def domain_key(chapter: Column) -> Column:
    """What stands before the first 第, or the first six characters."""
    return F.when(chapter.contains("第"), strip(F.substring_index(chapter, "第", 1))).otherwise(F.substring(chapter, 1, 6))


def compressed(definition: Column) -> Column:
    """At most 100 characters."""
    return F.when(F.length(definition) > 100, F.concat(F.substring(definition, 1, 97), F.lit("..."))).otherwise(definition)


def json_body(raw: Column) -> Column:
    """The JSON object of an answer: without code fences, from the first brace to the last; null without one."""
    bare = F.regexp_replace(F.regexp_replace(strip(raw), r"(?U)^```(?:json)?\s*", ""), r"(?U)\s*```$", "")
    body = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(body != "", body)


def citation(book: Column, chapter: Column, page: Column) -> Column:
    return F.format_string("[%s, %s, 第%d页]", book, chapter, page)


def chunk_document(book: Column, chapter: Column, page: Column, text: Column) -> Column:
    """A chunk as it stands in a context: book, chapter and page before the text."""
    return F.concat(F.lit("教材: "), book, F.lit("\n章节: "), chapter, F.format_string("\n页码: 第%d页\n\n", page), text)


def embedding_text(name: Column, definition: Column) -> Column:
    """What is embedded of a node."""
    return F.concat(name, F.lit(": "), definition)


#: Hidden characters that may stand before a name.
HIDDEN = "\ufeff\u200b\u200e\u200f"


def clean_name(name: Column) -> Column:
    """A displayed name without blanks at its ends and hidden characters before it."""
    return F.ltrim(strip(name), F.lit(HIDDEN))


#: Signs before the choices of an outline by depth, and before statements by kind.
CHOICE_SIGNS = ["📘 ", "  📄 ", "    📌 "]
KIND_SIGNS = {"总结": "📝", "定义": "🟣", "定理": "🔴", "命题": "🟠", "推论": "🟢", "引理": "🔵"}


def choice_label(depth: Column, name: Column) -> Column:
    """A name of an outline with the sign of its depth: chapters have depth 1, sections 2, all below 3."""
    signs = F.array(*map(F.lit, CHOICE_SIGNS))
    return F.concat(F.element_at(signs, F.least(F.greatest(depth, F.lit(1)), F.lit(3)).cast("int")), name)


def kind_label(kind: Column, name: Column) -> Column:
    """A name of at most 60 characters with the sign of its kind, if it has one."""
    sign = F.create_map(*[F.lit(x) for pair in KIND_SIGNS.items() for x in pair])[F.coalesce(kind, F.lit(""))]
    return F.concat(F.coalesce(F.concat(sign, F.lit(" ")), F.lit("")), F.substring(name, 1, 60))


def choice_name(label: Column) -> Column:
    """The name in a choice's label."""
    return strip(F.ltrim(strip(label), F.lit("".join(s.strip() for s in CHOICE_SIGNS))))


def choice_question(label: Column) -> Column:
    """The question that is asked when a choice is taken; empty for an empty choice."""
    name = choice_name(label)
    return F.when(F.coalesce(label, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("请详细解释「"), name, F.lit("」的内容，包括其数学表述和相关背景。")))
