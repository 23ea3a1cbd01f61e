"""Text expressions: sizes, sentences, search tokens, headings and snippets, without Python workers.

Offsets are code points, half-open. Regular expressions spell out their character classes, since engines
disagree on what a blank or a word character is.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as one estimated 0.6 token each.
CJK = "\u3400-\u4dbf\u4e00-\u9fff"
#: Blanks, as Unicode has them.
BLANK = "\\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Marks after which a sentence ends; the full stop is none, as it also ends abbreviations and numbers.
TERMINATORS = "。！？!?；;\\n"
#: Compatibility forms and what they fold to, by rule: characters of the basic plane whose NFKC form is another single character, and, of those with a
#: longer form, ellipses, the numero and trade mark signs, Roman numerals and Latin ligatures.
_NFKC = {c: unicodedata.normalize("NFKC", chr(c)) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000}
WIDE = "".join(chr(c) for c, form in _NFKC.items() if len(form) == 1 and form != chr(c))
NARROW = "".join(_NFKC[ord(c)] for c in WIDE)
LONGER = {chr(c): _NFKC[c] for low, high in ((0x2025, 0x2027), (0x2116, 0x2117), (0x2122, 0x2123), (0x2160, 0x2180), (0xFB00, 0xFB07)) for c in range(low, high) if len(_NFKC[c]) > 1}

#: Fixed values, as are the heading patterns below. Tokens of text without CJK, the narrow forms first: amounts, thousands, percentages, clause numbers with at most one letter, words.
TOKEN = (
    "[$€£][0-9,]+(?:\\.[0-9]+)?[kmb]?"
    "|[0-9]+(?:,[0-9]{3})+(?:\\.[0-9]+)?"
    "|[0-9]+(?:\\.[0-9]+)?%"
    "|[0-9]+(?:\\.[0-9]+)*[a-z]?"
    f"|[{CJK}]+"
    "|[\\p{L}\\p{N}_]+"
)
#: What a heading begins with, by level, and what no heading ends with.
CHAPTER = "^第[一二三四五六七八九十百千万0-9０-９]+[条章节款]"
NUMBERED = f"^([0-9]+(?:\\.[0-9]+)*)(?:[、.){BLANK}]|$)"
ROMAN, ROMAN_FORM = "^[IVXLCDM]{1,8}[.):、]", "^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})[.):、]"
LETTERED = "^[A-Za-z][.):、]"
BRACKETED = "^[（(]([0-9]{1,3}|[A-Za-z]|[一二三四五六七八九十百]{1,4})[）)]|^[一二三四五六七八九十]{1,4}、"
SENTENCE_END = "[。！？；.!?;]$"
NAMED = "(?i)^(article|section|clause|exhibit|schedule|appendix|annex|attachment|part|title|item|recital)([^\\p{L}\\p{N}_]|$)"
#: Labels in the order they are looked for, and the words that stand for each.
LABELS = {"entailment": "entailment|entailed|entailing|entails", "contradiction": "contradiction|contradictory|contradicts|contradicting|contradicted", "neutral": "neutral"}
SNIPPET = 200


def estimated_tokens(text: Column) -> Column:
    """``int(0.6 * CJK characters + blank-separated words after these are replaced by blanks)``; null stays null."""
    characters = F.regexp_count(text, F.lit(f"[{CJK}]"))
    words = F.regexp_count(F.regexp_replace(text, f"[{CJK}]", " "), F.lit(f"[^{BLANK}]+"))
    return F.floor(characters * F.lit(0.6) + words)


def sentences(text: Column) -> Column:
    """The sentences of a text with the blanks that follow them; together they are the text."""
    return F.regexp_extract_all(text, F.lit(f"[^{TERMINATORS}]*[{TERMINATORS}][{BLANK}]*|[^{TERMINATORS}]+$"), F.lit(0))


def search_tokens(text: Column) -> Column:
    """Search tokens in order, repeats included: lower case, compatibility forms folded, digits kept.

    Runs of CJK characters become their overlapping pairs (a single character stays), in place of a segmenter's
    dictionary words. Tokens of underscores alone are dropped; null gives null.
    """
    for char, form in LONGER.items():
        text = F.replace(text, F.lit(char), F.lit(form))
    folded = F.lower(F.translate(text, WIDE, NARROW))
    raw = F.regexp_extract_all(F.regexp_replace(folded, f"([{CJK}]+)", " $1 "), F.lit(TOKEN), F.lit(0))
    pairs = lambda run: F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
    return F.flatten(F.transform(F.filter(raw, lambda t: ~t.rlike("^_+$")), lambda t: F.when(t.rlike(f"^[{CJK}]"), pairs(t)).otherwise(F.array(t))))


def head_snippet(text: Column, size: int = SNIPPET) -> Column:
    return F.left(text, F.lit(size))


def around_snippet(text: Column, start: Column, length: Column, size: int = SNIPPET) -> Column:
    """``size`` characters around a hit at ``start`` (from 0); a hit of that size or more is shown from its start."""
    low = F.greatest(F.lit(0), start - F.floor((F.lit(size) - length) / 2))
    return F.when(length >= size, F.substring(text, start + 1, F.lit(size))).otherwise(F.substring(text, low.cast("int") + 1, F.lit(size)))


def stripped(line: Column) -> Column:
    """A line without the blanks around it."""
    return F.regexp_replace(line, f"^[{BLANK}]+|[{BLANK}]+$", "")


def heading_level(line: Column) -> Column:
    """Level of a heading line, null for other lines; see :func:`stripped_heading_level`."""
    return stripped_heading_level(stripped(line))


def raw_heading_level(line: Column) -> Column:
    """:func:`heading_level`, or 1 for lines that begin like an English legal heading or are short and nearly all capitals."""
    return stripped_raw_heading_level(stripped(line))


def stripped_heading_level(t: Column) -> Column:
    """Level of a heading, null for other lines, of a line without blanks around it.

    At most 60 characters that don't end like a sentence: a numbered chapter or article is level 1, dotted
    numbers have as many levels as parts, roman numbers and letters are 2, bracketed and CJK list marks 3.
    """
    number = F.regexp_extract(t, NUMBERED, 1)
    roman = t.rlike(ROMAN) & t.rlike(ROMAN_FORM)
    level = (
        F.when(t.rlike(CHAPTER), 1)
        .when(number != "", F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1)
        .when(roman | t.rlike(LETTERED), 2)
        .when(t.rlike(BRACKETED), 3)
    )
    return F.when((F.length(t) <= 60) & ~t.rlike(SENTENCE_END), level)


def stripped_raw_heading_level(t: Column) -> Column:
    """:func:`raw_heading_level` of a line without blanks around it."""
    named = t.rlike(NAMED)
    letters, capitals = F.regexp_count(t, F.lit("\\p{L}")), F.regexp_count(t, F.lit("\\p{Lu}"))
    # The length comes first, so that letters of long lines aren't counted.
    shouted = (F.length(t) <= 60) & (letters > 0) & (capitals / F.nullif(letters, F.lit(0)) >= 0.8) & ~t.endswith(".")
    return F.when(F.length(t) <= 80, F.coalesce(stripped_heading_level(t), F.when((t != "") & (named | shouted), 1)))


def embedding_text(title: Column, path: Column, body: Column, most: int = 400) -> Column:
    """Body text under its title and section path, for encoding only."""
    trail = F.array_join(F.filter(F.coalesce(path, F.array().cast("array<string>")), lambda p: p.isNotNull() & (p != "")), " > ")
    head = F.left(F.concat_ws(" | ", F.nullif(F.trim(title), F.lit("")), F.nullif(trail, F.lit(""))), F.lit(most))
    return F.when(head != "", F.concat(head, F.lit("\n"), body)).otherwise(body)


def document_key(path: Column, text: Column) -> Column:
    """File stem and the start of the text's md5."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), "\\.[^.]*$", "")
    return F.concat(stem, F.lit("-"), F.left(F.md5(text.cast("binary")), F.lit(8)))


def chunk_key_parts(key: Column) -> tuple[Column, Column]:
    """Document id and index of a chunk id, split at its last colon; the index is null unless it is all digits."""
    index = F.substring_index(key, ":", -1)
    return F.left(key, F.length(key) - F.length(index) - 1), F.when(key.contains(":") & index.rlike("^[0-9]+$"), index.try_cast("int"))


def normal_label(text: Column) -> Column:
    """The label that free text names: the first of ``LABELS`` that occurs as a word, else the first that has a word standing for it; null without any."""
    t = F.lower(text)
    named = F.coalesce(*[F.when(t.rlike(f"(^|[^\\p{{L}}\\p{{N}}_]){label}([^\\p{{L}}\\p{{N}}_]|$)"), label) for label in LABELS])
    return F.coalesce(named, *[F.when(t.rlike(f"(^|[^a-z])({words})([^a-z]|$)"), label) for label, words in LABELS.items()])
