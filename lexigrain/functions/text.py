"""Column functions on text. Offsets and lengths are code points everywhere."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is a run of letters, a token of a diff, a sentence's end and a word.
LETTER_RUNS = r"(\p{L}+|[^\p{L}]+)"
DIFF_TOKENS = r"(\p{L}+|\p{N}+(?:['’.,]\p{N}+)*|\s+|[\s\S])"
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-ZÄÖÜ\"„])|\n+"
WORDS = r"([\p{L}\p{N}\p{M}_]+)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Letter runs and what is between them; joined they are the text again."""
    return F.regexp_extract_all(col(text), F.lit(LETTER_RUNS), F.lit(1))


def letter_words(text: Column | str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(r"(\p{L}+)"), F.lit(1))


def diff_tokens(text: Column | str) -> Column:
    """Letters, numbers with their groups, white space, or one other character."""
    return F.regexp_extract_all(col(text), F.lit(DIFF_TOKENS), F.lit(1))


def sentences(text: Column | str) -> Column:
    """Sentences of a corpus text: broken at line ends, and after a stop before a capital or quote."""
    return F.filter(F.split(col(text), SENTENCE_BREAK), lambda s: F.trim(s) != "")


def sentence_spans(text: Column | str) -> Column:
    """Sentences that end with their stops and one white space after them; the rest is the last one."""
    return F.regexp_extract_all(col(text), F.lit(r"([\s\S]+?(?:[.!?]+(?:\s|$)|$(?![\s\S])))"), F.lit(1))


def all_caps(w: Column | str) -> Column:
    w = col(w)
    return (F.length(w) > 1) & (w == F.upper(w)) & (w != F.lower(w))


def starts_upper(w: Column | str) -> Column:
    first = F.substring(col(w), 1, 1)
    return first != F.lower(first)


def capitalised(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))


def match_case(original: Column | str, replacement: Column | str) -> Column:
    """``replacement`` in the case of ``original``: all capitals, first capital, or as it is."""
    original, replacement = col(original), col(replacement)
    return F.when(all_caps(original), F.upper(replacement)).when(starts_upper(original), capitalised(replacement)).otherwise(replacement)


def swissify(text: Column | str) -> Column:
    return F.replace(col(text), F.lit("ß"), F.lit("ss"))


def swissify_offset(text: Column | str, offset: Column | str) -> Column:
    """Where a place of ``text`` lies after ``swissify``."""
    before = F.substring(col(text), F.lit(1), col(offset))
    return col(offset) + F.length(before) - F.length(F.replace(before, F.lit("ß"), F.lit("")))


def swissify_offsets(text: Column | str, every: int) -> Column:
    """Where each ``every``-th place of ``text`` lies after ``swissify``; the text is walked through once."""
    text = col(text)
    same = F.sequence(F.lit(0), F.length(text), F.lit(every))
    more = F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{{every}}}"), F.lit(0)), lambda s: F.lit(every) + F.length(s) - F.length(F.replace(s, F.lit("ß"), F.lit(""))))
    places = F.aggregate(more, F.array(F.lit(0)), lambda done, n: F.array_append(done, F.element_at(done, -1) + n))
    return F.when(text.contains("ß"), places).otherwise(same)


def ss_pairs(word: Column | str) -> Column:
    """Places of the non-overlapping ``ss`` of a word, from the left."""
    parts = F.split(col(word), "ss", -1)
    return F.when(
        F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.length(F.array_join(F.slice(parts, F.lit(1), i), "ss")))
    ).otherwise(F.array().cast("array<int>"))


def ss_words(text: Column | str) -> Column:
    """Whole words that hold ``ss`` or ``ß``."""
    return F.filter(F.regexp_extract_all(col(text), F.lit(WORDS), F.lit(1)), lambda w: w.contains("ss") | w.contains("ß"))


def letters(text: Column | str) -> Column:
    """How many letters a text has."""
    return F.length(F.regexp_replace(col(text), r"[^\p{L}]", ""))


def host(url: Column | str) -> Column:
    """Lower-case host without port; empty where there is none."""
    return F.coalesce(F.lower(F.try_parse_url(col(url), F.lit("HOST"))), F.lit(""))


def bucket100(key: Column | str) -> Column:
    """md5 of a key, read as a 128-bit number, modulo 100."""
    digest = F.md5(col(key))
    acc = F.lit(0)
    for i in range(4):
        chunk = F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")
        acc = (acc * 96 + chunk) % 100  # 16**8 is 96 modulo 100
    return acc.cast("int")


def split_name(key: Column | str, test: int = 1, val: int = 2) -> Column:
    """``test``, ``val`` or ``train`` by the key's bucket."""
    b = bucket100(key)
    return F.when(b < test, "test").when(b < val, "val").otherwise("train")


def around(text: Column | str, start: Column, end: Column, width: int) -> Column:
    """Text from ``width`` before ``start`` (from 0) to ``width`` after ``end``."""
    first = F.greatest(F.lit(0), start - width)
    return F.substring(col(text), first + 1, end + width - first)


def distinct_matches(text: Column | str, pattern: str) -> Column:
    """How many different matches (lower-cased) a pattern has."""
    return F.size(F.array_distinct(F.transform(F.regexp_extract_all(col(text), F.lit(pattern), F.lit(0)), lambda m: F.lower(m))))


#: Spacing accents and the combining marks they stand for.
ACCENTS = {"´": "\u0301", "¨": "\u0308", "ˆ": "\u0302", "˜": "\u0303", "¸": "\u0327", "˚": "\u030a", "ˇ": "\u030c", "˘": "\u0306", "˙": "\u0307", "˝": "\u030b", "¯": "\u0304", "˛": "\u0328"}


@lru_cache(1)
def composed() -> dict[str, str]:
    """Accent and letter to the one letter that Unicode composes of them, where there is one."""
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
    made = {accent + x: unicodedata.normalize("NFC", x + mark) for accent, mark in ACCENTS.items() for x in letters}
    return {k: v for k, v in made.items() if len(v) == 1}


def compose_accents(text: Column | str) -> Column:
    """A spacing accent before a letter that takes it becomes one letter. In Arrow batches with a hashed table; Spark looks up a map key by key."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        pairs = composed()
        letter_after = re.compile(rf"[{''.join(ACCENTS)}][^\W\d_]")
        return texts.map(lambda t: None if t is None else letter_after.sub(lambda m: pairs.get(m[0], m[0]), t))

    return run(col(text))


def normalised(text: Column | str, form: str = "NFC") -> Column:
    """``text`` in a Unicode normal form. Spark has no such function, so it runs in Arrow batches; pure ASCII is left out."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return F.when(col(text).rlike(r"[^\x00-\x7F]"), run(col(text))).otherwise(col(text))


def detokenise(words: Column | str) -> Column:
    """Words joined by spaces, none before closing punctuation nor after opening brackets."""
    joined = F.array_join(col(words), " ")
    return F.regexp_replace(F.regexp_replace(joined, r" ([.,;:!?)\]}»“])", "$1"), r"([(\[{«„]) ", "$1")


def model_chunks(text: Column | str, most: int = 1200) -> Column:
    """Runs of whole sentences of at most ``most`` characters; a longer sentence is a chunk of its own."""
    pieces = F.regexp_extract_all(col(text), F.lit(r"([\s\S]+?(?:[.!?]+(?:\s+|$)|$))"), F.lit(1))

    def step(acc: Column, s: Column) -> Column:
        fits = (acc["open"] == "") | (F.length(acc["open"]) + F.length(s) <= most)
        return F.struct(F.when(fits, acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])).alias("done"), F.when(fits, F.concat(acc["open"], s)).otherwise(s).alias("open"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    return F.aggregate(pieces, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))


#: Named entities that pages use most.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&auml;": "ä", "&ouml;": "ö", "&uuml;": "ü", "&Auml;": "Ä", "&Ouml;": "Ö", "&Uuml;": "Ü", "&szlig;": "ß", "&eacute;": "é", "&egrave;": "è", "&agrave;": "à", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&laquo;": "«", "&raquo;": "»"}


def _numeric(text: Column) -> Column:
    """Numeric entities, decimal or hexadecimal, as characters."""
    parts = F.regexp_extract_all(text, F.lit(r"(&#\d{1,6};|&#[xX][0-9a-fA-F]{1,5};|[^&]+|&)"), F.lit(1))
    code = lambda p: F.when(p.rlike("^&#[xX]"), F.conv(F.regexp_extract(p, "([0-9a-fA-F]+);", 1), 16, 10)).otherwise(F.regexp_extract(p, r"(\d+);", 1)).cast("int")
    utf16 = lambda c: F.when(c < 0x10000, F.lpad(F.hex(c), 4, "0")).otherwise(F.concat(F.hex(F.shiftright(c - 0x10000, 10) + 0xD800), F.hex((c - 0x10000).bitwiseAND(F.lit(0x3FF)) + 0xDC00)))
    shown = F.array_join(F.transform(parts, lambda p: F.when(p.startswith("&#"), F.decode(F.unhex(utf16(code(p))), "UTF-16BE")).otherwise(p)), "")
    return F.when(text.rlike(r"&#(?:\d{1,6}|[xX][0-9a-fA-F]{1,5});"), shown).otherwise(text)


def html_text(html: Column | str, most: int | None = None) -> Column:
    """Visible text of a page: comments and the content of four elements go, tags become breaks, entities characters; ``most`` characters of it."""
    out = F.regexp_replace(col(html), r"(?is)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?is)<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>", " ")
    out = _numeric(F.regexp_replace(out, r"(?is)<[^>]+>", " "))
    for name, value in (*ENTITIES.items(), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(value))
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return out if most is None else F.substring(out, 1, most)


def thousands(text: Column | str) -> Column:
    """1'250'000.50 becomes 1.250.000,50."""
    number = r"(?<!\d)\d{1,3}(?:['’]\d{3})+(?:\.\d{1,2}(?!\d))?"
    parts = F.regexp_extract_all(col(text), F.lit(rf"({number}|\D+|\d)"), F.lit(1))
    german = lambda p: F.regexp_replace(F.regexp_replace(p, r"\.(\d{1,2})$", ",$1"), "['’]", ".")
    return F.when(col(text).rlike(number), F.array_join(F.transform(parts, lambda p: F.when(p.rlike(rf"^{number}$"), german(p)).otherwise(p)), "")).otherwise(col(text))


def prices(text: Column | str) -> Column:
    """CHF 12.50 becomes CHF 12,50, with the currency before or after."""
    before = r"((?:CHF|SFr\.|Fr\.|EUR|€)\s?\d+)\.(\d{2}|[–-]{1,2})(?!\d)"
    after = r"(?<![\d.,'’])(\d+)\.(\d{2}|[–-]{1,2})(?=\s?(?:CHF|SFr\.|Fr\.|Franken|EUR|Euro|€)(?!\p{L}))"
    return F.regexp_replace(F.regexp_replace(col(text), before, "$1,$2"), after, "$1,$2")
