"""Text scalars as Column expressions.

Java regular expressions treat ``\\s``, ``\\w`` and ``$`` differently from the rules this library
implements, so every class is spelled out here once and the rest of the package builds on it.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Bodies of character classes (to be put between brackets).
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = r"\p{L}\p{N}_"
CJK = r"\u4e00-\u9fff"
# One blank. The members of WS are tested one by one; behind a range a Chinese character fails the first test.
BLANK = rf"[\t-\u3000&&[{WS}]]"


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times in ``body``; also works inside lambdas.

    It is the start and the end of a fold over nothing: a ``transform`` over one element would copy its result, texts and all.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda bound, _: bound, body)


# The members of WS as text, for trimming without a regular expression.
BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANKS))


def collapse_spaces(c: Column) -> Column:
    return strip(F.regexp_replace(c, rf"[{WS}]+", " "))


def count_of(c: Column, needle: str) -> Column:
    """Occurrences of a one-character needle."""
    return F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))


def cjk_only(c: Column) -> Column:
    return F.regexp_replace(c, rf"[^{CJK}]+", "")


def cjk_count(c: Column) -> Column:
    return F.length(cjk_only(c))


def latin_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^A-Za-z]+", ""))


def content_hash(c: Column) -> Column:
    """SHA-256 of the text without any whitespace."""
    return F.sha2(F.regexp_replace(c, rf"[{WS}]+", ""), 256)


def split_paragraphs(c: Column) -> Column:
    """Paragraphs of a chapter: the stripped text cut at blank lines; no text gives no paragraph."""
    body = strip(F.coalesce(c, F.lit("")))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(
        F.split(body, rf"\n[{WS}]*\n+", -1)
    )


def is_english_or_url(c: Column) -> Column:
    """Paragraphs the Chinese rules must leave alone: links, mail addresses, mostly Latin text."""
    link = c.contains("http://") | c.contains("https://") | c.contains("www.")
    mail = c.contains("@") & c.rlike(rf"[{WORD}.+-]@[{WORD}.-]+\.[{WORD}]")
    latin = latin_count(c)
    return link | mail | ((F.length(c) >= 20) & (latin >= 20) & (latin > cjk_count(c) * 2))


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """Replace the first occurrence of ``old``; the text is returned as it is when there is none."""
    at = F.instr(text, old)
    return F.when((F.length(old) == 0) | (at == 0), text).otherwise(
        F.concat(
            F.substring(text, F.lit(1), at - 1),
            new,
            F.substring(text, at + F.length(old), F.length(text)),
        )
    )


def python_regex(pattern: str) -> str:
    """Spell a configured pattern so that Java gives its shorthands their Unicode meaning."""
    inside = {"s": WS, "w": WORD, "d": r"\p{Nd}"}
    outside = {
        "s": f"[{WS}]",
        "S": f"[^{WS}]",
        "w": f"[{WORD}]",
        "W": f"[^{WORD}]",
        "d": r"\p{Nd}",
        "D": r"\P{Nd}",
        "b": f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))",
    }

    def spell(token: re.Match) -> str:
        part = token.group(0)
        if part.startswith("[") and len(part) > 1:
            # An opening bracket or a doubled ampersand inside a class means something else in Java.
            body = re.sub(r"(?<!\\)\[", r"\\[", part[1:]).replace("&&", r"&\&")
            return "[" + re.sub(r"\\([swd])", lambda m: inside[m.group(1)], body)
        if part.startswith("\\"):
            return outside.get(part[1], part)
        return "[^\\n]" if part == "." else part

    return re.sub(r"\[\^?\]?(?:\\.|[^\]\\])*\]|\\.|.", spell, pattern, flags=re.S)


@F.arrow_udf(StringType())
def _unescape(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else html.unescape(t) for t in texts.to_pylist()], pa.string())


def unescape(c: Column) -> Column:
    """Decode HTML entities. Only texts with an ampersand travel to Python."""
    return F.coalesce(_unescape(F.when(c.contains("&"), c)), c)


def normalize_unescaped(c: Column) -> Column:
    """Matching form of a text without entities: no tags, letters and digits only, lower case."""
    untagged = F.when(c.contains("<"), F.regexp_replace(c, "<[^>]+>", "")).otherwise(c)
    return F.lower(F.regexp_replace(untagged, r"[^\p{L}\p{N}]+", ""))


def normalize_match_text(c: Column) -> Column:
    return normalize_unescaped(unescape(c))


def ngram_list(c: Column, size: int) -> Column:
    """All character n-grams in order, repeats included; a shorter text is its own only gram."""
    n = F.length(c)
    chars = F.split(c, "")
    grams = let(
        chars,
        lambda cs: F.transform(
            F.sequence(F.lit(0), n - size),
            lambda i: F.concat(*[F.get(cs, i + k) for k in range(size)]),
        ),
    )
    return (
        F.when(n == 0, F.array().cast("array<string>"))
        .when(n < size, F.array(c))
        .otherwise(grams)
    )


def ngrams(c: Column, size: int = 3) -> Column:
    """The set of character n-grams."""
    return F.array_distinct(ngram_list(c, size))


# All decimal digits of Unicode against their ASCII value, built by rule.
_DIGITS = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
_ASCII_OF_DIGITS = "".join(str(unicodedata.decimal(d)) for d in _DIGITS)


def ascii_digits(c: Column) -> Column:
    return F.translate(c, "".join(_DIGITS), _ASCII_OF_DIGITS)


# Names a file must not have, and characters it must not contain.
RESERVED_FILE_NAMES = ["CON", "PRN", "AUX", "NUL"] + [f"{p}{i}" for p in ("COM", "LPT") for i in range(1, 10)]
FORBIDDEN_IN_FILE_NAMES = r'[<>:"/\\|?*\x00-\x1f]'


def safe_filename(c: Column, fallback: str = "untitled", max_length: int = 80) -> Column:
    """A title as a portable file name."""
    clean = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(c, FORBIDDEN_IN_FILE_NAMES, "_"), rf"[{WS}]+", " "),
        r"\A[ .]+|[ .]+\z",
        "",
    )
    named = F.when(clean == "", F.lit(fallback)).otherwise(clean)
    named = F.when(F.upper(named).isin(RESERVED_FILE_NAMES), F.concat(F.lit("_"), named)).otherwise(named)
    cut = F.regexp_replace(F.substring(named, 1, max_length), r"[ .]+\z", "")
    return F.when(cut == "", F.lit(fallback)).otherwise(cut)


def strip_page_marker(c: Column) -> Column:
    """Drop a trailing ``(第x/y页)`` and collapse blanks."""
    sp, d = f"[{WS}]*", r"\p{Nd}*"
    return collapse_spaces(F.regexp_replace(c, rf"{sp}\(第{sp}{d}{sp}/{sp}{d}{sp}页\){sp}\z", ""))


def strip_leading_heading(c: Column) -> Column:
    """Drop a chapter heading repeated as the first non-blank line, then leading blank lines."""
    # Line ends as text files know them; all of them count as one kind of break afterwards.
    lined = F.regexp_replace(c, r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "\n")
    body = F.regexp_replace(lined, rf"\A(?:[{WS}&&[^\n]]*\n)+", "")
    first = F.substring_index(body, "\n", 1)
    heading = (F.length(first) <= 120) & strip(first).rlike(
        rf"\A第[{WS}]*[0-9零〇一二三四五六七八九十百千万两]{{1,20}}[{WS}]*章(?:[{WS}]|\z)"
    )
    return strip(F.when(heading, F.substring(body, F.length(first) + 1, F.length(body))).otherwise(body))


def require_text(c: Column, message: str) -> Column:
    """Struct of value and error: blank text is an error row, not an exception."""
    value = strip(F.coalesce(c, F.lit("")))
    return F.struct(
        F.when(value != "", value).alias("value"),
        F.when(value == "", F.lit(message)).alias("error"),
    )
