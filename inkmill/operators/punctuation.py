"""Chinese punctuation rules.

The rules run strictly one after the other, each on the state that the one before leaves. All run in one ``transform``
over the paragraphs, so a whole chapter is cleaned inside its own row, without a shuffle and without Python.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkmill.functions.text import BLANK, CJK, WS, cjk_count, count_of, is_english_or_url, let, rstrip
from inkmill.operators import rulebook as rb

_NEXT = rf"""{CJK}“”"'"""
_END = r"\n?\z"

# rule, character that must be present, pattern, replacement
REWRITES = [
    (rb.ESCAPED_QUOTE, "\\", r'\\+(?=")', ""),
    (rb.MIXED_DASH, None, rf"(?<=[{CJK}]){BLANK}*[—–-]{{2,}}{BLANK}*(?=[{CJK}])", "——"),
    (rb.REPEATED_COMMA, "，，", "，{2,}", "，"),
    (rb.REPEATED_PERIOD, "。。", "。{2,}", "。"),
    (rb.ASCII_COMMA, ",", rf"(?<=[{CJK}]){BLANK}*,{BLANK}*(?=[{_NEXT}])", "，"),
    (rb.ASCII_PERIOD, ".", rf"(?<=[{CJK}]){BLANK}*\.{BLANK}*(?={_END}|[{_NEXT}])", "。"),
    (rb.ASCII_QUESTION, "?", rf"(?<=[{CJK}]){BLANK}*\?{BLANK}*(?={_END}|[{_NEXT}])", "？"),
    (rb.ASCII_EXCLAMATION, "!", rf"(?<=[{CJK}]){BLANK}*!{BLANK}*(?={_END}|[{_NEXT}])", "！"),
    (rb.ASCII_ELLIPSIS, "...", rf"(?<=[{CJK}]){BLANK}*\.{{3,}}{BLANK}*(?={_END}|[{_NEXT}])", "……"),
]
_DASHES = ["—", "–", "-"]


def _state(s: Column, text: Column, issues: Column) -> Column:
    return F.struct(s["raw"].alias("raw"), text.alias("text"), issues.alias("issues"))


def initial_state(p: Column) -> Column:
    """State of a paragraph with the untouched text and no issue; no text where the rules leave a paragraph alone."""
    return F.struct(
        p.alias("raw"), F.when(~is_english_or_url(p), p).alias("text"), rb.no_issues().alias("issues")
    )


def _any_of(text: Column, marks) -> Column:
    return reduce(or_, [text.contains(mark) for mark in marks])


def rewrite(state: Column, fact: rb.Fact, needed: str | None, pattern: str, replacement: str) -> Column:
    """Apply one pattern rule: every match is an issue, every match is replaced."""

    def step(s):
        text = s["text"]
        possible = text.contains(needed) if needed else _any_of(text, _DASHES)

        def replaced(found):
            issues = F.concat(s["issues"], F.transform(found, lambda m: rb.issue(fact, m, replacement)))
            new = _state(s, F.regexp_replace(text, pattern, replacement), issues)
            return F.when(F.size(found) > 0, new).otherwise(s)

        return F.when(possible, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), replaced)).otherwise(s)

    return let(state, step)


def paired_quotes(text: Column) -> Column:
    """Text with its straight quotes turned into Chinese ones where that is unambiguous."""
    straight = count_of(text, '"')
    corner_open, corner_close = count_of(text, "「"), count_of(text, "」")
    curly_open, curly_close = count_of(text, "“"), count_of(text, "”")

    def turned(mark: str) -> Column:
        return F.replace(text, F.lit('"'), F.lit(mark))

    def alternating(parts):
        last = F.size(parts) - 1
        return F.array_join(
            F.transform(
                parts,
                lambda x, i: F.when(i == last, x).otherwise(
                    F.concat(x, F.when(i % 2 == 0, F.lit("“")).otherwise(F.lit("”")))
                ),
            ),
            "",
        )

    return (
        F.when(straight == 0, text)
        .when((corner_open == corner_close + 1) & (straight == 1), turned("」"))
        .when((corner_close == corner_open + 1) & (straight == 1), turned("「"))
        .when(
            (corner_open == corner_close) & text.rlike(rf'[」”][{WS}]*"{_END}'),
            F.regexp_replace(text, rf'"({_END})', "$1"),
        )
        .when((curly_open > curly_close) & (straight == 1), turned("”"))
        .when((curly_close > curly_open) & (straight == 1), turned("“"))
        .when(straight % 2 == 1, let(F.split(text, '"', -1), alternating))
        .otherwise(text)
    )


def _closed(text: Column, opening: str, closing: str) -> Column:
    fits = (
        (count_of(text, opening) == count_of(text, closing) + 1)
        & rstrip(text).rlike(r"[。！？…]\z")
        & (cjk_count(text) >= 2)
    )
    return F.when(
        text.contains(opening) & fits, F.regexp_replace(text, rf"(?<=[。！？…])([{WS}]*)\z", closing + "$1")
    ).otherwise(text)


def closed_quotes(text: Column) -> Column:
    """Append the closing quote of a dialogue that ends without it."""
    return let(_closed(text, "「", "」"), lambda t: _closed(t, "“", "”"))


def _whole_text(state: Column, fact: rb.Fact, changed, marks) -> Column:
    """Apply a rule that leaves texts without any of the ``marks`` alone."""

    def step(s):
        def judged(new):
            found = F.concat(s["issues"], F.array(rb.issue(fact, s["text"], new)))
            return F.when(new != s["text"], _state(s, new, found)).otherwise(s)

        return F.when(_any_of(s["text"], marks), let(changed(s["text"]), judged)).otherwise(s)

    return let(state, step)


def report_expressions(state: Column) -> Column:
    def step(s):
        found = F.regexp_extract_all(s["text"], F.lit("[！!]{3,}|[？?]{3,}"), F.lit(0))
        issues = F.concat(s["issues"], F.transform(found, lambda m: rb.issue(rb.LONG_EXPRESSION, m, m)))
        return F.when(_any_of(s["text"], "！!？?"), _state(s, s["text"], issues)).otherwise(s)

    return let(state, step)


def report_unmatched_quotes(state: Column) -> Column:
    def step(s):
        t = s["text"]
        odd = (count_of(t, "“") != count_of(t, "”")) | (count_of(t, "「") != count_of(t, "」"))
        found = F.concat(s["issues"], F.array(rb.issue(rb.UNMATCHED_QUOTES, s["raw"], s["raw"])))
        return F.when(_any_of(t, "“”「」") & odd, _state(s, t, found)).otherwise(s)

    return let(state, step)


def punctuate(paragraphs: Column) -> Column:
    """Array of ``struct<raw, text, issues>`` for an array of paragraphs, all rules in order."""

    def done(p):
        state = initial_state(p)
        for fact, needed, pattern, replacement in REWRITES:
            state = rewrite(state, fact, needed, pattern, replacement)
        state = _whole_text(state, rb.STRAIGHT_QUOTE, paired_quotes, '"')
        state = _whole_text(state, rb.UNCLOSED_QUOTE, closed_quotes, "「“")
        state = report_unmatched_quotes(report_expressions(state))
        return let(state, lambda s: F.when(s["text"].isNull(), _state(s, s["raw"], s["issues"])).otherwise(s))

    return F.transform(paragraphs, done)
