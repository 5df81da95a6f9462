"""Advertisement paragraphs: blacklist hits, promotion phrases, promotional links, soft cues."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkmill.functions.text import WS, let, python_regex, strip
from inkmill.operators.rulebook import (
    BLACKLIST_HIGH, BLACKLIST_MEDIUM, PROMO_URL, SOFT_CUES, STRONG_PHRASE, URL_IN_TEXT, issue,
)
from inkmill.sources.rules import Rules

_AROUND_LINKS = rf"""[{WS}，。！？；：、（）()【】\[\]<>《》"']+"""


def contains_any(text: Column, terms: list[str]) -> Column:
    return reduce(or_, [text.contains(t) for t in terms if t], F.lit(False))


def links(text: Column, rules: Rules) -> Column:
    """Every hit of the URL pattern, then every hit of the domain pattern."""
    found = [
        F.regexp_extract_all(text, F.lit(python_regex(p)), F.lit(0))
        for p in (rules.url_pattern, rules.domain_pattern)
        if p
    ]
    return F.concat(*found) if found else F.array().cast("array<string>")


def mostly_link(text: Column, hits: Column) -> Column:
    rest = F.aggregate(hits, text, lambda acc, hit: F.replace(acc, hit, F.lit("")))
    return F.length(F.regexp_replace(rest, _AROUND_LINKS, "")) <= 8


def strong_phrase(text: Column, rules: Rules) -> Column:
    """Text matched by the first pattern (in list order) that hits, else null."""
    hits = [F.regexp_extract(text, python_regex(p), 0) for p in rules.strong_phrases]
    tests = [text.rlike(python_regex(p)) for p in rules.strong_phrases]
    return F.coalesce(F.lit(None).cast("string"), *[F.when(t, h) for t, h in zip(tests, hits)])


def soft_cue_count(text: Column, rules: Rules) -> Column:
    return reduce(
        lambda a, b: a + b, [text.contains(c).cast("int") for c in rules.soft_cues if c], F.lit(0)
    )


def _blacklist_issue(text: Column, match: Column) -> Column:
    return F.when(match["score"] >= 0.88, issue(BLACKLIST_HIGH, text, "")).otherwise(
        issue(BLACKLIST_MEDIUM, text, "")
    )


def ad_issue(paragraph: Column, rules: Rules, match: Column | None = None) -> Column:
    """Finding for an advertisement paragraph, null for any other.

    ``match`` is the paragraph's blacklist match (score, method) or null.
    """

    def linked(p):
        def judged(hits):
            pushy = contains_any(p, rules.promo_cues) | (F.size(hits) >= 2) | mostly_link(p, hits)
            return F.when(
                F.size(hits) > 0,
                F.when((F.length(p) <= 320) & pushy, issue(PROMO_URL, p, "")).otherwise(issue(URL_IN_TEXT, p, "")),
            ).when((soft_cue_count(p, rules) >= 3) & (F.length(p) <= 220), issue(SOFT_CUES, p, ""))

        return let(links(p, rules), judged)

    def judged(p):
        phrase = strong_phrase(p, rules)
        rest = F.when(
            phrase.isNotNull() & (phrase != ""), issue(STRONG_PHRASE, phrase, "")
        ).otherwise(linked(p))
        if match is not None:
            rest = F.when(match.isNotNull(), _blacklist_issue(p, match)).otherwise(rest)
        return F.when((F.length(p) == 0) | contains_any(p, rules.whitelist), F.lit(None)).otherwise(rest)

    return let(strip(paragraph), judged)
