"""Web residue: paragraphs that are only page numbers, quotes or escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkmill.functions.text import WS, ascii_digits, let, strip
from inkmill.operators.rulebook import (
    EMPTY_DIALOGUE, ISOLATED_ESCAPE, PAGE_NUMBER, PAGE_NUMBER_WEAK, issue,
)

# Residue consists of these characters only, which few paragraphs do.
_ONLY = rf"""\A[\p{{Nd}}{WS}\\"'「」“”….]+\z"""
_EDGE = rf"""[{WS}\\"']*"""
_NUMBER = rf"\A{_EDGE}(\p{{Nd}}{{1,4}}){_EDGE}\z"
_DIALOGUE = rf"""\A[{WS}「」“”"'….]+\z"""
_ESCAPES = rf"""\A[{WS}\\"']+\z"""


def residue_issue(paragraph: Column, paragraph_count: Column) -> Column:
    """Finding for a residue paragraph, null for any other."""

    def judged(p):
        number = ascii_digits(F.regexp_extract(p, _NUMBER, 1)).try_cast("int")
        return (
            F.when(F.length(p) == 0, F.lit(None))
            .when(
                p.rlike(_NUMBER),
                F.when((number <= 99) & (paragraph_count >= 3), issue(PAGE_NUMBER, p, "")).otherwise(
                    issue(PAGE_NUMBER_WEAK, p, "")
                ),
            )
            .when(p.contains("…") & p.rlike(_DIALOGUE), issue(EMPTY_DIALOGUE, p, ""))
            .when(p.rlike(r"""[\\"']""") & p.rlike(_ESCAPES), issue(ISOLATED_ESCAPE, p, ""))
        )

    return F.when(paragraph.rlike(_ONLY), let(strip(paragraph), judged))
