"""Damaged characters, and traditional characters judged against the book's own usage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkmill.functions.text import let, replace_first
from inkmill.operators import rulebook as rb

DAMAGED = r"[\ufffd\u200b-\u200d\ufeff\x00-\x08\x0b\x0c\x0e-\x1f]"


def damaged_issues(text: Column) -> Column:
    """One issue per damaged character, in text order."""
    found = F.regexp_extract_all(text, F.lit(DAMAGED), F.lit(0))
    return F.transform(
        found,
        lambda c: F.when(c == "\ufffd", rb.issue(rb.REPLACEMENT_CHAR, c, "")).otherwise(
            rb.issue(rb.CONTROL_CHAR, c, "")
        ),
    )


def character_class(chars) -> str:
    """Regex class of single characters.

    Java tests the members of a class one by one, so they are bundled behind ranges.
    """
    ordered = sorted(chars)
    escaped = ["\\" + c if c in r"\[]^-&" else c for c in ordered]
    bundles = [escaped[i : i + 10] for i in range(0, len(ordered), 10)]
    if len(bundles) < 3:
        return "[" + "".join(escaped) + "]"
    return "[" + "".join(f"[{b[0]}-{b[-1]}&&[{''.join(b)}]]" for b in bundles) + "]"


def traditional_hits(text: Column, traditional: dict[str, str]) -> Column:
    """Array of ``struct<ch, left, right, simplified, repeated>``, one per traditional character.

    ``left`` is a line feed at the beginning of the text and ``right`` is empty at its end.
    """
    if not traditional:
        return F.array().cast("array<struct<ch:string,left:string,right:string,simplified:string,repeated:boolean>>")
    # One pass: every hit with its neighbours as a text of two or three characters.
    around = rf"(?s)(?=(.{character_class(traditional)}(?:.|\z)))"
    old, new = "".join(traditional), "".join(traditional.values())

    def described(x):
        return F.transform(
            x["windows"],
            lambda w: let(
                F.substring(w, 2, 1),
                lambda ch: F.struct(
                    ch.alias("ch"),
                    F.substring(w, 1, 1).alias("left"),
                    F.substring(w, 3, 1).alias("right"),
                    F.translate(ch, old, new).alias("simplified"),
                    (F.size(F.array_remove(x["found"], ch)) < F.size(x["found"]) - 1).alias("repeated"),
                ),
            ),
        )

    def with_characters(windows):
        found = F.transform(windows, lambda w: F.substring(w, 2, 1))
        return let(F.struct(windows.alias("windows"), found.alias("found")), described)

    windows = F.regexp_extract_all(F.concat(F.lit("\n"), text), F.lit(around), F.lit(1))
    return let(windows, with_characters)


def wanted_grams(hit: Column) -> Column:
    """Profile entries needed to judge a hit: the simplified character and its two word forms."""
    return F.array(
        hit["simplified"], F.concat(hit["left"], hit["simplified"]), F.concat(hit["simplified"], hit["right"])
    )


def traditional_issue(hit: Column, evidence: Column) -> Column:
    """Judge one hit; ``evidence`` maps grams to their corpus counts and ``''`` to the book's ratio."""

    def seen(gram: Column) -> Column:
        return F.coalesce(F.try_element_at(evidence, gram), F.lit(0.0))

    simplified = seen(hit["simplified"])
    # At an end of the text the pair has no second CJK character and is in no profile.
    word = (seen(F.concat(hit["left"], hit["simplified"])) > 0) | (
        (hit["right"] != "") & (seen(F.concat(hit["simplified"], hit["right"])) > 0)
    )

    def told(fact):
        return rb.issue(fact, hit["ch"], hit["simplified"])

    return (
        F.when(hit["repeated"], told(rb.TRAD_REPEATED))
        .when(word & (simplified >= 2), told(rb.TRAD_EVIDENCE))
        .when((simplified >= 5) & (seen(F.lit("")) > 0.995), told(rb.TRAD_LIKELY))
        .otherwise(told(rb.TRAD_UNSURE))
    )


def repair(text: Column, issues: Column) -> Column:
    """Carry out the high-confidence character issues in order."""
    undamaged = F.regexp_replace(text, DAMAGED, "")
    changes = F.filter(issues, lambda i: rb.is_fact(i, rb.TRAD_EVIDENCE))
    return F.aggregate(changes, undamaged, lambda t, i: replace_first(t, i["original"], i["replacement"]))


