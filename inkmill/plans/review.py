"""Review pipeline: changes of cleaned chapters, decisions on them, reviewed text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.functions.arrays import arrow_lists, arrow_struct, transposed, unnest
from inkmill.operators.reviewing import (
    NEEDED, TOLD, TOLD_SQL, apply_accepted, apply_decisions, change_rows, chapter_changes, from_judged, from_tables, judged_changes,
    moved_to_decisions, with_decisions,
)
from inkmill.plans.clean import Telling, asked_chapters, cleaned_text, judging
from inkmill.sources.rules import Rules, load_rules

LOG_COLUMNS = ("tag", "original", "replacement", "category", "rule", "reason", "confidence", "default_accepted")


def review_judged(judged: DataFrame, mode: str) -> DataFrame:
    """Changes of chapters straight from :func:`inkmill.plans.clean.judge`."""
    return chapter_changes(from_judged(judged, cleaned_text(mode)), lineage=True)


def review_tables(cleaned: DataFrame, issues: DataFrame) -> DataFrame:
    """Changes of chapters from the stored result tables, by aligning the two texts."""
    return chapter_changes(from_tables(cleaned, issues), lineage=False)


def _told_changes(mode: str) -> Telling:
    def told(chapters):
        sizes, found = [], []
        for chapter in chapters:
            changes = judged_changes(chapter, mode)
            sizes.append(len(changes))
            found += changes
        return arrow_lists(sizes, arrow_struct(transposed(found, len(TOLD)), TOLD))

    return told


def review_chapters(
    chapters: DataFrame,
    rules: Rules | None = None,
    blacklist: DataFrame | None = None,
    mode: str = "detect",
    corpus: DataFrame | None = None,
) -> DataFrame:
    """``(book_id, chapter_index, title, original_text, changes)``: the changes of :func:`review_judged` over
    :func:`inkmill.plans.clean.judge`, without its paragraphs and findings passing from one to the other as rows."""
    rules = load_rules() if rules is None else rules
    ready = asked_chapters(chapters, rules, blacklist, mode, corpus)
    keep = ["book_id", "chapter_index", "title", "text"]
    return judging(ready, rules, mode, keep, _told_changes(mode), TOLD_SQL, "changes").withColumnRenamed("text", "original_text")


def only(fields: Sequence[str]) -> Column:
    """The changes with these fields; what is not asked for is not read either."""
    return F.arrays_zip(*[F.col(f"changes.{n}").alias(n) for n in fields]).alias("changes")


def decision_log(changed: DataFrame, decisions: DataFrame | None = None, told: Sequence[str] = LOG_COLUMNS) -> DataFrame:
    """Every change with the decision that holds for it, and what the log is to tell of the change."""
    slim = changed.select("book_id", "chapter_index", only(dict.fromkeys([*told, "default_accepted"])))
    decided = with_decisions(slim, decisions)
    zipped = F.arrays_zip(F.col("changes").alias("c"), F.col("accepted").alias("accepted"))
    return unnest(decided, ["book_id", "chapter_index"], zipped, "z", "change_index").select(
        "book_id", "chapter_index", "change_index", *[f"z.c.{n}" for n in told], F.col("z.accepted").alias("accepted"),
    )


def reviewed_chapters(changed: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """``(book_id, chapter_index, title, text)`` after review."""
    # What a chapter takes along to its decisions: its text, and of a change what stands where.
    chapters = changed.select("book_id", "chapter_index", "title", "original_text", only(NEEDED))
    done = apply_decisions(chapters) if decisions is None else apply_accepted(moved_to_decisions(chapters, decisions))
    return done.select("book_id", "chapter_index", "title", F.col("reviewed_text").alias("text"))


__all__ = ["change_rows", "decision_log", "only", "review_chapters", "review_judged", "review_tables", "reviewed_chapters"]
