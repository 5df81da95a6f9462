"""Cleaning of chapters: every rule of every paragraph, as issues and as cleaned text.

A chapter is judged inside its own row. Text is shuffled only for the chapters that need an answer
from elsewhere: counts of their book for traditional characters, or a blacklist match.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from inkmill.functions.arrays import arrow_lists, arrow_struct, transposed, unnest
from inkmill.functions.text import strip
from inkmill.operators import chain
from inkmill.operators import rulebook as rb
from inkmill.operators.blacklist import paragraph_matches
from inkmill.operators.chain import Chain, Chapter
from inkmill.operators.profile import BOOK, CHAPTER, asks_of, traditional_evidence
from inkmill.session import stored
from inkmill.sources.rules import Rules, load_rules

MODES = ("detect", "auto")
ISSUE_COLUMNS = [
    "book_id", "chapter_index", "paragraph", "seq", "category", "confidence", "confidence_score",
    "rule", "reason", "original", "replacement", "action", "applied",
]
_MATCH_MAP = "map<int,struct<score:double,method:string,entry_id:string>>"


class Cleaned(NamedTuple):
    chapters: DataFrame
    issues: DataFrame


SLICE = 1 << 18  # characters that are judged at a time
_WHOLE = [BOOK, CHAPTER, "title", "source_path", "text"]
_FOUND = [
    ("fact", pa.int32()), ("original", pa.string()), ("replacement", pa.string()), ("applied", pa.bool_()),
    ("score", pa.float64()), ("method", pa.string()),
]
_FOUND_SQL = "fact:int,original:string,replacement:string,applied:boolean,score:double,method:string"
_PARAGRAPHS = f"array<struct<raw:string,text:string,issues:array<struct<{_FOUND_SQL}>>>>"
_ISSUES = f"array<struct<paragraph:int,seq:int,{_FOUND_SQL}>>"
# Judged chapters one after the other, and what is made of some of them.
Judged = Iterator[Chapter]
Telling = Callable[[Judged], pa.Array]
_CHAPTER = "struct<cleaned_text:string,applied_count:int>"


def _told_paragraphs(chapters: Judged) -> pa.Array:
    sizes, raws, texts, counts, found = [], [], [], [], []
    for c in chapters:
        sizes.append(len(c.raws))
        raws += c.raws
        texts += c.texts
        own = [0] * len(c.raws)
        for i in sorted(c.issues):
            own[i] = len(c.issues[i])
            found += c.issues[i]
        counts += own
    issues = arrow_lists(counts, arrow_struct(transposed(found, len(_FOUND)), _FOUND))
    names = [("raw", pa.string()), ("text", pa.string()), ("issues", issues.type)]
    return arrow_lists(sizes, arrow_struct([raws, texts, issues], names))


def _told_issues(chapters: Judged) -> pa.Array:
    sizes, places, orders, found = [], [], [], []
    for c in chapters:
        before = len(found)
        for i in sorted(c.issues):
            own = c.issues[i]
            places += [i] * len(own)
            orders += range(len(own))
            found += own
        sizes.append(len(found) - before)
    names = [("paragraph", pa.int32()), ("seq", pa.int32()), *_FOUND]
    return arrow_lists(sizes, arrow_struct([places, orders, *transposed(found, len(_FOUND))], names))


def _told_chapters(mode: str) -> Telling:
    def told(chapters):
        texts, applied = [], []
        for c in chapters:
            texts.append(chain.cleaned_text(c, mode))
            applied.append(sum(i.applied for own in c.issues.values() for i in own))
        return arrow_struct([texts, applied], [("cleaned_text", pa.string()), ("applied_count", pa.int32())])

    return told


def judging(ready: DataFrame, rules: Rules, mode: str, keep: list[str], told: Telling, kind: str, name: str) -> DataFrame:
    """The columns ``keep`` of chapters of :func:`asked_chapters`, and what ``told`` makes of their judged paragraphs.

    Some chapters at a time go on as a batch of their own before the next are judged, as what is told of chapters, and Python's
    objects even more, take many times the space of their texts.
    """
    asked = ready.select(*keep, *[c for c in ("text", "evidence", "matches") if c not in keep])
    schema = asked.select(*keep).schema.add(name, DataType.fromDDL(kind))
    at = [asked.columns.index(c) for c in ("text", "evidence", "matches")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge_chapter = Chain(rules, mode).judge
        for batch in batches:
            texts, evidence, matches = (batch.column(i) for i in at)

            def judged(some, texts=texts, evidence=evidence, matches=matches):
                for i in some:
                    yield judge_chapter(texts[i].as_py(), dict(evidence[i].as_py() or ()), dict(matches[i].as_py() or ()))

            lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
            bounds = [0, *(np.flatnonzero(np.diff(np.cumsum(lengths) // SLICE)) + 1).tolist(), len(texts)]
            for begin, end in zip(bounds, bounds[1:]):
                gc.disable()  # findings are many and hold no cycles; looking for such is a sixth of the time
                try:
                    made = told(judged(range(begin, end)))
                finally:
                    gc.enable()
                kept = [batch.column(i).slice(begin, end - begin) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, made], names=[*keep, name])

    return asked.mapInArrow(run, schema)


def _with_evidence(chapters: DataFrame, rules: Rules, corpus: DataFrame | None) -> DataFrame:
    """Attach the evidence; only chapters with a traditional character take part in the join."""
    nothing = F.lit(None).cast("map<string,double>").alias("evidence")
    if not rules.traditional:
        return chapters.select("*", nothing)
    # A column of its own: a filter on the text would be pushed down and work out a projected text a second time.
    marked = chapters.withColumn("_asks", asks_of(rules.traditional)(F.col("text")))
    asking = marked.filter("_asks").drop("_asks")
    # Asked of all chapters: those without the character ask for nothing, and a filter would go through the texts once more.
    answers = traditional_evidence(chapters, rules.traditional, corpus)
    return (
        marked.filter("not _asks")
        .drop("_asks")
        .select("*", nothing)
        .unionByName(asking.join(answers, [BOOK, CHAPTER], "left"))
    )


def asked_chapters(
    chapters: DataFrame, rules: Rules, blacklist: DataFrame | None, mode: str, corpus: DataFrame | None
) -> DataFrame:
    """``(book_id, chapter_index, title, source_path, text, evidence, matches)``: all that a chapter is judged by."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    named = chapters
    for column in ("title", "source_path"):
        if column not in named.columns:
            named = named.withColumn(column, F.lit(None).cast("string"))
    ready = _with_evidence(named, rules, corpus).select(BOOK, CHAPTER, "title", "source_path", "text", "evidence")
    if blacklist is None:
        return ready.withColumn("matches", F.lit(None).cast(_MATCH_MAP))
    found = (
        paragraph_matches(chapters, blacklist)
        .groupBy(BOOK, CHAPTER)
        .agg(
            F.map_from_entries(F.collect_list(F.struct("paragraph", F.struct("score", "method", "entry_id"))))
            .cast(_MATCH_MAP)
            .alias("matches")
        )
    )
    return ready.join(found, [BOOK, CHAPTER], "left").select(*ready.columns, "matches")


def judge(
    chapters: DataFrame,
    rules: Rules | None = None,
    blacklist: DataFrame | None = None,
    mode: str = "detect",
    corpus: DataFrame | None = None,
) -> DataFrame:
    """One row per chapter with its judged paragraphs (column ``paragraphs``).

    Both results of :func:`clean` can be told from it; write it once when both are wanted.
    ``corpus`` gives the chapters the evidence is counted on when they differ from ``chapters``.
    """
    rules = load_rules() if rules is None else rules
    ready = asked_chapters(chapters, rules, blacklist, mode, corpus)
    return judging(ready, rules, mode, _WHOLE, _told_paragraphs, _PARAGRAPHS, "paragraphs")


def cleaned_text(mode: str) -> Column:
    """Text of a judged chapter; a chapter without a change keeps its raw text."""
    changed = F.exists("paragraphs", lambda p: p["text"] != p["raw"])
    kept = F.filter(F.transform("paragraphs", lambda p: p["text"]), lambda t: t != "")
    joined = strip(F.array_join(kept, "\n\n"))
    return F.when(F.lit(mode == "auto") & changed, joined).otherwise(F.col("text"))


def cleaned_chapters(judged: DataFrame, mode: str, more: Sequence[str] = ()) -> DataFrame:
    """Chapter table of a run, with the columns of ``judged`` named in ``more``."""
    applied = F.aggregate(
        "paragraphs",
        F.lit(0),
        lambda n, p: n + F.size(F.filter(p["issues"], lambda i: i["applied"])),
    )
    return judged.select(
        BOOK,
        CHAPTER,
        "title",
        "source_path",
        F.col("text").alias("original_text"),
        cleaned_text(mode).alias("cleaned_text"),
        applied.alias("applied_count"),
        *more,
    ).transform(_with_changed)


def _with_changed(chapters: DataFrame) -> DataFrame:
    return chapters.withColumn("changed", ~F.col("cleaned_text").eqNullSafe(F.col("original_text")))


def chapter_issues(judged: DataFrame) -> DataFrame:
    """Long issue table, one row per finding; ``seq`` is the order within the paragraph."""
    rows = unnest(judged, [BOOK, CHAPTER], "paragraphs", "p", "paragraph")
    found = unnest(rows, [BOOK, CHAPTER, "paragraph"], "p.issues", "i", "seq")
    return found.select(BOOK, CHAPTER, "paragraph", "seq", *rb.finding_columns(F.col("i")))


def tallied(judged: DataFrame, mode: str) -> Cleaned:
    """What totals ask for of both results, without texts: judged in one pass and written, then read for every total."""

    def outcomes(p):
        return F.transform(p["issues"], lambda i: F.struct(i["fact"].alias("fact"), i["applied"].alias("applied")))

    found = judged.withColumn("_found", F.flatten(F.transform("paragraphs", outcomes)))
    once = stored(cleaned_chapters(found, mode, ["_found"]).drop("original_text", "cleaned_text"), "clean-tally")
    fact = rb.fact_of(F.col("i"))
    issues = unnest(once, [BOOK, CHAPTER], "_found", "i").select(
        BOOK, CHAPTER, *[fact[n].alias(n) for n in ("category", "rule", "confidence")], F.col("i.applied").alias("applied")
    )
    return Cleaned(once.drop("_found"), issues)


def clean(
    chapters: DataFrame,
    rules: Rules | None = None,
    blacklist: DataFrame | None = None,
    mode: str = "detect",
    corpus: DataFrame | None = None,
) -> Cleaned:
    """Clean ``chapters(book_id, chapter_index, title, source_path, text)``.

    ``detect`` reports and leaves the text alone, ``auto`` carries out the high-confidence findings.
    """
    rules = load_rules() if rules is None else rules
    ready = asked_chapters(chapters, rules, blacklist, mode, corpus)
    # Each result takes along what it tells only: no raw paragraphs to the issues, no findings to the texts.
    told = judging(ready, rules, mode, _WHOLE, _told_chapters(mode), _CHAPTER, "_told").select(
        BOOK, CHAPTER, "title", "source_path", F.col("text").alias("original_text"), "_told.cleaned_text", "_told.applied_count"
    )
    listed = judging(ready, rules, mode, [BOOK, CHAPTER], _told_issues, _ISSUES, "_found")
    issues = unnest(listed, [BOOK, CHAPTER], "_found", "i").select(
        BOOK, CHAPTER, "i.paragraph", "i.seq", *rb.finding_columns(F.col("i"))
    )
    return Cleaned(_with_changed(told), issues)
