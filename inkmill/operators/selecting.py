"""Choice of chapters: range, limit, order, resume and known duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.operators.keyed import lookup_by_key, with_position


def chapter_bounds(chapters: DataFrame) -> DataFrame:
    """Per book: number of chapters, first and last chapter number."""
    return chapters.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("chapter_count"),
        F.min("number").alias("first_number"),
        F.max("number").alias("last_number"),
    )


def range_spans(chapters: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Per book the index span a range selects, or why it selects nothing.

    Books with numbered chapters go by number; the span then also covers the unnumbered chapters in
    between. Other books go by position (columns ``by_number``, ``low``, ``high``).
    """
    low = F.lit(start).cast("bigint")
    high = F.lit(end).cast("bigint")
    bounds = chapter_bounds(chapters)
    wanted = bounds.select(
        "book_id",
        "chapter_count",
        F.col("first_number").isNotNull().alias("by_number"),
        # A position of zero counts as not given.
        F.when(F.col("first_number").isNotNull(), F.coalesce(low, F.col("first_number")))
        .otherwise(F.coalesce(F.nullif(low, F.lit(0)), F.lit(1)))
        .alias("low"),
        F.when(F.col("first_number").isNotNull(), F.coalesce(high, F.col("last_number")))
        .otherwise(F.coalesce(F.nullif(high, F.lit(0)), F.col("chapter_count")))
        .alias("high"),
    )
    hit = F.col("number").between(F.col("low"), F.col("high"))
    # Bounds are one row per book and chapters only ship index and number here.
    placed = lookup_by_key(
        chapters.select("book_id", "chapter_index", "number"),
        wanted.select("book_id", "by_number", "low", "high"),
        ["book_id"],
    )
    spans = placed.groupBy("book_id").agg(
        F.min(F.when(hit, F.col("chapter_index"))).alias("first_index"),
        F.max(F.when(hit, F.col("chapter_index"))).alias("last_index"),
    )
    error = (
        F.when(F.col("low") < 1, F.lit("start must be at least 1"))
        .when(F.col("high") < F.col("low"), F.lit("end lies before start"))
        .when(F.col("by_number") & F.col("first_index").isNull(), F.lit("no chapter in range"))
        .when(~F.col("by_number") & (F.col("low") > F.col("chapter_count")), F.lit("start lies behind the last chapter"))
    )
    return wanted.join(spans, "book_id").withColumn("selection_error", error)


def select_range(chapters: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Chapters of the range; books whose range is in error keep none (see :func:`range_spans`)."""
    if start is None and end is None:
        return chapters
    spans = range_spans(chapters, start, end).filter("selection_error is null")
    answers = spans.select("book_id", "by_number", "low", "high", "first_index", "last_index")
    numbered = with_position(chapters, ["book_id"], F.col("chapter_index"), "_position")
    placed = lookup_by_key(numbered, answers, ["book_id"])
    chosen = F.when(
        F.col("by_number"), F.col("chapter_index").between(F.col("first_index"), F.col("last_index"))
    ).otherwise(F.col("_position").between(F.col("low"), F.col("high")))
    return placed.filter(chosen).select(*chapters.columns)


def limit_chapters(chapters: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` chapters of each book; a negative limit keeps none."""
    if n is None:
        return chapters
    numbered = with_position(chapters, ["book_id"], F.col("chapter_index"), "_position")
    return numbered.filter(F.col("_position") <= max(0, n)).drop("_position")


def with_process_order(chapters: DataFrame, reverse: bool = False) -> DataFrame:
    """Order in which repeated chapters compete; reversed, the last one wins."""
    order = -F.col("chapter_index") if reverse else F.col("chapter_index")
    return chapters.withColumn("process_order", order.cast("bigint"))


def with_resume_status(
    chapters: DataFrame, state: DataFrame, force: bool = False, deduplicate: bool = True
) -> DataFrame:
    """Add ``status``: ``duplicate`` (known as one), ``skipped`` (done and stored) or ``pending``.

    ``state(book_id, url, status, stored)`` has one row per chapter, so the join has no hot key.
    """
    known = state.select("book_id", "url", F.col("status").alias("_status"), F.col("stored").alias("_stored"))
    done = (F.col("_status") == "completed") & F.coalesce(F.col("_stored"), F.lit(False))
    status = F.lit("pending")
    if not force:
        status = F.when(done, F.lit("skipped")).otherwise(status)
    if deduplicate:
        status = F.when(F.col("_status") == "duplicate", F.lit("duplicate")).otherwise(status)
    return chapters.join(known, ["book_id", "url"], "left").withColumn("status", status).drop("_status", "_stored")


def single_chapter(chapters: DataFrame, requests: DataFrame, titles: DataFrame) -> DataFrame:
    """Chapter of each requested URL, a trailing slash aside.

    ``requests(book_id, url)``; a URL that is in no catalog becomes chapter 1 under the title of its
    page (``titles(url, title)``), or 单章 without one.
    """
    bare = F.rtrim("url", F.lit("/"))
    listed = (
        chapters.withColumn("_url", bare)
        .groupBy("book_id", "_url")
        .agg(F.min_by(F.struct("chapter_index", "title", "url", "number"), "chapter_index").alias("c"))
    )
    asked = requests.withColumn("_url", bare).join(listed, ["book_id", "_url"], "left")
    named = asked.join(titles.select("url", F.col("title").alias("_page_title")), "url", "left")
    own = F.coalesce(F.nullif(F.col("_page_title"), F.lit("")), F.lit("单章"))
    return named.select(
        "book_id",
        F.coalesce("c.chapter_index", F.lit(1)).alias("chapter_index"),
        F.coalesce("c.title", own).alias("title"),
        F.coalesce("c.url", F.col("url")).alias("url"),
        F.col("c.number").alias("number"),
    )
