"""Results as files: tables, texts, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.functions.text import safe_filename, strip
from inkmill.operators.assembling import book_blocks

# Columns of the issue report in their order.
REPORT_COLUMNS = [
    "chapter", "category", "confidence", "confidence_score", "rule", "reason", "original", "replacement", "action",
    "applied", "paragraph",
]


def chapter_file_name(index: Column, title: Column) -> Column:
    number = F.when(index < 10000, F.lpad(index.cast("string"), 4, "0")).otherwise(index.cast("string"))
    return F.concat(number, F.lit("_"), safe_filename(title, "chapter"), F.lit(".txt"))


def chapter_files(chapters: DataFrame) -> DataFrame:
    """``(book_id, file_name, text)`` as the chapters are to be stored: stripped, one line end at the end."""
    return chapters.select(
        "book_id",
        "chapter_index",
        chapter_file_name(F.col("chapter_index"), F.col("title")).alias("file_name"),
        F.concat(strip(F.col("text")), F.lit("\n")).alias("text"),
    )


def write_chapters(chapters: DataFrame, path: str) -> None:
    """Chapter table, a folder per book."""
    chapter_files(chapters).write.mode("overwrite").partitionBy("book_id").parquet(path)


def write_books(books: DataFrame, chapters: DataFrame, path: str, heading: str = "crawl") -> None:
    """Text of each book in its folder; the part files in name order make the book.

    Rows are dealt out by ranges of book and chapter, so a large book is written by many tasks.
    """
    blocks = book_blocks(books, chapters, heading)
    ordered = blocks.repartitionByRange("book_id", "block").sortWithinPartitions("book_id", "block")
    ordered.select("book_id", "text").write.mode("overwrite").partitionBy("book_id").text(path)


def report_chapters(chapters: DataFrame, issues: DataFrame) -> DataFrame:
    """One row per chapter with its issues nested; the issues of a chapter are a small group."""
    rest = [c for c in issues.columns if c not in ("book_id", "chapter_index")]
    nested = issues.groupBy("book_id", "chapter_index").agg(
        F.array_sort(F.collect_list(F.struct("paragraph", "seq", *[c for c in rest if c not in ("paragraph", "seq")]))).alias("issues")
    )
    listed = chapters.select("book_id", "chapter_index", "title", "source_path", "changed", "applied_count")
    return listed.join(nested, ["book_id", "chapter_index"], "left")


def report_rows(chapters: DataFrame, issues: DataFrame) -> DataFrame:
    """The issue report with its fixed columns, keys first for sorting."""
    titles = chapters.select("book_id", "chapter_index", F.col("title").alias("chapter"))
    return issues.join(titles, ["book_id", "chapter_index"]).select("book_id", "chapter_index", "seq", *REPORT_COLUMNS)


def report_lines(chapters: DataFrame, issues: DataFrame, mode: str) -> DataFrame:
    """Text summary per book as ``(book_id, place, line)``: totals, then sorted categories and confidences."""
    from inkmill.plans.report import book_summary, category_counts, confidence_counts

    totals = book_summary(chapters, issues)
    head = F.array(
        F.lit("小说内容检测报告"), F.lit("=" * 24), F.lit(f"处理模式：{mode}"),
        F.concat(F.lit("章节数量："), F.col("chapter_count").cast("string")),
        F.concat(F.lit("问题总数："), F.col("total_issues").cast("string")),
        F.concat(F.lit("自动修改："), F.col("applied_count").cast("string")),
        F.lit(""), F.lit("分类统计："),
    )

    def counted(counts: DataFrame, key: str, place: str) -> DataFrame:
        line = F.concat(F.lit("  "), F.col(key), F.lit(": "), F.col("n").cast("string"))
        return counts.select("book_id", F.concat(F.lit(place), F.col(key)).alias("place"), line.alias("line"))

    def fixed(lines: Column, place: str) -> DataFrame:
        return totals.select("book_id", F.posexplode(lines).alias("at", "line")).select(
            "book_id", F.concat(F.lit(place), F.lpad(F.col("at").cast("string"), 2, "0")).alias("place"), "line"
        )

    return (
        fixed(head, "a")
        .unionByName(counted(category_counts(issues), "category", "b"))
        .unionByName(fixed(F.array(F.lit(""), F.lit("置信度统计：")), "c"))
        .unionByName(counted(confidence_counts(issues), "confidence", "d"))
    )


def write_reports(chapters: DataFrame, issues: DataFrame, path: str, mode: str) -> None:
    """JSON report, change log, CSV report and text summary under one folder, each split by book.

    Chapters and issues are written once, as tables beside the reports, and all reports are made from those.
    """
    from inkmill.plans.report import run_summary

    spark = chapters.sparkSession
    narrow = chapters.select("book_id", "chapter_index", "title", "source_path", "changed", "applied_count")
    written = []
    for name, table in (("chapters", narrow), ("issues", issues)):
        table.write.mode("overwrite").parquet(f"{path}/{name}")
        written.append(spark.read.schema(table.schema).parquet(f"{path}/{name}"))
    chapters, issues = written
    # The summary heads the report and the change log alike.
    summary = run_summary(chapters, issues, mode)
    for name in ("clean_report_summary", "clean_log_summary"):
        summary.write.mode("overwrite").json(f"{path}/{name}")
    report_chapters(chapters, issues).write.mode("overwrite").partitionBy("book_id").json(f"{path}/clean_report_json")
    change_log(issues).write.mode("overwrite").partitionBy("book_id").json(f"{path}/clean_log_json")
    ordered = report_rows(chapters, issues).repartitionByRange("book_id", "chapter_index").sortWithinPartitions(
        "book_id", "chapter_index", "paragraph", "seq"
    )
    ordered.select("book_id", *REPORT_COLUMNS).write.mode("overwrite").partitionBy("book_id").csv(
        f"{path}/clean_report_csv", header=True, escape='"'
    )
    lines = report_lines(chapters, issues, mode).repartitionByRange("book_id", "place")
    lines.sortWithinPartitions("book_id", "place").select("book_id", "line").write.mode("overwrite").partitionBy(
        "book_id"
    ).text(f"{path}/clean_report_text")


def change_log(issues: DataFrame) -> DataFrame:
    return issues.filter("applied")


def failure_lines(report: DataFrame) -> DataFrame:
    """Failure report of each book as ``(book_id, chapter_index, line)`` blocks under a heading."""
    body = report.select(
        "book_id", F.col("chapter_index").cast("bigint").alias("chapter_index"),
        F.concat_ws("\n", "title", "url", F.concat(F.lit("失败原因："), "reason"), F.lit("")).alias("line"),
    )
    return _headed(report, body, "失败章节记录")


def duplicate_lines(report: DataFrame) -> DataFrame:
    body = report.select(
        "book_id", F.col("chapter_index").cast("bigint").alias("chapter_index"),
        F.concat_ws(
            "\n", "title", "url", F.concat(F.lit("首次出现："), "first_title"), F.concat(F.lit("首次地址："), "first_url"),
            F.concat(F.lit("正文哈希："), "digest"), F.lit(""),
        ).alias("line"),
    )
    return _headed(report, body, "重复章节记录")


def _headed(report: DataFrame, body: DataFrame, heading: str) -> DataFrame:
    head = report.select("book_id").distinct().select(
        "book_id", F.lit(-1).cast("bigint").alias("chapter_index"), F.lit(heading + "\n").alias("line")
    )
    return head.unionByName(body)


def write_lines(lines: DataFrame, path: str) -> None:
    """Text blocks of each book in catalog order."""
    ordered = lines.repartitionByRange("book_id", "chapter_index").sortWithinPartitions("book_id", "chapter_index")
    ordered.select("book_id", "line").write.mode("overwrite").partitionBy("book_id").text(path)


def write_review(books: DataFrame, reviewed: DataFrame, log: DataFrame, path: str) -> None:
    """Reviewed chapters, reviewed books and the decisions."""
    write_chapters(reviewed, f"{path}/chapters")
    write_books(books, reviewed, f"{path}/books", "reviewed")
    log.write.mode("overwrite").partitionBy("book_id").json(f"{path}/decisions_json")
