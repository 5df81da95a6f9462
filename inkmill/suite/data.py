"""The provided tables seen as chapters, and the projections that make Chinese rules fire on them.

Documents are invented Latin prose, so letters are mapped to Chinese characters and marks; the same
mapping is written in SQL for the comparison.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.session import dealt

# Letter pairs that become marks, in this order, before single letters are mapped.
MARKS = [
    ("th", "，，"), ("er", "..."), ("on", "———-"), ("re", "。。"), ("qu", "?"), ("le", '\\"'), ("an", " ! "),
    ("nt", "！！！"), ("st", "“"), ("es", "”"), ("in", "「"), ("ou", "」"), ("ch", "\u200b"), ("ux", "\ufffd"),
]
LETTERS = "abcdefghijklmnopqrstuvwxyzéèêçäöüßñáíóú"
SIMPLIFIED = "这说来时过后里个国学现对于与为发见开关还气实體靈無這問麼们将军变边儿书长門题類"
# A word as a paragraph of its own: letters of short words become digits, quotes, dots and escapes.
WORD_LETTERS = "abcdefghijklmnopqrstuvwxyz"
WORD_MARKS = '1字字字2字字“3字字"字0.字字\\…字字字字字字字'


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as chapters: the source is the book, the document number the chapter index."""
    return dealt(table(spark, sf, "documents").select("doc_id", "source", "text")).select(
        F.col("source").alias("book_id"),
        F.col("doc_id").alias("chapter_index"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("text"),
    )


def chinese(text: Column) -> Column:
    marked = reduce(lambda c, m: F.replace(c, F.lit(m[0]), F.lit(m[1])), MARKS, F.lower(text))
    return F.translate(F.replace(marked, F.lit("\n"), F.lit("\n\n")), LETTERS, SIMPLIFIED)


def chinese_chapters(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).withColumn("text", chinese(F.col("text")))


def word_chapters(spark: SparkSession, sf: str) -> DataFrame:
    """Every word a paragraph."""
    text = F.regexp_replace(F.lower("text"), "[ \n]+", "\n\n")
    return documents(spark, sf).withColumn("text", F.translate(text, WORD_LETTERS, WORD_MARKS))


def line_chapters(spark: SparkSession, sf: str) -> DataFrame:
    """Every line a paragraph, text as it is."""
    return documents(spark, sf).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


# ---- the same in SQL -------------------------------------------------------------------------

WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CJK = r"\x{4e00}-\x{9fff}"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_chinese(text: str) -> str:
    marked = reduce(lambda c, m: f"replace({c}, {quoted(m[0])}, {quoted(m[1])})", MARKS, f"lower({text})")
    return f"translate(replace({marked}, chr(10), chr(10) || chr(10)), {quoted(LETTERS)}, {quoted(SIMPLIFIED)})"


def sql_words(text: str) -> str:
    parts = rf"regexp_replace(lower({text}), '[ \n]+', chr(10) || chr(10), 'g')"
    return f"translate({parts}, {quoted(WORD_LETTERS)}, {quoted(WORD_MARKS)})"


def sql_lines(text: str) -> str:
    return f"replace({text}, chr(10), chr(10) || chr(10))"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def sql_chapters(projection) -> str:
    return (
        "chapters AS (SELECT source AS book_id, doc_id AS chapter_index, "
        "split_part(text, chr(10), 1) AS title, source || '/' || doc_id AS url, "
        f"{projection('text')} AS text FROM documents)"
    )


def sql_paragraphs(projection) -> str:
    """CTEs ``chapters`` and ``p(book_id, chapter_index, paragraph, n, raw)``."""
    return f"""{sql_chapters(projection)},
lists AS (SELECT book_id, chapter_index, string_split_regex({sql_strip('text')}, '\\n[{WS}]*\\n+') AS ps
          FROM chapters WHERE {sql_strip('text')} <> ''),
p AS (SELECT book_id, chapter_index, len(ps) AS n, unnest(ps) AS raw,
             unnest(range(len(ps))) AS paragraph FROM lists)"""


def same(text: str) -> str:
    return text
