"""Chapter files and landed pages as tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Index of files whose name carries none; they come after all others.
NO_INDEX = 10**9
_NAME = r"(?s)\A(\p{Nd}+)[_-](.+)\z"


def file_index(stem: Column) -> Column:
    from inkmill.functions.text import ascii_digits

    return F.coalesce(ascii_digits(F.regexp_extract(stem, _NAME, 1)).try_cast("bigint"), F.lit(NO_INDEX).cast("bigint"))


def file_title(stem: Column) -> Column:
    return F.when(stem.rlike(_NAME), F.regexp_extract(stem, _NAME, 2)).otherwise(stem)


def read_chapter_files(spark: SparkSession, root: str) -> DataFrame:
    """``chapters(book_id, chapter_index, title, source_path, text)`` of ``<root>/<book>/chapters/*.txt``."""
    try:
        files = spark.read.text(f"{root}/*/chapters/*.txt", wholetext=True)
    except AnalysisException as error:
        raise FileNotFoundError(f"no chapter files under {root}") from error
    path = F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    parts = F.split(path, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.txt\z", "")
    return files.select(
        F.element_at(parts, -3).alias("book_id"),
        file_index(stem).alias("chapter_index"),
        file_title(stem).alias("title"),
        path.alias("source_path"),
        F.col("value").alias("text"),
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages ``(page_id, url, html)``; rows without a URL are dropped."""
    return spark.read.schema("page_id bigint, url string, html string").parquet(path).filter("url is not null")
