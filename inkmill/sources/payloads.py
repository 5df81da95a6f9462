"""Landed JSON answers of sites that serve books as data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.functions.numerals import parse_chapter_number
from inkmill.functions.text import strip, strip_leading_heading
from inkmill.functions.urls import origin
from inkmill.sources.sites import book_id

_BOOK = "struct<id:string,title:string,author:string,intro:string>"
_CHAPTER = "struct<id:bigint,chapterid:bigint,title:string,chaptername:string,txt:string>"
_CONTENT = "struct<status:int,message:string,data:struct<content:string>>"


def _text(c):
    return strip(F.coalesce(c, F.lit("")))


def books_from_json(payloads: DataFrame) -> DataFrame:
    """Books of ``(source_url, book_json)``; a book without a title is an error row."""
    b = F.from_json("book_json", _BOOK)
    number = book_id(F.col("source_url"))
    url = F.concat(origin(F.col("source_url")), F.lit("/#/book/"), number, F.lit("/"))
    found = payloads.select(
        url.alias("book_id"), _text(b["title"]).alias("title"), _text(b["author"]).alias("author"),
        _text(b["intro"]).alias("description"), url.alias("source_url"), number.alias("_n"),
    )
    error = F.when(F.col("_n") == "", F.lit("no book id")).when(F.col("title") == "", F.lit("no book title"))
    return found.withColumn("error", error).drop("_n")


def chapters_from_json(payloads: DataFrame) -> DataFrame:
    """Catalog of ``(source_url, list_json)``: the index is the place in the list, blank names keep theirs."""
    names = F.from_json("list_json", "struct<list:array<string>>")["list"]
    number = book_id(F.col("source_url"))
    base = F.concat(origin(F.col("source_url")), F.lit("/#/book/"), number, F.lit("/"))
    listed = payloads.select(base.alias("book_id"), F.posexplode(names).alias("at", "name"))
    index = (F.col("at") + 1).cast("int")
    title = _text(F.col("name"))
    return listed.filter(title != "").select(
        "book_id",
        index.alias("chapter_index"),
        title.alias("title"),
        F.concat("book_id", index.cast("string"), F.lit(".html")).alias("url"),
        parse_chapter_number(title).alias("number"),
    )


def texts_from_json(payloads: DataFrame) -> DataFrame:
    """Chapter texts of ``(url, chapter_json)``."""
    text = _text(F.from_json("chapter_json", _CHAPTER)["txt"])
    return payloads.select(
        "url", F.when(text != "", text).alias("text"), F.when(text == "", F.lit("no chapter text")).alias("error")
    )


def contents_from_json(payloads: DataFrame) -> DataFrame:
    """Chapter fragments of ``(url, json)``: a status other than 1 or empty content is an error row."""
    p = F.from_json("json", _CONTENT)
    content = F.coalesce(p["data"]["content"], F.lit(""))
    said = F.coalesce(F.nullif(p["message"], F.lit("")), F.lit("未知错误"))
    error = F.when(
        F.coalesce(p["status"], F.lit(0)) != 1, F.concat(F.lit("正文接口返回失败："), said)
    ).when(content == "", F.lit("正文接口没有返回内容"))
    return payloads.select("url", F.when(error.isNull(), content).alias("html"), error.alias("error"))


def content_texts(payloads: DataFrame) -> DataFrame:
    """Readable chapter texts of such fragments; failures stay rows."""
    from inkmill.operators.elements import fragment_text, with_elements

    # The fragment becomes the inside of one element.
    wrapped = contents_from_json(payloads).withColumn("html", F.concat(F.lit("<body>"), "html", F.lit("</body>")))
    parsed = with_elements(wrapped)
    text = strip_leading_heading(fragment_text(F.col("flat"), F.get("nodes", F.lit(0))))
    error = F.coalesce("error", F.when(F.coalesce(text, F.lit("")) == "", F.lit("empty content")))
    return parsed.select("url", F.when(error.isNull(), text).alias("text"), error.alias("error"))
