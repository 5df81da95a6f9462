import hashlib
import html
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkmill.functions import numerals, text, urls


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


TEXTS = st.lists(
    st.text(alphabet="a中文，。 \n\t　\x1c \"&;<>l1_é½🙂", max_size=40), min_size=20, max_size=20
)


@settings(max_examples=3, deadline=None)
@given(TEXTS)
def test_scalars_agree_with_python(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").repartition(3)
    c = F.col("t")
    rows = df.select(
        "t", text.strip(c).alias("strip"), text.content_hash(c).alias("hash"),
        text.split_paragraphs(c).alias("ps"), text.ngrams(c).alias("grams"), text.normalize_match_text(c).alias("norm"),
    ).collect()
    for r in rows:
        assert r.strip == r.t.strip()
        assert r.hash == hashlib.sha256("".join(r.t.split()).encode()).hexdigest()
        assert r.ps == (re.split(r"\n\s*\n+", r.t.strip()) if r.t.strip() else [])
        size = len(r.t)
        expected = {r.t[i : i + 3] for i in range(size - 2)} if size >= 3 else ({r.t} if r.t else set())
        assert set(r.grams) == expected and len(r.grams) == len(expected)
        plain = re.sub(r"<[^>]+>", "", html.unescape(r.t))
        assert r.norm == re.sub(r"[\W_]+", "", plain).lower()


@pytest.mark.parametrize(
    "title, number",
    [("第一千五百八十九章 x", 1589), (" 第 12 章", 12), ("第两百零三章", 203), ("第十章", 10), ("第一万亿章", 10000),
     ("楔子", None), ("第3节", None)],
)
def test_chapter_number(spark, title, number):
    assert one(spark, numerals.parse_chapter_number(F.col("t")), t=title) == number


def test_urls(spark):
    u = F.col("u")
    assert one(spark, urls.make_page_url(u, 3), u="http://a.b/c?x=1&page=2#f") == "http://a.b/c?x=1&page=3#f"
    assert one(spark, urls.make_page_url(u, 1), u="http://a.b/c?page=2") == "http://a.b/c"
    assert one(spark, urls.url_join(u, F.col("h")), u="http://a.b/x/y.html", h="../z.html") == "http://a.b/z.html"
    assert one(spark, urls.url_join(u, F.col("h")), u="http://a.b/x/", h="/q") == "http://a.b/q"
    assert one(spark, urls.extract_url(u), u="见 https://a.b/c/。好") == "https://a.b/c/"
    assert one(spark, urls.numbered_file_page(urls.numbered_file_base(u), F.lit(2)), u="http://a.b/1/2_7.html") == "http://a.b/1/2_2.html"
    with pytest.raises(ValueError):
        urls.make_page_url(u, 0)


def test_names_and_headings(spark):
    t = F.col("t")
    assert one(spark, text.safe_filename(t), t='a<b>:"c" . ') == "a_b___c_"
    assert one(spark, text.safe_filename(t), t="con") == "_con"
    assert one(spark, text.safe_filename(t, "novel"), t=" . ") == "novel"
    assert one(spark, text.strip_page_marker(t), t="标题  (第1/2页)") == "标题"
    assert one(spark, text.strip_leading_heading(t), t="\n第 十 章 名\n\n正文") == "正文"
    assert one(spark, text.strip_leading_heading(t), t="第十章之后\n正文") == "第十章之后\n正文"
