import pytest
from pyspark.sql import functions as F

from inkmill.operators.reviewing import (
    apply_decisions, change_rows, chapter_changes, matching_issue, spans,
)
from inkmill.plans.clean import clean, judge
from inkmill.plans.review import decision_log, review_judged, review_tables, reviewed_chapters

BOOK = [
    ("b", 1, "一", "他来了,又走。\n\n12\n\n没有变化\n\n好。。"),
    ("b", 2, "二", "没有变化"),
    ("b", 3, "三", "人們走"),
]
SCHEMA = "book_id string, chapter_index int, title string, text string"
CLEANED_1 = "他来了，又走。\n\n没有变化\n\n好。"


@pytest.fixture(scope="module", params=["lineage", "tables"])
def changed(spark, request):
    rows = spark.createDataFrame(BOOK, SCHEMA).repartition(2)
    if request.param == "lineage":
        return review_judged(judge(rows, mode="auto"), "auto")
    done = clean(rows, mode="auto")
    return review_tables(done.chapters, done.issues)


def texts(df):
    return {r.chapter_index: r.text for r in df.collect()}


def decide(spark, rows):
    return spark.createDataFrame([("b", c, i, ok) for c, i, ok in rows], "book_id string, chapter_index int, change_index int, accepted boolean")


def test_changes(changed):
    rows = sorted(change_rows(changed).collect(), key=lambda r: (r.chapter_index, r.change_index))
    got = [(r.chapter_index, r.change_index, r.tag, r.i1, r.i2, r.original, r.replacement, r.rule, r.default_accepted) for r in rows]
    assert got == [
        (1, 0, "replace", 0, 7, "他来了,又走。", "他来了，又走。", "ascii_comma_in_chinese", True),
        (1, 1, "delete", 9, 11, "12", "", "standalone_page_number", True),
        (1, 2, "replace", 19, 22, "好。。", "好。", "repeated_cjk_period", True),
    ]


def test_decisions(spark, changed):
    assert texts(reviewed_chapters(changed)) == {1: CLEANED_1, 2: "没有变化", 3: "人們走"}
    one = texts(reviewed_chapters(changed, decide(spark, [(1, 1, False)])))
    assert one[1] == "他来了，又走。\n\n12\n\n没有变化\n\n好。"
    none = texts(reviewed_chapters(changed, decide(spark, [(1, i, False) for i in range(3)])))
    assert none[1] == BOOK[0][3]
    log = {(r.chapter_index, r.change_index): r.accepted for r in decision_log(changed, decide(spark, [(1, 0, False)])).collect()}
    assert log == {(1, 0): False, (1, 1): True, (1, 2): True}


def test_suggestions_of_detect_mode(spark):
    rows = spark.createDataFrame([("b", 1, "一", "他来了,又走。\n\n见 abc.com 的介绍，" + "很长。" * 20)], SCHEMA)
    changed = review_judged(judge(rows, mode="detect"), "detect")
    got = sorted((r.change_index, r.tag, r.rule, r.default_accepted) for r in change_rows(changed).collect())
    assert got[0] == (0, "replace", "ascii_comma_in_chinese", True)
    assert got[1][1:] == ("delete", "url_in_text", False)
    done = texts(reviewed_chapters(changed))
    assert done[1].startswith("他来了，又走。\n\n见 abc.com")


ISSUE = (
    "array<struct<paragraph:int,category:string,confidence:string,rule:string,reason:string,original:string,"
    "replacement:string,applied:boolean>>"
)


def chapter(spark, original, cleaned, issues):
    rows = [(0, "c", conf, rule, "r", old, new, applied) for conf, rule, old, new, applied in issues]
    return spark.createDataFrame(
        [("b", 1, "t", original, cleaned, rows, None, None)],
        f"book_id string, chapter_index int, title string, original_text string, cleaned_text string, issues {ISSUE}, "
        "own array<array<int>>, lineage array<struct<tag:string,i1:int,i2:int,j1:int,j2:int,original:string,replacement:string,at:int>>",
    )


def test_leftover_and_near_suggestions(spark):
    original = "甲乙丙丁戊己庚辛。\n\n乙"
    df = chapter(spark, original, "甲乙丙丁戊己庚辛！\n\n乙", [
        ("high", "a", "。", "！", True),
        ("medium", "b", "丙丁戊己庚辛x", "完", False),
        ("low", "c", "乙", "丙", False),
        ("high", "d", "不存在的内容", "y", False),
    ])
    changed = chapter_changes(df, lineage=False)
    got = [(r.tag, r.rule, r.default_accepted) for r in change_rows(changed).orderBy("change_index").collect()]
    assert got == [("replace", "a", True), ("issue_replace", "b", False), ("issue_replace", "d", True)]
    both = decide(spark, [(1, 1, True)])
    assert apply_decisions(changed, both).first().reviewed_text == "甲乙完！\n\n乙"


def test_blocks_are_paired_in_place(spark):
    df = chapter(spark, "a\n\nb\n\nc", "x\n\nc\n\nd", [])
    rows = change_rows(chapter_changes(df, lineage=False)).orderBy("change_index").collect()
    assert [(r.tag, r.i1, r.i2, r.j1, r.j2, r.original, r.replacement) for r in rows] == [
        ("replace", 0, 1, 0, 1, "a", "x"), ("delete", 3, 4, 3, 3, "b", ""), ("insert", 7, 7, 6, 7, "", "d")
    ]
    assert all(r.category == "text_change" and r.default_accepted for r in rows)


def test_matching_prefers_applied(spark):
    df = chapter(spark, "", "", [("high", "first", "好", "", False), ("high", "second", "好人", "", True)])
    found = df.select(matching_issue(F.lit("一个好人"), F.lit(""), F.col("issues"))["rule"].alias("r")).first().r
    assert found == "second"


def test_spans_search_forward(spark):
    df = spark.createDataFrame([("甲\n\n\n甲 \n\n乙", ["甲", "甲 ", "乙"])], "t string, ps array<string>")
    got = df.select(spans(F.col("t"), F.col("ps")).alias("s")).first().s
    assert [(x.a, x.b) for x in got] == [(0, 1), (4, 6), (8, 9)]
