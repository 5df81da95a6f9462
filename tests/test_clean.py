import random

import pytest
from pyspark.sql import functions as F

from inkmill.functions.text import split_paragraphs
from inkmill.operators import rulebook as rb
from inkmill.operators.ads import ad_issue
from inkmill.operators.punctuation import punctuate
from inkmill.operators.residue import residue_issue
from inkmill.plans.clean import clean
from inkmill.sources.rules import load_rules, make_rules, merge

CASES = [
    ("他说\\\"好", "escaped_quote_artifact", "他说“好"),
    ("好--–坏", "mixed_dash_sequence", "好——坏"),
    ("好——坏", "mixed_dash_sequence", "好——坏"),
    ("好，，，坏", "repeated_cjk_comma", "好，坏"),
    ("好。。", "repeated_cjk_period", "好。"),
    ("好 , 坏,好,他", "ascii_comma_in_chinese", "好，坏，好，他"),
    ("好.", "ascii_period_in_chinese", "好。"),
    ("好?坏", "ascii_question_in_chinese", "好？坏"),
    ("好!", "ascii_exclamation_in_chinese", "好！"),
    ("好....坏", "ascii_ellipsis_in_chinese", "好……坏"),
    ("「他来了。\"", "straight_quote_in_chinese", "「他来了。」"),
    ("他说「走吧。", "unclosed_dialogue_quote", "他说「走吧。」"),
    ("好！！！", "long_repeated_expression", "好！！！"),
    ("他说“走", "unmatched_chinese_quotes", "他说“走"),
]
UNTOUCHED = [
    "This sentence, which is English, has enough letters.",
    "“Hello, world” 他说。",
    "真的？？好！！",
    "见 http://a.b/c,好",
    "\"成对\"的直引号",
]


def test_each_punctuation_rule(spark):
    rows = spark.createDataFrame([(t, r, e) for t, r, e in CASES], "t string, rule string, expected string").repartition(3)
    state = F.get(punctuate(F.array("t")), F.lit(0))
    rules = F.transform(F.col("s.issues"), lambda i: rb.fact_of(i)["rule"])
    for r in rows.withColumn("s", state).select("*", rules.alias("rules")).collect():
        assert r.s.text == r.expected, r.t
        assert r.rule in r.rules, r.t


def test_untouched_paragraphs(spark):
    rows = spark.createDataFrame([(t,) for t in UNTOUCHED], "t string")
    for r in rows.select("t", F.get(punctuate(F.array("t")), F.lit(0)).alias("s")).collect():
        assert r.s.text == r.t


@pytest.mark.parametrize(
    "paragraph, count, rule, confidence",
    [
        (" \"12\\ ", 3, "standalone_page_number", "high"),
        ("１２", 3, "standalone_page_number", "high"),
        ("120", 3, "standalone_page_number", "medium"),
        ("12", 2, "standalone_page_number", "medium"),
        ("“……”", 3, "empty_dialogue_fragment", "high"),
        ("\\\"", 3, "isolated_quote_escape", "high"),
        ("第12", 3, None, None),
    ],
)
def test_residue(spark, paragraph, count, rule, confidence):
    row = spark.createDataFrame([(paragraph,)], "t string").withColumn("i", residue_issue(F.col("t"), F.lit(count)))
    fact = rb.fact_of(F.col("i"))
    found = row.select(fact["rule"].alias("r"), fact["confidence"].alias("c")).first()
    assert (found.r, found.c) == (rule, confidence)


def test_ads(spark):
    rules = load_rules()
    cases = {
        "本章由某某站整理发布": "strong_promotion_phrase",
        "访问 www.abc.com 看书": "promotional_url",
        "他打开了 abc.com 这个页面，" + "看了很久。" * 10: "url_in_text",
        "中文abc.com相连" + "很长的一段正文" * 5: None,
        "微信网站免费看": "multiple_soft_promotion_cues",
        "他在微信网站上看到消息": None,
        "": None,
    }
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, rule string")
    fact = rb.fact_of(F.col("i"))["rule"]
    for r in rows.withColumn("i", ad_issue(F.col("t"), rules)).select("t", "rule", fact.alias("got")).collect():
        assert r.got == r.rule, r.t
    listed = make_rules({"strong_phrases": ["广告", "("]}, ["收藏"], {})
    got = rows.limit(0).unionByName(
        spark.createDataFrame([("广告收藏", None), ("广告", "strong_promotion_phrase")], "t string, rule string")
    ).withColumn("i", ad_issue(F.col("t"), listed))
    assert {r.t: r.i is not None for r in got.collect()} == {"广告收藏": False, "广告": True}


BOOK = [
    ("b", 1, "一", "本章由某站整理发布。\n\n普通正文，没有问题。\n\n他说\\\"你好\n\n12\n\n\\\n\n我們这样说--的确,如此."),
    ("b", 2, "二", "他在微信网站上看见了什么,然后走开。\n\n我们去。我们来。\n\n看​看�"),
    ("c", 1, "一", "我們没有依据。\n\n这里没有变化"),
]


def test_clean_book(spark):
    rows = spark.createDataFrame(BOOK, "book_id string, chapter_index int, title string, text string")
    results = []
    for parts in (1, 4):
        shuffled = rows.orderBy(F.rand(parts)).repartition(parts)
        done = clean(shuffled, mode="auto")
        texts = {(r.book_id, r.chapter_index): r for r in done.chapters.collect()}
        issues = sorted(tuple(r) for r in done.issues.collect())
        results.append((sorted((k, v.cleaned_text) for k, v in texts.items()), issues))
    assert results[0] == results[1]
    assert texts["b", 1].cleaned_text == "普通正文，没有问题。\n\n他说“你好\n\n我们这样说——的确，如此。"
    assert texts["b", 2].cleaned_text == "他在微信网站上看见了什么，然后走开。\n\n我们去。我们来。\n\n看看"
    assert texts["c", 1].cleaned_text == BOOK[2][3] and not texts["c", 1].changed
    applied = [i for i in done.issues.collect() if i.applied]
    assert applied and all(i.confidence == "high" for i in applied)
    assert {i.confidence_score for i in done.issues.collect() if i.book_id == "c"} == {0.35}


def test_detect_leaves_text_alone(spark):
    rows = spark.createDataFrame(BOOK, "book_id string, chapter_index int, title string, text string")
    done = clean(rows, mode="detect")
    assert done.chapters.filter("changed or cleaned_text <> original_text").count() == 0
    assert done.issues.filter("applied or action <> 'report'").count() == 0
    with pytest.raises(ValueError):
        clean(rows, mode="other")


def test_rule_files(tmp_path):
    (tmp_path / "ad_rules.json").write_text('{"promo_cues": ["只此"]}', encoding="utf-8")
    (tmp_path / "traditional_map.json").write_text('{"電": "点", "长词": "x"}', encoding="utf-8")
    (tmp_path / "whitelist.json").write_text("broken", encoding="utf-8")
    rules = load_rules(tmp_path)
    assert rules.promo_cues == ["只此"] and rules.whitelist == [] and len(rules.traditional) == 93
    assert rules.traditional["電"] == "点"
    assert merge({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}, "b": [2]}) == {"a": {"x": 1, "y": 3}, "b": [2]}


def test_split_keeps_order(spark):
    texts = ["\n\n".join(random.sample("甲乙丙丁", 4)) for _ in range(5)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.p for r in df.select(split_paragraphs(F.col("t")).alias("p")).collect()] == [t.split("\n\n") for t in texts]
