"""Review straight from the chapters, and what decisions take along."""

import random

from pyspark.sql import functions as F

from test_chain import PIECES

from inkmill.operators.reviewing import apply_decisions, change_rows, with_decisions
from inkmill.plans.clean import judge
from inkmill.plans.review import decision_log, review_chapters, review_judged, reviewed_chapters
from inkmill.sources.rules import load_rules
from inkmill.suite import review

FIELDS = ["tag", "i1", "i2", "j1", "j2", "original", "replacement", "category", "rule", "reason", "confidence", "default_accepted"]


def chapters(spark):
    dice = random.Random(11)
    usual = [p for p in PIECES if p != "\U0001f600。"]
    texts = ["".join(dice.choices(usual, k=dice.randint(1, 40))) for _ in range(300)]
    # Left alone, with suggestions: doubtful numbers, links and quotes.
    texts += ["700\n\n没有\n\n12", "人們走", "800\n\n800\n\n见 abc.com 的介绍，" + "很长。" * 90, "  他“说\n\n 走 ", "", None]
    rows = [(f"b{i % 3}", i, "t", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "book_id string, chapter_index int, title string, text string").repartition(3)


def listed(df):
    told = F.transform("changes", lambda c: F.struct(*[c[n].alias(n) for n in FIELDS]))
    return {(r.book_id, r.chapter_index): (r.original_text, [tuple(c) for c in r.told]) for r in df.withColumn("told", told).collect()}


def test_changes_are_those_of_the_judged_chapters(spark):
    rules, rows = load_rules(), chapters(spark)
    for mode in ("auto", "detect"):
        found = listed(review_chapters(rows, rules, mode=mode))
        assert found == listed(review_judged(judge(rows, rules, mode=mode), mode))
        assert {c[0] for _, cs in found.values() for c in cs} >= {"replace", "delete", "issue_replace"}


def test_of_several_decisions_the_greatest_holds(spark):
    changed = review_chapters(spark.createDataFrame([("b", 1, "t", "他来了,又走。\n\n好。。\n\n坏，，了")], "book_id string, chapter_index int, title string, text string"), mode="auto")
    rows = [("b", 1, 0, False), ("b", 1, 0, True), ("b", 1, 0, None), ("b", 1, 1, None), ("b", 1, 2, False), ("b", 1, 2, False), ("c", 1, 0, False), (None, 1, 0, False)]
    decisions = spark.createDataFrame(rows, "book_id string, chapter_index int, change_index int, accepted boolean")
    assert with_decisions(changed, decisions).first().accepted == [True, True, False]
    log = decision_log(changed, decisions, told=("rule",)).orderBy("change_index")
    assert log.columns == ["book_id", "chapter_index", "change_index", "rule", "accepted"] and [r.accepted for r in log.collect()] == [True, True, False]
    assert reviewed_chapters(changed, decisions).first().text == "他来了，又走。\n\n好。\n\n坏，，了"
    before, after = (df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") for df in (changed, with_decisions(changed, decisions)))
    assert after == before + 1  # decisions travel once


def test_changes_are_told_without_paragraphs_as_rows(spark, tmp_path):
    rows = [(i, f"s{i % 2}", t) for i, t in enumerate(["also real elephants", "", "halls"])]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = review.review_changes(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and "review-changes" not in plan
    assert rows.count() == change_rows(review._changed(spark, str(tmp_path))).count() > 0


def test_written_changes_leave_out_what_is_not_asked_for(spark, tmp_path):
    rows = [(i, f"s{i % 2}", t) for i, t in enumerate(["also real elephants", "", "halls"])]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    whole, bare = review._changed(spark, str(tmp_path)), review._changed(spark, str(tmp_path), texts=False)
    assert set(whole.columns) - set(bare.columns) == {"title", "original_text"}
    assert not {"j1", "j2"} & set(change_rows(whole).columns)
    assert all(f.endswith(".zstd.parquet") for f in whole.inputFiles())


def test_changes_travel_as_one_text_and_whole(spark):
    changed = review_chapters(chapters(spark), load_rules(), mode="auto").cache()
    rows = change_rows(changed)
    decisions = rows.filter("change_index % 4 < 3").select("book_id", "chapter_index", "change_index", (F.col("change_index") % 2 == 0).alias("accepted"))
    done = reviewed_chapters(changed, decisions)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join LeftOuter") :]
    assert "_lists" in join.splitlines()[1] and "arrays_zip" not in join.splitlines()[1]
    found = {(r.book_id, r.chapter_index): (r.title, r.text) for r in done.collect()}
    plain = apply_decisions(changed, decisions).collect()
    assert found == {(r.book_id, r.chapter_index): (r.title, r.reviewed_text) for r in plain} and len(found) == len(plain) > 300
