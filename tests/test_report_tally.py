"""The text report from one pass over the chapters."""

from inkmill.plans.clean import chapter_issues, cleaned_chapters, judge, tallied
from inkmill.sources.rules import load_rules
from inkmill.sources.sinks import report_lines


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_report_lines_judge_once(spark):
    text = "他说，，好。\n\n第一。。\n\n12\n\n正文�這"
    rows = [("a", 1, text), ("a", 2, None), ("b", 1, "好")]
    chapters = spark.createDataFrame(rows, "book_id string, chapter_index int, text string")
    judged = judge(chapters, load_rules(), mode="auto")
    once = tallied(judged, "auto")
    plain = report_lines(cleaned_chapters(judged, "auto"), chapter_issues(judged), "auto")
    lines = report_lines(once.chapters, once.issues, "auto")
    assert sorted(map(tuple, lines.collect())) == sorted(map(tuple, plain.collect()))
    assert "transform" not in _plan(lines)
