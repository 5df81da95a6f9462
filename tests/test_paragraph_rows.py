"""Rows of paragraphs are as long as their paragraph."""

from inkmill.suite import rules


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_paragraph_rows_do_not_carry_the_list(spark):
    chapters = spark.createDataFrame([("b", 1, "a\n\nb\n\nc")], "book_id string, chapter_index int, text string")
    found = rules.paragraphs(chapters)
    generate = next(line for line in _plan(found).split("\n") if "Generate posexplode" in line)
    assert generate.count("ps#") == 1
    assert [(r.paragraph, r.n, r.raw) for r in found.collect()] == [(0, 3, "a"), (1, 3, "b"), (2, 3, "c")]
