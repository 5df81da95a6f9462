"""The rule chain goes through the paragraphs of a chapter once and looks for characters only where the chapter has them."""

import dataclasses

from pyspark.sql import functions as F

from inkmill.functions.text import let
from inkmill.operators.punctuation import punctuate
from inkmill.plans.clean import clean
from inkmill.sources.rules import load_rules


def passes(column):
    return column._jc.toString().count("transform(")


def test_paragraphs_are_gone_through_once(spark):
    assert "aggregate" in let(F.lit(1), lambda x: x + 1)._jc.toString()
    # One pass over the paragraphs, one over the finds of each of nine rewrites and of the report, one over cut quotes.
    assert passes(punctuate(F.col("ps"))) <= 12


def test_a_bound_value_may_be_null(spark):
    row = spark.range(1).select(
        let(F.lit(None).cast("string"), lambda x: F.coalesce(x, F.lit("none"))).alias("a"),
        F.transform(F.array(F.lit(1), F.lit(2)), lambda x: let(x + 1, lambda y: y * y)).alias("b"),
    ).first()
    assert (row.a, row.b) == ("none", [4, 9])


def test_characters_are_found_in_any_chapter_that_has_them(spark):
    texts = {1: "说国\u200b。\n\n这,国", 2: "國说\n\n国说", 3: "说\n\n国", 4: "國\ufffd说\n\n国说国说", 5: None}
    chapters = spark.createDataFrame([("b", i, t) for i, t in texts.items()], "book_id string, chapter_index int, text string")
    rules = load_rules()
    for given in (rules, dataclasses.replace(rules, traditional={**rules.traditional, "，": ","})):
        done = clean(chapters, given, mode="auto")
        found = {(r.chapter_index, r.paragraph, r.original) for r in done.issues.collect()}
        wanted = {(1, 0, "\u200b"), (1, 1, ","), (2, 0, "國"), (4, 0, "國"), (4, 0, "\ufffd")}
        assert found - {(1, 1, "，")} == wanted
        # The rules bring a mark that the chapter did not have: with a rule for marks, it is found.
        assert ((1, 1, "，") in found) == (given is not rules)
    cleaned = {r.chapter_index: r.cleaned_text for r in clean(chapters, rules, mode="auto").chapters.collect()}
    assert cleaned[1] == "说国。\n\n这，国" and cleaned[3] == texts[3] and cleaned[5] is None
