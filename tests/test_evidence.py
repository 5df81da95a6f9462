"""Evidence is asked for without the punctuation rules and counted in one pass over the texts."""

from pyspark.sql import functions as F

from inkmill.operators import profile
from inkmill.operators.characters import traditional_hits, wanted_grams
from inkmill.operators.punctuation import punctuate
from inkmill.functions.text import split_paragraphs
from inkmill.sources.rules import load_rules

TEXTS = [
    '他說\\"，這個,，國 ! 時\\\\"', "來,說。\n\n這裡...說——這，，國", "里里，后\n\n后", "這", "", None, "里說里。里", "abc def ghi jkl mno pqr stu 國",
    '「說\\"', "說”  \"", '國\\\\\\"說', "這-—說",
]


def chapters(spark):
    rows = [("a" if i % 2 else "b", i, t) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [("c", 99, None)], "book_id string, chapter_index long, text string")


def test_counts_are_those_of_every_single_form_and_pair(spark):
    rules = load_rules()
    simplified = set(rules.traditional.values())
    wanted = {}
    for r in chapters(spark).collect():
        c = "".join(x for x in r.text or "" if "一" <= x <= "鿿")
        told = [x for x in c if x in simplified] + [x + y for x, y in zip(c, c[1:]) if x in simplified or y in simplified]
        for gram in told:
            wanted[r.book_id, gram] = wanted.get((r.book_id, gram), 0) + 1
    totals = {r.book_id: r.simplified_ratio for r in profile.profile_totals(chapters(spark), rules.traditional).collect()}
    wanted |= {(book, ""): ratio for book, ratio in totals.items()}
    found = profile._evidence_grams(chapters(spark), rules.traditional).collect()
    assert {(r.book_id, r.gram): r.v for r in found} == wanted and len(found) == len(wanted)


def test_asked_of_the_raw_text_is_asked_of_the_punctuated_one(spark, monkeypatch):
    rules = load_rules()

    def cjk_grams(texts):
        hits = F.flatten(F.transform(texts, lambda t: traditional_hits(t, rules.traditional)))
        grams = F.flatten(F.transform(hits, wanted_grams))
        return F.array_sort(F.filter(grams, lambda g: g.rlike(r"\A[一-鿿]+\z")))

    raw = split_paragraphs(F.col("text"))
    both = chapters(spark).select(cjk_grams(raw).alias("a"), cjk_grams(F.transform(punctuate(raw), lambda s: s["text"])).alias("b"))
    rows = both.collect()
    assert any(r.a for r in rows) and all(r.a == r.b for r in rows)

    def used(_):
        raise AssertionError("the punctuation rules are not needed for the evidence")

    monkeypatch.setattr(profile, "punctuate", used)
    profile.traditional_evidence(chapters(spark), rules.traditional).collect()
