"""The rule chain in one pass gives what the rules give one by one as column expressions."""

import random

import pytest
from pyspark.sql import functions as F

from inkmill.functions.text import let, split_paragraphs
from inkmill.operators import rulebook as rb
from inkmill.operators.ads import ad_issue
from inkmill.operators.chain import Chain, split
from inkmill.operators.characters import damaged_issues, repair, traditional_hits, traditional_issue
from inkmill.operators.punctuation import punctuate
from inkmill.operators.residue import residue_issue
from inkmill.plans.clean import clean, judge
from inkmill.sources.rules import load_rules, make_rules

RULES = load_rules()
SHORT = make_rules({"soft_cues": ["群", "免费", "abc"], "strong_phrases": ["关注.{0,3}公众号", "x*"]}, ["白名单"], {"國": "国", "，": ","})
PIECES = [
    "国", "说", "国说", "國", "說", "里", "后", "字字", " ", "　", " ", "\n", "\n\n", "\n \n", "\t", "\x85", "\x1c", ",", "，", "，，", "。", "。。", ".", "...", "…",
    "?", "？", "!", "！！！", "???", '"', '\\"', "\\\\", "“", "”", "「", "」", "—", "-", "–-", "12", "7", "123", "١", "'", "​", "�", "\x00", "\x0b",
    "abc", "abcdefghij klmnopqrst uvwxyz", "www.", "http://a.cn/x", "a@b.cn", "ä@é.x", "abc.com", "\ue000", "\ue001", "公众号", "关注", "免费", "群", "白名单", "请收藏本站", "é", "\U0001f600。",
]
EVIDENCE = [{}, {"": 0.999, "国": 9.0}, {"国": 2.0, "国说": 1.0, "说国": 3.0, "": 0.5}, {"国": 1.0, "国说": 4.0, "说": 6.0, "里说": 1.0, "": 0.996}]


def texts(n, seed):
    dice = random.Random(seed)
    return ["".join(dice.choices(PIECES, k=dice.randint(1, 40))) for _ in range(n)]


def one_by_one(paragraphs, evidence, rules, mode):
    """Paragraphs judged by the column expressions of the single rules."""
    auto, none = F.lit(mode == "auto"), rb.no_issues()

    def applied(f):
        return auto & rb.may_apply(f)

    def judged(s):
        residue, ad = residue_issue(s["raw"], F.size(paragraphs)), ad_issue(s["raw"], rules)
        old = F.transform(traditional_hits(s["text"], rules.traditional), lambda h: traditional_issue(h, evidence))
        found = F.concat(damaged_issues(s["text"]), old)

        def listed(x):
            some = [F.when(x[n].isNull(), none).otherwise(F.array(x[n])) for n in ("residue", "ad")]
            gone = [x[n].isNotNull() & F.coalesce(applied(x[n]), F.lit(False)) for n in ("residue", "ad")]
            rest = F.when(gone[1], none).otherwise(F.concat(s["issues"], x["found"]))
            issues = F.when(gone[0], some[0]).otherwise(F.concat(*some, rest))
            text = F.when(gone[0] | gone[1], "").when(auto, repair(s["text"], x["found"])).otherwise(s["raw"])
            told = F.transform(issues, lambda f: F.struct(f["fact"], f["original"], f["replacement"], applied(f)))
            return F.struct(s["raw"], text, told)

        return let(F.struct(residue.alias("residue"), ad.alias("ad"), found.alias("found")), listed)

    return F.transform(punctuate(paragraphs), judged)


@pytest.mark.parametrize("mode", ["auto", "detect"])
@pytest.mark.parametrize("rules", [RULES, SHORT], ids=["shipped", "short"])
def test_same_as_the_rules_one_by_one(spark, mode, rules):
    rows = [(i, t, EVIDENCE[i % len(EVIDENCE)]) for i, t in enumerate(texts(1500, 7))]
    frame = spark.createDataFrame(rows, "i int, t string, evidence map<string,double>").repartition(4)
    split_ = frame.withColumn("ps", split_paragraphs(F.col("t")))
    chain, seen = Chain(rules, mode), set()
    for r in split_.select("t", "evidence", "ps", one_by_one(F.col("ps"), F.col("evidence"), rules, mode).alias("j")).collect():
        assert split(r.t)[0] == r.ps
        assert all(r.t.startswith(p, at) for p, at in zip(*split(r.t), strict=True))
        if "\U0001f600" in r.t:
            continue  # the expressions cut a character beyond 16 bits in two
        c = chain.judge(r.t, r.evidence, {})
        got = [(raw, text, [tuple(f[:4]) for f in c.issues.get(i, [])]) for i, (raw, text) in enumerate(zip(c.raws, c.texts, strict=True))]
        assert got == [(x[0], x[1], [tuple(f) for f in x[2]]) for x in r.j], repr(r.t)
        seen |= {f[0] for p in got for f in p[2]}
    assert len(seen) >= 18


def test_the_two_results_tell_what_the_judged_paragraphs_hold(spark):
    rows = [("a" if i % 3 else None, i, t) for i, t in enumerate(texts(150, 3))] + [("a", 500, None), ("a", 501, "")]
    chapters = spark.createDataFrame(rows, "book_id string, chapter_index int, text string")
    for mode in ("auto", "detect"):
        done, judged = clean(chapters, RULES, mode=mode), judge(chapters, RULES, mode=mode).collect()
        listed = sorted(
            (str(r.book_id), str(r.chapter_index), i, k, f.original, f.replacement, f.applied)
            for r in judged for i, p in enumerate(r.paragraphs) for k, f in enumerate(p.issues)
        )
        issues = [(str(r.book_id), str(r.chapter_index), r.paragraph, r.seq, r.original, r.replacement, r.applied) for r in done.issues.collect()]
        assert sorted(issues) == listed and len(listed) > 300
        applied = sorted((str(r.chapter_index), sum(f.applied for p in r.paragraphs for f in p.issues)) for r in judged)
        assert sorted((str(r.chapter_index), r.applied_count) for r in done.chapters.collect()) == applied


def test_a_chapter_is_not_judged_by_a_chain_of_lambdas(spark):
    chapters = spark.createDataFrame([("a", 1, "这,国")], "book_id string, chapter_index int, text string")
    for df in clean(chapters, RULES, mode="auto"):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "transform(" not in plan and "lambdafunction" not in plan
