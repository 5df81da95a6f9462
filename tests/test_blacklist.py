import difflib
import random

from pyspark.sql import functions as F

from inkmill.operators import blacklist as bl


def brute(p, entries):
    """Best entry by comparing with every one."""
    grams = lambda x: {x[i : i + 3] for i in range(len(x) - 2)}
    best = None
    if len(p) < 6:
        return None
    for ident, e in entries:
        if e in p:
            score, method = 1.0, "contains"
        elif p in e and len(p) >= len(e) * 0.65:
            score, method = len(p) / len(e), "contained"
        elif min(len(p), len(e)) < 10 or min(len(p), len(e)) / max(len(p), len(e)) < 0.35:
            continue
        else:
            dice = 2 * len(grams(p) & grams(e)) / (len(grams(p)) + len(grams(e)))
            score = max(difflib.SequenceMatcher(None, p, e, autojunk=False).ratio(), dice)
            method = "fuzzy"
        if best is None or score > best[0]:
            best = (score, method, ident)
    return best if best and best[0] >= 0.78 else None


def damaged(rng, text):
    chars = list(text)
    for _ in range(rng.randint(0, max(1, len(chars) // 4))):
        at = rng.randrange(len(chars))
        kind = rng.random()
        if kind < 0.4:
            chars[at] = rng.choice("甲乙丙丁戊")
        elif kind < 0.7 and len(chars) > 6:
            del chars[at]
        else:
            chars.insert(at, rng.choice("甲乙丙丁戊"))
    return "".join(chars)


def test_blocked_equals_brute_force(spark):
    rng = random.Random(7)
    alphabet = "甲乙丙丁戊己庚辛"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(6, 40))) for _ in range(15)]
    rows = [(str(i), t, i) for i, t in enumerate(texts)]
    entries = bl.read_entries(spark.createDataFrame(rows, "id string, text string, ordinal int"))
    paragraphs = set()
    for _ in range(400):
        base = damaged(rng, rng.choice(texts))
        cut = rng.random()
        if cut < 0.2:
            base = base[: max(6, int(len(base) * 0.7))]
        elif cut < 0.4:
            base = "前" * rng.randint(0, 9) + base + "后" * rng.randint(0, 9)
        paragraphs.add(base)
    norms = spark.createDataFrame([(p,) for p in sorted(paragraphs)], "norm string").repartition(5)
    got = {r.norm: (r.score, r.method, r.entry_id) for r in bl.best_matches(norms, entries).collect()}
    expected = {p: b for p in paragraphs if (b := brute(p, [(i, t) for i, t, _ in rows]))}
    assert len(expected) > 50 and got == expected


def test_add_and_remove(spark):
    raw = spark.createDataFrame([("", "x", 0), ("a1", " 这是一条广告内容 ", 1)], "id string, text string, ordinal int")
    entries = bl.read_entries(raw)
    assert [r.id for r in entries.collect()] == ["a1"]
    more = spark.createDataFrame(
        [("这是，一条广告内容！", 0), ("太短", 1), ("另外一条<b>新</b>广告", 2), ("另外一条新广告", 3)], "text string, ordinal int"
    ).withColumn("created_at", F.lit("now"))
    added = bl.add_entries(entries, more)
    assert {r.norm for r in added.entries.collect()} == {"这是一条广告内容", "另外一条新广告"}
    assert added.entries.count() == 2
    assert [r.text for r in added.rejected.collect()] == ["太短"]
    assert bl.remove_entry(added.entries, "a1").count() == 1


def test_matched_paragraphs(spark):
    entries = bl.read_entries(spark.createDataFrame([("e", "关注本站公众号领取福利好礼", 0)], "id string, text string, ordinal int"))
    text = "正文\n\n请关注本站，公众号领取福利好礼！\n\n关注本站公众号领取福利\n\n无关的一段文字在这里"
    chapters = spark.createDataFrame([("b", 1, text)], "book_id string, chapter_index int, text string")
    got = {r.paragraph: r.method for r in bl.paragraph_matches(chapters, entries).collect()}
    assert got == {1: "contains", 2: "contained"}
