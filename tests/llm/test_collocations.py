import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from inkmill.llm import collocations as co


def brute(rows, at_least, first=2000):
    """Rows (text, lang) to the ranked phrases, by counting everything."""
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            ws = re.findall("[^ \t]+", piece)
            total[lang] += len(ws)
            for m in range(1, 6):
                for i in range(len(ws) - m + 1):
                    f[lang, tuple(ws[i : i + m])] += 1
    often = {k: n for k, n in f.items() if n >= at_least}
    out = {}
    for (lang, p), a in often.items():
        if len(p) < 2:
            continue
        inside = any(
            x == lang and len(q) > len(p) and n >= a and any(q[i : i + len(p)] == p for i in range(len(q)))
            for (x, q), n in often.items()
        )
        if inside:
            continue
        scores = []
        for k in range(1, len(p)):
            left, right = f[lang, p[:k]], f[lang, p[k:]]
            scores.append((1000 * a * total[lang] // (left * right), k, left, right))
        score, _, left, right = min(scores)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    listed = []
    for lang, found in out.items():
        for i, (score, a, p, left, right) in enumerate(sorted(found)[:first]):
            listed.append((lang, i + 1, p.decode(), -a, left, right, total[lang], -score))
    return sorted(listed)


def corpus(rng, n, words):
    return [
        (
            "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "! "]) for _ in range(rng.randint(0, 60))),
            rng.choice(["en", "en", "fr", None]),
        )
        for _ in range(n)
    ]


EDGES = [("", "en"), (None, "en"), ("...", "fr"), ("a b", None), ("A B c É é", "en"), ("x\x00y x\x00y", "en"), (" \t ", "fr")]


@pytest.mark.parametrize("settings", [{}, {"HELD": 50, "SHARDS": 3, "TEXT_BYTES": 300, "BUCKET_BYTES": 100}])
def test_brute_force(spark, monkeypatch, settings):
    """Whole results, also where tasks put out their counters again and again and all stripes are dealt out."""
    for name, value in settings.items():
        monkeypatch.setattr(co, name, value)
    rng = random.Random(len(settings))
    rows = corpus(rng, 150, ["the", "The", "of", "é", "new", "york", "state", "a", "x-y", " "]) + EDGES
    rows += [("in new york city today", "en")] * 9 + [("alpha beta gamma delta epsilon zeta", "fr")] * 7
    docs = spark.createDataFrame([(*r, "p") for r in rows], "text string, lang string, prefix string").repartition(5)
    got = co.collocations(docs, at_least=5, hot=20 if settings else 100_000)
    want = brute(rows, 5)
    assert len(want) > 40 and any(r[2] == "alpha beta gamma delta epsilon" for r in want)
    assert sorted(map(tuple, got.collect())) == want
    assert sorted(map(tuple, co.collocations(docs, first=3, at_least=5).collect())) == brute(rows, 5, 3)


def test_prefix_totals(spark):
    """The rows of a prefix add up to what it occurs, whatever follows it."""
    rows = corpus(random.Random(9), 80, ["a", "b", "c", "rare1", "d"]) + [(f"a only{i}", "en") for i in range(30)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    found = co.phrases(docs, at_least=4).collect()
    counts = {(r.lang, bytes(r.prefix) + b" " * (r.words > 1) + bytes(r.next)): r.n for r in found if r.hash is not None}
    totals = Counter()
    for r in found:
        if r.words > 1:
            totals[r.lang, bytes(r.prefix)] += r.n
    assert totals and all(counts[k] == n for k, n in totals.items())


def test_hot_stripe_is_dealt_out(spark):
    """A prefix with very many next words comes in shards, not as one row."""
    docs = spark.createDataFrame([(" ".join(f"the w{i}" for i in range(5000)) + " ", "en")] * 3, "text string, lang string")
    hot = spark.sparkContext.broadcast(b"\xff" * (co._BITS // 8))
    texts = docs.repartition(1).selectExpr("lang", "cast(text AS binary) AS _text")
    blocks = co.stripes(texts, 2, 100, hot, hot).collect()
    rows = [e for r in blocks for e in co.unpacked(r.bucket, pa.scalar(bytes(r.stripes), pa.binary())).to_pylist()]
    assert len({r["bucket"] for r in rows}) > 20
    sizes = list(Counter(r["shard"] for r in rows if r["prefix"] == b"the").values())
    assert len(sizes) == co.SHARDS and max(sizes) < 5 * 5000 / co.SHARDS


def test_empty_and_large_numbers(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert co.collocations(none).count() == 0
    long = spark.createDataFrame([("ab cd " * 300_000, "en")], "text string, lang string")
    got = co.collocations(long).collect()
    assert [r.phrase for r in got if r.rank == 1] and all(r.n == 600_000 for r in got)
