"""Alike texts meet entries block by block, without a row for every token they share."""

import difflib
import random

import numpy as np
from pyspark.sql import functions as F

from inkmill.operators import blacklist as bl


def texts(rng, n, least, most):
    return ["".join(rng.choice("abcdeèñ字😀") for _ in range(rng.randint(least, most))) for _ in range(n)]


def changed(rng, text):
    chars = list(text)
    for _ in range(rng.randint(0, len(chars) // 3)):
        at = rng.randrange(len(chars))
        chars[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
    return "".join(chars)


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row, old = [0], row
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(row[j], old[j + 1]))
    return row[-1]


def test_block_bounds_are_exact():
    rng = random.Random(3)
    entries = texts(rng, 12, 10, 150) + ["a" * 64, "ab" * 64]
    block = bl._Block(list(range(len(entries))), entries, True)
    at = {int(o): i for i, o in enumerate(block.ordinals)}
    for text in [changed(rng, e) for e in entries * 3] + ["z" * 30, "字" * 12]:
        chosen, most = block._subsequences(bl._codes(text))
        for o, e in enumerate(entries):
            if at[o] in chosen:
                assert subsequence(text, e) == most[list(chosen).index(at[o])]
            elif len(text) >= 10:
                assert 2 * subsequence(text, e) < bl.LIMIT * (len(text) + len(e))
        grams = np.array([len({text[i : i + 3] for i in range(len(text) - 2)} & {e[i : i + 3] for i in range(len(e) - 2)}) for e in entries])
        if len(text) >= 3:
            assert (block._shared_grams(bl._trigrams(bl._codes(text)))[[at[o] for o in range(len(entries))]] == grams).all()


def test_every_alike_pair_from_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(bl, "_BLOCK", 200)
    rng = random.Random(5)
    listed = texts(rng, 20, 8, 90)
    offered = sorted({changed(rng, e) for e in listed * 6} | {"短"})
    entries = spark.createDataFrame(list(enumerate(listed)), "ordinal int, norm string")
    norms = spark.createDataFrame([(t,) for t in offered], "norm string").repartition(3)
    got = [tuple(r) for r in bl.alike_pairs(norms, entries).collect()]
    assert len(got) == len(set(got))
    grams = lambda x: {x[i : i + 3] for i in range(len(x) - 2)}

    def alike(p, e):
        if min(len(p), len(e)) < 10 or min(len(p), len(e)) / max(len(p), len(e)) < 0.35:
            return False
        ratio = difflib.SequenceMatcher(None, p, e, autojunk=False).ratio()
        return max(ratio, 2 * len(grams(p) & grams(e)) / (len(grams(p)) + len(grams(e)))) >= 0.78

    expected = {(p, i) for p in offered for i, e in enumerate(listed) if alike(p, e)}
    assert len(expected) > 30 and expected <= set(got)


def test_no_row_for_shared_characters(spark, monkeypatch):
    asked = []
    signatures = bl._signatures
    monkeypatch.setattr(bl, "_signatures", lambda *given: asked.append(signatures(*given)) or asked[-1])
    entry = "abcdefghijklmnopqrstuvwxyz0123456789"
    entries = spark.createDataFrame([(1, entry)], "ordinal int, norm string")
    norms = spark.createDataFrame([("abcdeXfghijYklmnoZpqrstWuvwxyV012346789",), (entry[::-1],)], "norm string")
    assert [r.norm[5] for r in bl.candidate_pairs(norms, entries).collect()] == ["X"]
    assert {r.kind for rows in asked for r in rows.select(F.col("kind")).collect()} <= {bl.WITHIN, bl.AROUND}
