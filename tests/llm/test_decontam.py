import random

import numpy as np
import pytest

from inkmill.llm import decontam
from inkmill.llm.decontam import BITS, AGREE, Items, best_stretch, collide, leaked, normalised, repetitions, walks


def slow_stretch(item, region):
    row = [0] * (len(region) + 1)
    for i, c in enumerate(item, 1):
        old, row = row, [i]
        for j, d in enumerate(region, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != d)))
    return min(row), row.index(min(row))


def edited(rng, text, edits):
    text = list(text)
    for _ in range(edits):
        at = rng.randrange(len(text))
        kind = rng.randrange(3)
        if kind == 0:
            text[at] = rng.choice("abcdefghij ")
        elif kind == 1:
            text.insert(at, rng.choice("abcdefghij"))
        else:
            del text[at]
    return "".join(text)


@pytest.mark.parametrize("seed", range(20))
def test_stretch(seed):
    rng = random.Random(seed)
    item = "".join(rng.choices("abc", k=rng.randint(1, 90))).encode()
    region = "".join(rng.choices("abc", k=rng.randint(0, 150))).encode()
    assert best_stretch(item, region) == slow_stretch(item, region)


def test_walk_keeps_equal_texts_together():
    (one, two), filled = walks([b"some passage of a benchmark", b"some passage of a benchmark"], 81, 3)
    assert np.array_equal(one, two)
    assert (one[: filled[0]] != 0).all() and (one[filled[0] :] == 0).all()
    assert 1 - (1 - AGREE**BITS) ** repetitions(0.999) >= 0.999


LENGTHS = [(16, 19), (20, 34), (35, 80), (166, 166), (400, 400)]


def prose_of(rng, n):
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 9))) for _ in range(n)]
    return " ".join(words)[:n].strip().ljust(n, "e")


@pytest.mark.parametrize("least, most", LENGTHS)
def test_unrelated_windows_do_not_collide(least, most):
    rng = random.Random(least)
    sizes = [rng.randint(least, most) for _ in range(500)]
    windows, items = ([prose_of(rng, n).encode() for n in sizes] for _ in range(2))
    assert collide(windows, items, 0.999).mean() < 0.05
    assert collide(items, items, 0.999).all()


@pytest.mark.parametrize("least, most", LENGTHS)
def test_recall_by_length(least, most):
    """Passages with all the edits allowed, against the exact distance to the whole text."""
    rng = random.Random(most)
    items = [prose_of(rng, rng.randint(least, most)) for _ in range(200)]
    texts = [
        f"{prose_of(rng, 90)} {edited(rng, x, len(x) // 10)} {prose_of(rng, 90)}".encode() for x in items
    ]
    own = Items(list(range(200)), [x.encode() for x in items], 0.1)
    want = {i for i in range(200) if best_stretch(own.texts[i], texts[i])[0] <= own.allowed[i]}
    got = {text for text, item, _, _ in own.leaks(texts, 0.999) if text == item}
    assert len(want) > 190 and len(want & got) >= 0.99 * len(want) and got <= want


def test_only_collisions_are_verified(monkeypatch):
    """The samples decide what is compared exactly: without a collision nothing is found."""
    item = "the quick brown fox jumps over the lazy dog near the river"
    own, texts = Items([1], [item.encode()], 0.1), [f"and {item} again".encode()]
    assert [x[:3] for x in own.leaks(texts, 0.999)] == [(0, 0, 0)]
    monkeypatch.setattr(decontam, "collide", lambda windows, items, recall: np.zeros(len(windows), dtype=bool))
    assert not list(own.leaks(texts, 0.999))


def test_brute_force(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 8))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choices(words, k=n))

    items = [(i, prose(rng.randint(12, 40))) for i in range(25)]
    docs = []
    for i in range(200):
        parts = [prose(rng.randint(0, 60))]
        if i % 2:
            _, item = rng.choice(items)
            parts.append(edited(rng, item, int(rng.choice([0, 0.05, 0.09, 0.12, 0.2]) * len(item))))
        docs.append((i, " ".join([*parts, prose(rng.randint(0, 60))])))
    want = set()
    for i, text in docs:
        for k, item in items:
            edits, _ = slow_stretch(normalised(item.encode()), normalised(text.encode()))
            if edits <= int(0.1 * len(normalised(item.encode()))):
                want.add((i, k, edits))
    got = leaked(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    assert len(want) > 30
    assert {(r.doc_id, r.item_id, r.edits) for r in got} == want


def test_edges(spark):
    item = "The quick brown fox jumps over the lazy dog near the river"
    docs = [
        (1, None, "x"), (2, "", "x"), (3, "so: the QUICK  brown fox\njumps over the lazy dog near the river!", "x"),
        (3, "so: the QUICK  brown fox\njumps over the lazy dog near the river!", "x"), (None, "a " * 50_000 + item, "x"),
        (5, "say hi there", "x"), (6, "say his there", "x"),
    ]
    left = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "Hi"), (1, item)], "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id, r.edits) for r in leaked(left, items).collect())
    assert got == [("3", 1, 0)] * 4 + [("5", 4, 0)] + [("None", 1, 0)] * 2
    assert leaked(left, items.limit(0)).count() == 0
    assert leaked(left.limit(0), items).count() == 0


def test_no_items():
    assert list(Items([], [], 0.1).leaks([b"text"], 0.9)) == []
