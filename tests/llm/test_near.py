import random
import re

import pytest

from inkmill.llm.components import components
from inkmill.llm.near import chosen_pairs, near_groups

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, width=2):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(A_TO_Z))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width=2):
    sets = [(i, shingle_set(t, width)) for i, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for a, (i, s) in enumerate(sets):
        least[root(a)] = min(least.get(root(a), i), i)
    return sorted((i, len(s), least[root(a)], i == least[root(a)]) for a, (i, s) in enumerate(sets))


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghé", k=rng.randint(1, 6))) for _ in range(400)]
    rows = []
    for i in range(n):
        size = rng.choice([0, 1, 2, 5, 30, 80, 200])
        text = [rng.choice(words) for _ in range(size)]
        if rows and i % 2:
            text = (rng.choice(rows)[1] or "").split()
            for _ in range(int(len(text) * rng.choice([0, 0.02, 0.05, 0.08, 0.1, 0.15]))):
                text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i * 7 + 1, rng.choice([" ", "\n"]).join(text).title()))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rows = corpus(seed, 400)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, near_groups(docs, words=2).collect())) == brute(rows)


def test_five_words_unless_asked_otherwise(spark):
    """Scattered changes break more of the longer shingles, and texts of one to four words are one shingle."""
    words = [f"w{i}" for i in range(200)]
    changed = [f"x{w}" if i % 25 == 12 else w for i, w in enumerate(words)]
    end = [*words[:190], *(f"y{i}" for i in range(10))]
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(end))]
    rows += [(4, "one two three"), (5, "One two\tTHREE"), (6, "one two"), (7, "one"), (8, ""), (9, None)]
    rows += [(i + 20, t) for i, t in corpus(3, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, near_groups(docs).collect()))
    assert got == brute(rows, 5) != brute(rows, 2)
    assert [r[2] for r in got[:9]] == [1, 2, 1, 4, 4, 6, 7, 8, 9]


def test_one_large_group(spark):
    """Hundreds of near copies of one text: more than a node may hold."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(500):
        text = list(base)
        for _ in range(rng.randint(0, 6)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(f"y{rng.randrange(10**6)}" for _ in range(100))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, near_groups(docs, words=2).collect())) == brute(rows)


def test_edges(spark):
    rows = [
        (5, None, "a"), (6, "", "a"), (7, " \n ", "a"), (8, "One", "a"), (9, "one", "a"), (9, "one", "a"), (10, "one two", "b"),
        (11, "two one", "b"), (None, "ONE TWO", "b"), (None, "alone here", "b"), (12, "again " * 50_000, "c"), (13, "Again again", "c"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted(map(tuple, near_groups(docs, words=2).collect()), key=str)
    assert got == sorted(
        [(5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 1, 8, True), (9, 1, 8, False), (9, 1, 8, False), (10, 1, 10, True),
         (11, 1, 11, True), (None, 1, 10, False), (None, 1, None, True), (12, 1, 12, True), (13, 1, 12, False)], key=str
    )
    assert near_groups(docs.limit(0), words=2).count() == 0


def test_texts_that_share_an_id(spark):
    """Many different texts without an id, or with the same one, are linked each by itself."""
    rng = random.Random(6)
    last = (1 << 63) - 1

    def fresh():
        return [f"w{rng.randrange(10**6)}" for _ in range(60)]

    def copy(text):
        return [*text[:-1], f"x{rng.randrange(10**6)}"]

    rows = []
    for i in range(150):
        text = fresh()
        own = last if i % 3 else 5
        rows.append((own, text))
        if i % 2:
            rows += [(1000 + i, copy(text))] * (1 + i % 3)
        if i % 5 == 0:
            rows += [(own, copy(text)), (own, text)]
    rows = [(i, " ".join(text)) for i, text in rows]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(None if i == last else i, t) for i, t in rows], "doc_id long, text string").repartition(4)
    want = [tuple(None if x == last else x for x in r) for r in brute(rows)]
    assert sorted(map(tuple, near_groups(docs, words=2).collect()), key=str) == sorted(want, key=str)


def test_family_of_a_template(spark):
    """Hundreds of letters with one core, below the threshold to each other, and pairs of them just above it."""
    rng = random.Random(8)
    core = [f"c{i}" for i in range(175)]
    rows = []
    for i in range(400):
        own = [f"x{rng.randrange(10**9)}" for _ in range(26)]
        rows.append((i, " ".join(core + own)))
        if i % 5 == 0:
            kept = 5 if i % 2 else 8
            rows.append((1000 + i, " ".join(core + own[:kept] + [f"x{rng.randrange(10**9)}" for _ in range(26 - kept)])))
    want = brute(rows)
    assert sum(not r[3] for r in want) == 80
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, near_groups(docs, words=2).collect())) == want


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (60, 61), (61, 60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 90, 90: 90, 95: 90, 60: 60, 61: 60}


def test_pairs_of_a_node_hold_it_together():
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, 80, dtype=np.uint8)
    rows = np.tile(base, (150, 1))
    for row in rows:
        row[rng.integers(0, 80, 5)] = rng.integers(0, 256, 5)
    left, right = chosen_pairs(rows)
    parent = list(range(150))
    for i, j in zip(left, right):
        a, b = i, j
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        parent[a] = b
    assert len({next(iter([x])) for x in range(150) if parent[x] == x}) == 1
