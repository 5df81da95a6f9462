import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkmill.llm import phrases, repeats
from inkmill.llm.phrases import without_phrases
from inkmill.llm.repeats import Rolling, multikey_order
from inkmill.llm.suffixes import without_repeats


def brute_bytes(rows, width):
    """Sorted (id, n, removed, spans, sha); ids are unique."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        data = (text or "").encode()
        gone = [False] * len(data)
        for s in range(len(data) - width + 1):
            window = data[s : s + width]
            if window in seen:
                gone[s : s + width] = [True] * width
            seen.add(window)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out[i] = (i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def brute_words(rows, width):
    import re

    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    count = Counter(tuple(w[s : s + width]) for _, w in split for s in range(len(w) - width + 1))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if count[tuple(w[s : s + width])] > 1:
                gone[s : s + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=70):
    """Documents of copies, edited copies, shared passages, runs of one word, and empty ones."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(60)]
    passages = [" ".join(rng.choices(words, k=rng.randint(20, 90))) for _ in range(5)]
    rows = []
    for i in range(n):
        kind = i % 7
        text = " ".join(rng.choices(words, k=rng.randint(0, 150)))
        if kind == 1:
            text += rng.choice(["\n", " ", ""]) + rng.choice(passages) + " " + " ".join(rng.choices(words, k=9))
        elif kind == 2 and rows:
            text = rng.choice(rows)[1]
        elif kind == 3 and rows:
            old = (rng.choice(rows)[1] or "").split(" ")
            for _ in range(3):
                if old:
                    old[rng.randrange(len(old))] = rng.choice(words)
            text = "\t".join(old)
        elif kind == 4:
            text = rng.choice(["so ", "a"]) * rng.randint(0, 200)
        elif kind == 5:
            text = passages[0] + passages[1]
        elif kind == 6 and i % 2:
            text = rng.choice([None, "", "x"])
        rows.append((i * 3, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_by_brute_force(spark, seed):
    rows = corpus(seed)
    rng = random.Random(seed)
    rows[3] = (None, rows[3][1])
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for width, gram in ((100, 44), (30, 8)):
        got = without_repeats(docs, width=width, gram=gram)
        got = got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
        assert {r[0]: tuple(r) for r in got} == brute_bytes(rows, width)


@pytest.mark.parametrize("seed", [3, 4])
def test_words_by_brute_force(spark, seed):
    rows = corpus(seed)
    rows += rows[:2]  # repeated rows are documents of their own
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for width, gram in ((35, 10), (8, 3)):
        got = without_phrases(docs, width=width, gram=gram)
        got = got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256)).collect()
        assert sorted(map(tuple, got), key=str) == brute_words(rows, width)


def test_groups_across_buckets_and_pieces(spark, monkeypatch):
    """Groups much larger than a bucket, and texts longer than a piece."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdef", k=5)) for _ in range(200)]
    shared = " ".join(rng.choices(words, k=60))
    rows = [(i, shared if i % 3 else " ".join(rng.choices(words, k=5)) + shared) for i in range(400)]
    rows.append((1000, " ".join(rng.choices(words, k=60_000)) + shared))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(repeats, "ROWS_PER_BUCKET", 300)
    got = without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert {r[0]: tuple(r) for r in got} == brute_bytes(rows, 100)
    got = without_phrases(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256))
    assert sorted(map(tuple, got.collect()), key=str) == brute_words(rows, 35)


def test_rows_that_share_an_id(spark):
    text = "some passage that is long enough to be found again by its bytes, whichever way one looks at it, and on it goes"
    rows = [(1, text), (1, text), (1, text + "!"), (2, text), (2, None)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, kept string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in without_repeats(docs).collect())
    size = len(text)
    # The two texts of id 1 are ordered by a hash: one of them keeps the passage.
    assert got[:3] in (
        [(1, size, 0), (1, size, 0), (1, size + 1, size)],
        [(1, size, size), (1, size, size), (1, size + 1, 0)],
    )
    assert got[3:] == [(2, 0, 0), (2, size, size)]


def test_thousands_of_texts_without_an_id(spark):
    """Different texts without an id, or with the same one, are documents of their own."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdef", k=6)) for _ in range(3000)]
    passages = [" ".join(rng.choices(words, k=40)) for _ in range(40)]
    texts = []
    for _ in range(2500):
        text = rng.choices(words, k=rng.randint(1, 40))
        if rng.random() < 0.3:
            text.insert(rng.randrange(len(text)), rng.choice(passages))
        texts.append(" ".join(text))
    rows = [(None if i % 5 else 7, text) for i, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashed = docs.select("doc_id", F.xxhash64("text"), "text").collect()
    ordered = sorted(hashed, key=lambda r: (r[0] is not None, r[1]))
    want = [(r[0], *found[1:]) for r, found in zip(ordered, brute_bytes([(k, r[2]) for k, r in enumerate(ordered)], 100).values())]
    got = without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    got = without_phrases(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256))
    assert sorted(map(tuple, got.collect()), key=str) == brute_words(rows, 35)


def test_phrases_decide(spark, monkeypatch):
    """Only what the automata find goes: without the phrases nothing is removed. Phrases do not grow with copies."""
    rng = random.Random(13)
    words = ["".join(rng.choices("abcdef", k=5)) for _ in range(500)]
    shared = " ".join(rng.choices(words, k=70))
    own = [[" ".join(f"{side}{i}n{k}" for k in range(30)) for side in "lr"] for i in range(60)]
    rows = [(i, f"{left} {shared} {right}") for i, (left, right) in enumerate(own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    texts = repeats.numbered(docs, "doc_id", "text")
    found = phrases.confirmed(texts, 35, 10)
    listed = [bytes(r.words).decode().split() for r in found.collect()]
    windows = {tuple(w[s : s + 35]) for w in listed for s in range(len(w) - 34)}
    whole = shared.split()
    assert windows == {tuple(whole[s : s + 35]) for s in range(36)}
    assert len(listed) <= 36  # however many documents there are; a context and its windows may give one phrase twice
    monkeypatch.setattr(phrases, "confirmed", lambda *_: found.filter("false"))
    assert without_phrases(docs).agg(F.sum("n_removed")).first()[0] == 0


def test_blocks_of_phrases_and_stretches(spark, monkeypatch):
    """Keys with many phrases and many occurrences: one core, with neighbours that some of the documents share."""
    rng = random.Random(17)
    words = ["".join(rng.choices("abcdef", k=5)) for _ in range(500)]
    core = " ".join(rng.choices(words, k=20))
    rows = []
    for i in range(150):
        left, right = " ".join(rng.choices(words, k=40)), " ".join(rng.choices(words, k=40))
        rows += [(3 * i, f"{left} {core} {right}"), (3 * i + 1, f"{left} {core} {rng.choice(words)}"), (3 * i + 2, f"x {core} {right}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(phrases, "PHRASES_PER_SHARD", 20)
    got = without_phrases(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256))
    assert sorted(map(tuple, got.collect()), key=str) == brute_words(rows, 35)


def test_automaton_of_words():
    automaton = phrases.Automaton()
    for phrase in (b"a bc a", b"c a", b"a bc"):
        automaton.add(phrase.split())
    assert sorted(automaton.hits(b"x a bc a c a abc".split())) == [(2, 2), (3, 3), (5, 2)]
    assert automaton.hits([b"ab", b"c"]) == []
    assert phrases.united([(2, 2), (3, 3), (5, 2), (9, 1), (10, 1)]) == [(1, 6), (9, 11)]
    assert phrases.united([(2, 1), (4, 1), (6, 5)]) == [(2, 7)] and phrases.united([]) == []


def test_routes_meet():
    """Every phrase of a key meets every stretch of it in some shard, once."""
    shards = phrases.Shards(50, np.array([5, 9]), np.array([3, 1]), np.array([4, 2]))
    own = np.arange(40, dtype=np.uint64)
    for key in (1, 5, 9):
        keys = np.full(40, key)
        where = [{} for _ in range(2)]
        for kind in (phrases.PHRASE, phrases.STRETCH):
            for row, shard in zip(*shards.route(keys, own, kind)):
                where[kind].setdefault(int(row), set()).add(int(shard))
        assert all(a & b for a in where[0].values() for b in where[1].values())
    assert len(shards.route(np.array([5]), own[:1], phrases.PHRASE)[0]) == 4


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert without_repeats(docs).count() == 0
    assert without_phrases(docs).count() == 0


def test_multikey_order():
    rng = np.random.default_rng(1)
    keys = [rng.integers(0, 4, 500) for _ in range(4)]
    order = multikey_order(keys)
    want = np.lexsort(keys[::-1])
    assert all((k[order] == k[want]).all() for k in keys)
    assert len(multikey_order([np.zeros(0, int)] * 3)) == 0


def test_hashes_of_stretches():
    rng = np.random.default_rng(2)
    symbols = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    twice = Rolling(np.concatenate((symbols, symbols)))
    begin = np.arange(0, 250)
    assert (twice.between(begin, begin + 50) == twice.between(begin + 300, begin + 350)).all()
    assert (twice.all(50)[:250] == twice.all(50)[300:550]).all()
    assert len(np.unique(twice.all(50)[:300])) == 300


def test_sample_does_not_go_by_the_partitions(spark):
    """The splitters' sample has the same rows whatever the shuffle partitions; few long texts are sampled by pieces."""
    import random

    from inkmill.llm import repeats, suffixes

    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3_000_000))
    docs = spark.createDataFrame([(1, long), (2, long[:900_000]), (3, "short")], "doc_id long, text string")
    texts = repeats.numbered(docs, "doc_id", "text")
    rows = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("8", "211"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            drawn = repeats.Sample(0.5, 0.1)
            rows.append(repeats.anchor_rows(texts, suffixes.byte_sequence, 100, 48, sample=drawn).count())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    every = repeats.anchor_rows(texts, suffixes.byte_sequence, 100, 48).count()
    assert rows[0] == rows[1] and 0.02 * every < rows[0] < 0.09 * every
    for size in (0, 10**6, 10**9, 10**12):
        s = repeats.sample_of(size)
        buckets = size * repeats.ROWS_PER_BYTE / repeats.ROWS_PER_BUCKET
        most = max(repeats.SAMPLE_ROWS, repeats.KEYS_PER_BUCKET * buckets)
        assert size * repeats.ROWS_PER_BYTE * s.pieces * s.rows <= 1.01 * most
