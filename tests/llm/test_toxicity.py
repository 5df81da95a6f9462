import itertools
import random
from zlib import crc32

import numpy as np
import pytest

from inkmill.llm import toxicity as tx

TOXIC = ["loser", "moron", "scumbag", "idiot"]
CLEAN = "the and over river garden light morning people walked across bridge toward small quiet town where lanterns glow".split()


def corpus(rng, n):
    rows = []
    for i in range(n):
        words = rng.choices(CLEAN, k=rng.randint(20, 60))
        toxic = int(rng.random() < 0.3)
        for _ in range(toxic * rng.randint(1, 3)):
            words.insert(rng.randrange(len(words)), rng.choice(TOXIC))
        rows.append((i, " ".join(words), toxic))
    return rows


def costs_of(texts):
    return tx.character_model(sum(tx.gram_counts(t.encode()) for t in texts))


@pytest.fixture(scope="module")
def costs():
    return costs_of([t for _, t, _ in corpus(random.Random(1), 600)])


def test_model_sums_to_one(costs):
    p = np.exp(-costs.astype(np.float64)).reshape(-1, tx.SYMBOLS)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)
    brute = np.zeros(tx.GRAMS, dtype=int)
    s = [tx.BREAK] * 3 + tx.symbols("Ab 1é".encode()).tolist() + [tx.BREAK]
    for a, b, c, d in zip(s, s[1:], s[2:], s[3:]):
        brute[((a * 32 + b) * 32 + c) * 32 + d] += 1
    assert (tx.gram_counts("Ab 1é".encode()) == brute).all()


def every_path(token):
    arcs = tx.lattice(token)

    def walk(i):
        if i == len(token):
            yield 0.0, ""
            return
        for end, letters, price in arcs[i]:
            for cost, rest in walk(end):
                yield cost + price, letters + rest

    return walk(0)


def language_cost(text, costs):
    s = [tx.BREAK] * 3 + list(tx._codes(text)) + [tx.BREAK]
    return sum(float(costs[((a * 32 + b) * 32 + c) * 32 + d]) for a, b, c, d in zip(s, s[1:], s[2:], s[3:]))


@pytest.mark.parametrize("token", ["m0ron", "1d10t", "l o s e r", "sc*m", "looooser", "i.d.i.o.t", "2010", "x", "é3é", "a$$"])
def test_viterbi_against_all_paths(costs, token):
    best = min(price + language_cost(text, costs) for price, text in every_path(token))
    text = tx.decode(token, costs)
    found = min(price for price, t in every_path(token) if t == text) + language_cost(text, costs)
    assert found == pytest.approx(best, abs=1e-3)


def disguises(word):
    looks = {"o": "0", "i": "1", "e": "3", "s": "$", "a": "@"}
    yield "".join(looks.get(c, c) for c in word)
    yield " ".join(word)
    yield ".".join(word)
    yield word[:2] + word[2] * 4 + word[3:]
    yield word.upper()
    yield "-".join(looks.get(c, c) for c in word)


def test_disguised_words_are_restored(costs):
    restorer = tx.Restorer(costs)
    right = [w in restorer.restore(f"the people {d} walked over") for w in TOXIC for d in disguises(w)]
    assert sum(right) >= 0.9 * len(right)


def test_plain_words_stay(costs):
    restorer = tx.Restorer(costs)
    for text in ["The river, and the bridge.", "small town", "", " ", "Üben weiß élan"]:
        assert restorer.restore(text) == text.lower()


SCHEMA = "doc_id long, text string, toxic string, lang string"


def run(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, "x", "en") for i, t in rows], SCHEMA).repartition(3)
    return tx.scored(docs, spark.createDataFrame(labels, "doc_id long, toxic int, text string"))


def test_held_out_and_disguised_documents(spark):
    """Accuracy on documents whose labels were not seen, and on new ones with every disguise."""
    rng = random.Random(4)
    rows = corpus(rng, 1200)
    new = []
    for k, (w, d) in enumerate((w, d) for w in TOXIC for d in disguises(w)):
        words = rng.choices(CLEAN, k=40)
        new.append((10_000 + k, " ".join([*words[:20], d, *words[20:]])))
    docs = [(i, t) for i, t, _ in rows] + new
    got = {r.doc_id: r for r in run(spark, docs, [(i, y, "t") for i, _, y in rows]).collect()}
    assert len(got) == len(docs) and all(r.held_out == (crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert len(held) > 150 and sum(p == y for p, y in held) >= 0.97 * len(held)
    assert sum(got[i].predicted for i, _ in new) >= 0.85 * len(new)


def test_held_out_labels_are_never_learnt(spark):
    rows = corpus(random.Random(6), 300)
    right = [(i, y, "t") for i, _, y in rows]
    wrong = [(i, 1 - y if crc32(str(i).encode()) % 5 == 0 else y, "t") for i, y, _ in right]
    docs = [(i, t) for i, t, _ in rows]
    a, b = ({r.doc_id: r.score for r in run(spark, docs, x).collect()} for x in (right, wrong))
    assert a == b


def test_cells_counted_by_hand(spark):
    """The kept cells are those that the formula keeps."""
    rows = corpus(random.Random(8), 400)
    costs = costs_of([t for _, t, _ in rows])
    labelled = spark.createDataFrame([(i, bytearray(t.encode()), y) for i, t, y in rows], "_id long, _text binary, _toxic int")
    got = tx._telling(labelled.repartition(4), spark.sparkContext.broadcast(costs))
    held, n = [{}, {}], [0, 0]
    for _, t, y in rows:
        n[y] += 1
        for c in set(itertools.chain.from_iterable(tx.cells(w) for w in t.split())):
            held[y][c] = held[y].get(c, 0) + 1
    p, want = n[1] / sum(n), {}
    for c, b in held[1].items():
        a = held[0].get(c, 0)
        s = b / (a + b)
        away = (a + b) * (s * np.log(s / p) + ((1 - s) * np.log((1 - s) / (1 - p)) if s < 1 else 0))
        odds = np.log((b + 0.05) / (n[1] + 0.1)) - np.log((a + 0.05) / (n[0] + 0.1))
        if s > p and away >= tx.EVIDENCE and odds > 1.5:
            want[c] = odds
    assert want and got.keys() == want.keys() and all(got[c] == pytest.approx(want[c]) for c in want)


def test_edges(spark):
    labels = [(1, 1, "t"), (1, 0, "t"), (2, None, "t"), (None, 1, "t"), (99, 1, "t")]
    rows = [(1, "a"), (1, "a"), (None, None), (2, ""), (3, "x" * 300_000 + " $" * 1000), (4, "1" * 5000 + "a")]
    got = run(spark, rows, labels).collect()
    assert len(got) == 6 and len({r.score for r in got if r.doc_id == 1}) == 1
    assert [r.held_out for r in got if r.doc_id is None] == [True]
    assert run(spark, [], labels).count() == 0 and run(spark, rows, []).count() == 6
