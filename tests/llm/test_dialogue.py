import hashlib
import itertools
import random
import re

import pytest

from inkmill.llm import dialogue as dl

WHITE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """All edit sequences with up to two inserts between rows, tried one after the other."""
    best = None
    gaps = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]

    def walk(i, cost, audit, lines):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        for puts in gaps:
            new = lines + [("user" if p == "u" else "assistant", "") for p in puts]
            c, a = cost + 2 * len(puts), audit + "I" * len(puts)
            if i == len(rows):
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in new)):
                    if best is None or (c, a) < best[:2]:
                        best = (c, a, new)
                continue
            role, text, stays, cut = rows[i]
            walk(i + 1, c + 3, a + "D", new)
            if stays:
                walk(i + 1, c + cut, a + "K", new + [(role, text)])
                for name in ("user", "assistant"):
                    walk(i + 1, c + 2 + cut, a + "R", new + [(name, text)])

    walk(0, 0, "", [])
    return best


def brute(rows):
    """Rows (conv_id, turn, role, text, copies) to results by conversation."""
    out = {}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])
    for conv in {r[0] for r in rows}:
        own = [r for r in sorted((r for r in rows if r[0] == conv), key=order) for _ in range(r[4])]
        seen, listed, counts = set(), [], [0, 0, 0]
        for _, _, role, text, _ in own:
            bare = text.strip(WHITE)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else 3
            if fault < 3:
                counts[fault] += 1
            seen.add((role, text))
            listed.append((role, text, fault > 1, int(fault == 2)))
        turns = {r[1] for r in own if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, lines = cheapest(listed)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out[conv] = (gaps, *counts, illegal, cost, audit, digest)
    return out


ROLES = ["user", "assistant", "system", " ", "", "unit", "tool"]
TEXTS = ["Yes.", "No", "", " \t", "Well?", "éß!", "a\nb", "Yes. \n"]


def some(rng, convs, most, roles=ROLES):
    rows = []
    for conv in convs:
        for _ in range(rng.randint(0, most)):
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 7]), rng.choice(roles), rng.choice(TEXTS), rng.choice([1, 1, 1, 2, 0])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, copies long"


def results(df):
    return {r.conv_id: tuple(r[n] for n in dl.RESULT) for r in df.collect()}


def test_agenda_against_all_edits():
    rng = random.Random(3)
    for _ in range(150):
        rows = [
            (role, role[:1], b"", rng.random() < 0.8, rng.randint(0, 1), 0)
            for role in rng.choices(ROLES, k=rng.randint(0, 4))
        ]
        rows = [(*r[:3], r[3], r[4], 0 if r[3] else 1) for r in rows]
        want = cheapest([(r[0], "", r[3], r[4]) for r in rows])
        ends = dl.lightest(rows, dl.START, dl.GOALS)
        (state, (cost, audit)), = ends.items()
        assert (cost, audit) == want[:2]
        assert [(r, t.decode()) for r, t in dl.repaired(rows, dl.START, audit)] == want[2]


@pytest.mark.parametrize("block", [1, 2, 128])
def test_brute_force_and_cut_conversations(spark, monkeypatch, block):
    """Any length of block, and ranges that end anywhere, give the same."""
    rng = random.Random(block)
    rows = some(rng, [None, *range(60)], 4)
    rows += [(100, i % 9, rng.choice(["user", "assistant"]), f"text {i}.", 1) for i in range(5)]
    want = brute(rows)
    monkeypatch.setattr(dl, "HELD", 2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert results(dl.repair(df, block)) == want


def test_one_conversation_holds_all_rows(spark):
    """A conversation over many ranges and blocks is the one that a single agenda gives."""
    rng = random.Random(5)
    rows = [(1, i, rng.choice(["user", "assistant", "system"]), rng.choice(["ok.", f"line {i}", f"line {i}."]), 1) for i in range(3000)]
    rows += [(1, 5000, "user", "many.", 1)] * 2000 + [(2, 1, "user", "Hi.", 1)]
    seen, own = set(), []
    for _, _, role, text, _ in sorted(rows[:5000], key=lambda r: (r[1], r[2], r[3])):
        stays = (role, text) not in seen
        seen.add((role, text))
        own.append((role, role[0], text.encode(), stays, int(text[-1] != "."), 0 if stays else 1))
    (_, (cost, audit)), = dl.lightest(own, dl.START, dl.GOALS).items()
    lines = dl.repaired(own, dl.START, audit)
    digest = hashlib.sha256(b"\n".join(r.encode() + b":" + t for r, t in lines)).hexdigest()
    got = results(dl.repair(spark.createDataFrame(rows, SCHEMA).repartition(6)))
    assert got[1][5:] == (cost, audit, digest) and got[1][0] == 2000 and got[2] == (0, 0, 0, 0, 0, 2, "KI", got[2][-1])


def test_damage(spark):
    """The hash decides on each row; dropped rows leave their conversation behind."""
    import zlib

    rows = [(c, t, "assistant", "A. B! C?") for c, t in itertools.product([None, *range(30)], [None, 1, 2])] + [(0, 9, None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, copies string")
    got = {(r.conv_id, r.turn): (r.role, r.text, r.copies) for r in dl.damaged(df).collect()}
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want = [
            "user" if kind == 4 else role or " ",
            "" if kind == 1 else re.sub("[.!?]", "", text or " ") if kind == 2 else text or " ",
            0 if kind == 0 else 2 if kind == 3 else 1,
        ]
        assert list(got[c, t]) == want


def test_edges(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert dl.repair(dl.damaged(none)).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    long = "very long. " * 200_000
    rows = [(1, 0, "user", "x.", 0), (1, 1, "user", "x.", 0), (2, 0, "user", long, 1), (2, 1, "assistant", long, 1)]
    got = results(dl.repair(spark.createDataFrame(rows, SCHEMA)))
    assert got[1] == (0, 0, 0, 0, 0, 0, "", empty)
    assert got[2][5:7] == (0, "KK") and got[2][7] == hashlib.sha256(f"user:{long}\nassistant:{long}".encode()).hexdigest()
    words = spark.createDataFrame([("a", 1, "user", "x."), ("b", 1, "user", "x.")], "conv_id string, turn int, role string, text string")
    assert {r.conv_id for r in dl.repair(dl.damaged(words)).collect()} == {"a", "b"}
