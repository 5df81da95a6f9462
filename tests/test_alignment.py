import difflib
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkmill.functions.alignment import Automaton, differing, matching_blocks
from inkmill.operators.reviewing import places, text_changes


def opcodes(a, b):
    found = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    return [op for op in found if op[0] != "equal"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=25), st.lists(st.sampled_from("abcde"), max_size=25))
def test_same_as_the_standard_library(a, b):
    assert differing(a, b) == opcodes(a, b)


@pytest.mark.parametrize("letters", ["ab", "abcdefghijklmnop", "x"])
def test_long_sequences(letters):
    rng = random.Random(len(letters))
    for _ in range(20):
        a = [rng.choice(letters) + str(rng.randrange(3)) for _ in range(rng.randint(0, 90))]
        b = [x for x in a if rng.random() < 0.8] + rng.choices(a or ["z"], k=rng.randint(0, 9))
        assert differing(a, b) == opcodes(a, b)


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=60), st.text("abc", min_size=1, max_size=20))
def test_longest_block(text, other):
    begin, size = Automaton(other).longest_in(text)
    block = difflib.SequenceMatcher(None, text, other, autojunk=False).find_longest_match()
    assert size == block.size and (not size or begin == block.a)


def test_a_chapter_of_many_paragraphs_takes_seconds():
    """Every second one of 20,000 paragraphs differs: blocks of one paragraph each."""
    a = [f"p{i}" for i in range(20_000)]
    b = [x if i % 2 else f"q{i}" for i, x in enumerate(a)]
    start = time.perf_counter()
    assert len(matching_blocks(a, b)) == 10_000
    assert time.perf_counter() - start < 4


def test_changes_of_large_texts_grow_in_proportion():
    def took(n):
        a = [f"paragraph {i}" for i in range(n)]
        b = [x if i % 3 else f"changed {i}" for i, x in enumerate(a)]
        start = time.perf_counter()
        found = text_changes("\n\n".join(a), "\n\n".join(b), a, b)
        assert len(found) == (n + 2) // 3
        return time.perf_counter() - start

    small = max(took(2_000), 0.02)
    assert took(20_000) < 30 * small


def test_places():
    assert places("ab\n\nab", ["ab", "ab"]) == [(0, 2), (4, 6)]
    assert places("x", ["y", "x"]) == [(0, 1), (1, 2)]
