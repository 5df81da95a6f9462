import time

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkmill.llm.tokens import PrefixCounter, counts_from, fitting, prefix_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = PrefixCounter(PATH)


def by_library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def check(text):
    [(total, steps)] = OWN.count([text], True)
    counts = counts_from(steps)
    assert total == by_library(text)
    assert len(steps) == len(text.encode())
    for i in range(1, len(text) + 1):
        prefix = text[:i]
        assert counts[len(prefix.encode()) - 1] == by_library(prefix), repr(prefix)


@pytest.mark.parametrize(
    "text",
    [
        "", "a", " ", "  ", "\n\nab", "a  b   c \n\n d\t\te", "don't we'll they've I'm 'relax '' 're", "\n's \n 's  's",
        "x<|endoftext|>y", "a  <|endoftext|>  b<|endoftext|><|endoftext|>", "<|endoftex", "123abc456  789!!?", "é中文 😀　\xa0x",
        "a\x1cb\x85c​d﻿e", "The   quick\r\nbrown fox    " * 3, "reprehenderitconsecteturadipiscing" * 2, "\x00\x01 \x7f",
    ],
)
def test_every_prefix(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'abcdestrlvmABC019!.,-é中😀\xa0"), st.characters(codec="utf-8", max_codepoint=0x2FFF, exclude_categories=("Cn", "Cs"))), max_size=40))
def test_random_texts(text):
    check(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "=", "-", "ab", "the", "é", "中", "9", "_-", "AbC", " ", "  ", "\n"]), min_size=1, max_size=6), st.integers(40, 90))
def test_long_pieces_at_every_prefix(parts, times):
    check("".join(p * times for p in parts))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("a=-.9_é中x \n"), st.integers(1, 10_000)), min_size=1, max_size=5))
def test_unbroken_runs(runs):
    text = "".join(c * n for c, n in runs)
    assert OWN.count([text], False)[0][0] == by_library(text)
    assert OWN.vocabulary.fits(np.array([97]), np.array([98]))[0] == OWN.vocabulary._border(97, 98)


@pytest.mark.parametrize("text", ["=" * 1_000_000, "a" * 1_000_000, "QUJD/+Zx9k" * 100_000, "loremipsumdolor" * 70_000])
def test_an_unbroken_megabyte(text):
    begin = time.perf_counter()
    want = by_library(text)
    library = time.perf_counter() - begin
    [(total, steps)] = OWN.count([text], True)
    assert total == want == counts_from(steps)[-1]
    assert time.perf_counter() - begin - library <= max(50 * library, 5)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = prefix_counts(docs, PATH, steps=False).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.n_tokens == by_library(r.text) and r.n_bytes == len(r.text.encode()) for r in rows)


def test_budget_nulls_ties_and_other_columns(spark):
    rows = [(1, None, "u"), (2, "", "u"), (2, "", "u"), (None, "héllo wörld, this is ünïcode", "v"), (3, "ab " * 40_000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = prefix_counts(docs, PATH).select("doc_id", "n_bytes", "n_tokens").collect()
    want = [(r[0], len((r[1] or "").encode()), by_library(r[1] or "")) for r in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    both = docs.filter("doc_id IS NULL").drop("n_tokens").crossJoin(prefix_counts(docs.filter("doc_id IS NULL"), PATH).drop("doc_id"))
    text = both.select(fitting(F.col("text"), F.col("steps"), 5).alias("t")).first().t
    fits = [rows[3][1][:i] for i in range(len(rows[3][1]) + 1) if by_library(rows[3][1][:i]) <= 5]
    assert text == max(fits, key=len)
    assert prefix_counts(docs.limit(0), PATH).count() == 0
