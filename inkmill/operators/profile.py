"""Corpus statistics of a book: style characters, bigrams, simplified ratio, and evidence look-ups."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from inkmill.functions.arrays import unnest
from inkmill.functions.text import cjk_count, cjk_only
from inkmill.operators.chain import Chain, patterns_for, split
from inkmill.operators.chain import punctuated as punctuate
from inkmill.operators.characters import character_class
from inkmill.operators.keyed import lookup_by_key
from inkmill.sources.rules import Rules

BOOK, CHAPTER = "book_id", "chapter_index"
_FIRST, _LAST = 0x4E00, 0x9FFF


def _in_cjk(chars) -> list[str]:
    return [c for c in chars if "一" <= c <= "\u9fff"]


def _all_of(text: Column, chars) -> Column:
    usable = _in_cjk(chars)
    if not usable:
        return F.array().cast("array<string>")
    return F.regexp_extract_all(text, F.lit(character_class(usable)), F.lit(0))


def profile_chars(chapters: DataFrame, traditional: dict[str, str]) -> DataFrame:
    """``(book_id, ch, kind, n)`` for simplified forms and traditional characters."""

    def counted(chars, kind):
        return (
            unnest(chapters, [BOOK], _all_of(F.col("text"), chars), "ch")
            .groupBy(BOOK, "ch")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(BOOK, "ch", F.lit(kind).alias("kind"), "n")
        )

    return counted(set(traditional.values()), "simplified").unionByName(counted(set(traditional), "traditional"))


def profile_bigrams(chapters: DataFrame) -> DataFrame:
    """``(book_id, bigram, n)`` over the CJK characters of each chapter, punctuation skipped."""
    pairs = F.regexp_extract_all(cjk_only(F.col("text")), F.lit("(?=(..))"), F.lit(1))
    return (
        unnest(chapters, [BOOK], pairs, "bigram")
        .groupBy(BOOK, "bigram")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _simplified_ratio() -> Column:
    ratio = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("traditional_total") / F.col("cjk_total"))
    return F.when(F.col("cjk_total") == 0, F.lit(0.0)).otherwise(ratio)


def profile_totals(chapters: DataFrame, traditional: dict[str, str]) -> DataFrame:
    """``(book_id, cjk_total, traditional_total, simplified_ratio)``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    old = _in_cjk(traditional)
    old_count = F.size(_all_of(text, old)) if old else F.lit(0)
    return (
        chapters.groupBy(BOOK)
        .agg(
            F.sum(cjk_count(text)).cast("bigint").alias("cjk_total"),
            F.sum(old_count).cast("bigint").alias("traditional_total"),
        )
        .withColumn("simplified_ratio", _simplified_ratio())
    )


def _flags(chars: list[str]) -> np.ndarray:
    """Which places of the CJK block are among the characters."""
    flags = np.zeros(_LAST - _FIRST + 1, dtype=bool)
    flags[[ord(c) - _FIRST for c in chars]] = True
    return flags


def _gram_counts(texts: list[str], simplified: np.ndarray, old: np.ndarray) -> tuple[int, int, Counter]:
    """CJK characters of texts, traditional ones, and the counts of simplified forms and of the pairs that hold one."""
    cjk = traditional = 0
    ones, pairs = [], []
    for text in texts:
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        points = points[(points >= _FIRST) & (points <= _LAST)] - _FIRST
        cjk += len(points)
        traditional += int(np.count_nonzero(old[points]))
        held = simplified[points]
        ones.append(points[held])
        at = np.flatnonzero(held[:-1] | held[1:])
        pairs.append((points[at].astype(np.uint64) << np.uint64(32)) | points[at + 1])
    grams: Counter = Counter()
    for found, both in ((ones, False), (pairs, True)):
        for code, n in zip(*(x.tolist() for x in np.unique(np.concatenate(found), return_counts=True)), strict=True):
            gram = chr((code >> 32) + _FIRST) + chr((code & 0xFFFFFFFF) + _FIRST) if both else chr(code + _FIRST)
            grams[gram] = n
    return cjk, traditional, grams


def _evidence_grams(chapters: DataFrame, traditional: dict[str, str]) -> DataFrame:
    """Counts of simplified forms and of the bigrams that contain one, ratio under the gram ``''``.

    Only these can be asked for, so only these are counted. A batch of chapters gives one row for each book and gram; the totals of
    a book are a row next to them, so the text is gone through once.
    """
    old, simplified = _flags(_in_cjk(traditional)), _flags(_in_cjk(set(traditional.values())))
    rows = chapters.select(BOOK, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    names = ["gram", "n", "cjk_total", "traditional_total"]
    kinds = StructType(
        [StructField(BOOK, rows.schema[BOOK].dataType), StructField("gram", StringType())]
        + [StructField(n, LongType()) for n in names[1:]]
    )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            books: dict = {}
            numbers = batch.column(0).dictionary_encode()
            for number, text in zip(numbers.indices.to_pylist(), batch.column(1), strict=True):
                books.setdefault(number, []).append(text.as_py())
            for number, texts in books.items():
                cjk, old_ones, grams = _gram_counts(texts, simplified, old)
                size = len(grams) + 1
                book = pa.nulls(size, batch.schema.field(0).type) if number is None else numbers.dictionary.take(pa.array([number] * size))
                yield pa.RecordBatch.from_arrays(
                    [
                        book, pa.array(["", *grams], pa.string()), pa.array([len(texts), *grams.values()], pa.int64()),
                        pa.array([cjk] + [None] * len(grams), pa.int64()), pa.array([old_ones] + [None] * len(grams), pa.int64()),
                    ],
                    names=[BOOK, *names],
                )

    return (
        rows.mapInArrow(counted, kinds)
        .groupBy(BOOK, "gram")
        .agg(*[F.sum(c).alias(c) for c in names[1:]])
        .select(
            BOOK, "gram", F.when(F.col("gram") == "", _simplified_ratio()).otherwise(F.col("n").cast("double")).alias("v")
        )
    )


def asks_of(traditional: dict[str, str]) -> Callable[[Column], Column]:
    """Whether a text holds a traditional character."""
    old = Chain(Rules(traditional=traditional), "detect").old

    @F.arrow_udf("boolean")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([t.is_valid and old.search(t.as_py()) is not None for t in texts], pa.bool_())

    return run.asNondeterministic()


def _wanted(traditional: dict[str, str]) -> Callable[[Column], Column]:
    """The grams that a chapter asks for."""
    chain = Chain(Rules(traditional=traditional), "detect")
    # No punctuation rule adds, removes or moves a Chinese character, or brings two together, and only pairs of two are in a
    # profile: where all characters asked for are Chinese, the hits and pairs of the raw paragraph are those of the punctuated one.
    raw = len(_in_cjk(traditional)) == len(traditional)

    def asked(text):
        if text is None or chain.old.search(text) is None:
            return []
        suspect = [p for p in split(text)[0] if chain.old.search(p)]
        return chain.wanted(suspect if raw else punctuate(suspect, patterns_for(text))[0])

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([asked(t.as_py()) for t in texts], pa.list_(pa.string()))

    return run.asNondeterministic()


def traditional_evidence(
    chapters: DataFrame, traditional: dict[str, str], corpus: DataFrame | None = None
) -> DataFrame:
    """``(book_id, chapter_index, evidence)`` for the chapters with a traditional character.

    ``evidence`` maps each gram the chapter asks for to its count in ``corpus`` (the same books;
    ``chapters`` itself unless given). It is bounded by the length of the chapter.
    """
    asked = _wanted(traditional)(F.col("text"))
    # Without a filter on the text: pushed down, it would work out a projected text a second time.
    requests = unnest(chapters.select(BOOK, CHAPTER, asked.alias("_asked")), [BOOK, CHAPTER], "_asked", "gram")
    answers = _evidence_grams(chapters if corpus is None else corpus, traditional)
    found = lookup_by_key(requests, answers, [BOOK, "gram"]).filter("v is not null")
    return found.groupBy(BOOK, CHAPTER).agg(
        F.map_from_entries(F.collect_list(F.struct("gram", "v"))).alias("evidence")
    )
