"""Substring deduplication by repeated-phrase automata: every occurrence of a recurring passage goes.

A passage recurs if it consists of windows, 35 consecutive words by default, that occur at least twice, in other
documents or in the same one.

* Recurring phrases are confirmed by ``repeats`` over all documents, from one place each: the windows around an anchor that occur in
  the same places are one phrase, so every recurring window lies in a phrase and no phrase holds a window that does not
  recur. A phrase may come twice, as a context and as windows of one; an automaton holds it once. Where a sorted bucket ends, a window may be a phrase of its own next to one that holds it.
  A phrase's key is a hash of its anchor.
* Phrases are dealt into shards by key, and each shard compiles its own into Aho-Corasick automata of bounded size.
* All documents are streamed past: a bitmap of the keys tells which of a document's anchors may head a phrase, and
  the words around those go to the shards of their keys, where the automata locate every occurrence. Keys with many
  phrases or many occurrences are dealt out in blocks, every block of phrases against every block of occurrences.

Words are what white space (space and U+0009 to U+000D) leaves, unchanged. Null texts have none. Texts with fewer
words than a window keep all. Rows that repeat id and text are separate documents, so their windows recur.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.llm.common import SPACES, bitmap, written
from inkmill.llm.repeats import (
    BYTE_SYMBOLS, Rolling, anchor_rows, anchored, by_bytes, hashed, mixed, numbered, repeated, sample_of, with_runs,
)
from inkmill.llm.suffixes import marked, runs

WIDTH = 35
GRAM = 10
PHRASES_PER_SHARD = 10_000
PHRASE_WORDS = 1_000_000  # of phrases in one automaton; each word is a character of its own there
_KEYS = 1 << 25  # bits of the bitmap of keys
_CELL_BYTES = 4096

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True


def word_sequence(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    values = np.frombuffer(text, dtype=np.uint8)
    word = np.concatenate(([0], (~_IS_SPACE[values]).view(np.int8), [0]))
    edges = np.flatnonzero(np.diff(word))
    hashes = Rolling(BYTE_SYMBOLS[values]).between(edges[::2], edges[1::2])
    return hashes, (hashes >> np.uint64(32)).astype(np.uint32)


def keyed(lead: np.ndarray) -> np.ndarray:
    return mixed(lead.view(np.uint64)).view(np.int64)


def _anchors(data: pa.Array, width: int, gram: int) -> list[np.ndarray]:
    """Row, key, first and last window of all anchors of a column of texts."""
    found = [(a.row, keyed(a.lead), a.first, a.first + a.windows) for a in anchored(data, word_sequence, width, gram)]
    return [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, dtype=np.int64)] * 4


class Automaton:
    """Phrases, word by word: a word of the phrases is one character, any other word none of those."""

    def __init__(self) -> None:
        self._chars: dict[bytes, str] = {}
        self._words = 0
        self._automaton = ahocorasick.Automaton()

    @property
    def full(self) -> bool:
        return self._words >= PHRASE_WORDS

    def add(self, words: list[bytes]) -> None:
        chars = self._chars
        for word in words:
            if word not in chars:
                code = len(chars) + 1
                chars[word] = chr(code if code < 0xD800 else code + 0x800)  # past the surrogates
        self._words += len(words)
        self._automaton.add_word("".join([chars[w] for w in words]), len(words))

    def hits(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Last word and length of every occurrence of a phrase."""
        if self._automaton.kind != ahocorasick.AHOCORASICK:
            self._automaton.make_automaton()
        char = self._chars.get
        return list(self._automaton.iter("".join([char(w, "\0") for w in words])))


def united(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs (first word, end) of hits in order of their last words."""
    spans: list[tuple[int, int]] = []
    for last, size in hits:
        begin = last - size + 1
        while spans and spans[-1][1] >= begin:
            begin = min(begin, spans.pop()[0])
        spans.append((begin, last + 1))
    return spans


SHARDED = "bucket int, kind int, doc long, tag long, first long, words binary"
PHRASE, STRETCH = 0, 1


def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans (_doc, _tag, first word, end) of the phrases of a shard, which come first, in its stretches."""
    automata: list[Automaton] = []
    for batch in batches:
        phrases = batch.filter(pa.compute.equal(batch.column("kind"), PHRASE)).column("words")
        for phrase in phrases:
            if not automata or automata[-1].full:
                automata.append(Automaton())
            automata[-1].add(phrase.as_buffer().to_pybytes().split(b" "))
        rest = batch.filter(pa.compute.equal(batch.column("kind"), STRETCH))
        if not rest.num_rows or not automata:
            continue
        known: dict[bytes, list[tuple[int, int]]] = {}
        spans, owner = [], []
        for i, text in enumerate(rest.column("words").to_pylist()):
            found = known.get(text)
            if found is None:
                words = text.split(b" ")
                found = known[text] = united(sorted(h for a in automata for h in a.hits(words)))
            spans += found
            owner += [i] * len(found)
        begin, end = np.array(spans, dtype=np.int64).reshape(-1, 2).T
        owner = np.array(owner, dtype=np.int64)
        doc, tag, first = (rest.column(c).to_numpy()[owner] for c in ("doc", "tag", "first"))
        columns = [doc, tag, first + begin, first + end]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["_doc", "_tag", "first", "last"])


class Shards(NamedTuple):
    """How many shards there are, and in how many blocks the phrases and the stretches of frequent keys are dealt out."""

    number: int
    keys: np.ndarray
    phrases: np.ndarray
    stretches: np.ndarray

    def route(self, key: np.ndarray, own: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard): a row goes to one block of its kind, with each block of the other."""
        slot = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        known = self.keys[slot] == key if len(self.keys) else np.zeros(len(key), dtype=bool)
        blocks = [np.ones(len(key), dtype=np.int64) for _ in range(2)]
        for which, many in enumerate((self.phrases, self.stretches)):
            blocks[which][known] = many[slot[known]]
        mine, other = blocks[kind], blocks[1 - kind]
        row = np.repeat(np.arange(len(key)), other)
        block = (own % mine.astype(np.uint64)).astype(np.int64)[row]
        against = np.arange(len(row)) - np.repeat(np.cumsum(other) - other, other)
        pair = (block, against) if kind == PHRASE else (against, block)
        return row, (hashed(key[row], *pair) % np.uint64(self.number)).astype(np.int32)


def _sharded(shards: Shards, kind: int, key, doc, tag, first, words: list[bytes]) -> pa.RecordBatch:
    own = hashed(doc, tag, first) if kind == STRETCH else np.array([zlib.crc32(w) for w in words], dtype=np.uint64)
    row, bucket = shards.route(key, own, kind)
    columns = [bucket, np.full(len(row), kind, dtype=np.int32), doc[row], tag[row], first[row]]
    taken = pa.array(words, pa.binary()).take(pa.array(row))
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), taken], names=["bucket", "kind", "doc", "tag", "first", "words"])


def confirmed(texts: DataFrame, width: int, gram: int) -> DataFrame:
    """Phrases that occur more than once, (key, words joined by spaces). Written."""
    places = repeated(texts, word_sequence, width, gram, "phrases", once=True)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_bytes(whole, 0, 4 << 20)):
            row, key, first, _ = _anchors(batch.column(0), width, gram)
            order = (row << 40) | first
            keys, words = [], []
            for i in range(batch.num_rows):
                own = batch.column(0)[i].as_buffer().to_pybytes().split()
                begin, last = (batch.column(c)[i].values.to_numpy() for c in (1, 2))
                keys.append(key[np.searchsorted(order, (i << 40) | begin, side="right") - 1])
                words += [b" ".join(own[a : b + width]) for a, b in zip(begin.tolist(), last.tolist(), strict=True)]
            columns = [pa.array(np.concatenate(keys)), pa.array(words, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "words"])

    both = with_runs(texts.withColumn("_text", F.col("_text").cast("binary")), places, "phrase-places")
    asked = both.filter("_first IS NOT NULL").select("_text", "_first", "_last")
    return written(asked.mapInArrow(read, "key long, words binary"), "phrase-texts")


def _key_bits(phrases: DataFrame) -> np.ndarray:
    """Which keys phrases may have, in 4 MB whatever the input."""
    bits = np.zeros(_KEYS // 8, dtype=np.uint8)
    for cell, own in bitmap(phrases, F.col("key"), "phrase-keys").collect():
        bits[cell * _CELL_BYTES : (cell + 1) * _CELL_BYTES] = np.frombuffer(own, dtype=np.uint8)
    return bits


def _may_head(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    slot = key & np.int64(_KEYS - 1)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _shards(texts: DataFrame, phrases: DataFrame, bits: np.ndarray, width: int, gram: int) -> Shards:
    """Shards for phrases that are counted, and stretches of which a sample is: rows on the driver go by the shards."""
    total = phrases.count()
    least = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = max(least, total // PHRASES_PER_SHARD + 1)
    many = phrases.groupBy("key").count().filter(F.col("count") > PHRASES_PER_SHARD).collect()
    size = texts.agg(F.sum(F.octet_length("_text")).alias("n")).first().n or 0
    sample = anchor_rows(texts, word_sequence, width, gram, sample=sample_of(size)).select("lead").toPandas()
    seen = keyed(sample["lead"].to_numpy(dtype=np.int64))
    keys, counts = np.unique(seen[_may_head(bits, seen)], return_counts=True)
    share = max(counts.sum() / number, 8)  # sampled rows of a shard; fewer tell nothing
    blocks = {int(k): [1, -int(-c // share)] for k, c in zip(keys, counts, strict=True) if c > share}
    for key, count in many:
        blocks.setdefault(key, [1, 1])[0] = -(-count // PHRASES_PER_SHARD)
    listed = sorted((k, *b) for k, b in blocks.items())
    return Shards(number, *np.array(listed, dtype=np.int64).reshape(-1, 3).T)


def occurrences(texts: DataFrame, phrases: DataFrame, width: int, gram: int) -> DataFrame:
    """Spans (_doc, _tag, first word, end) of all texts in which a phrase occurs. Written."""
    bits = _key_bits(phrases)
    shards = _shards(texts, phrases, bits, width, gram)
    shared = texts.sparkSession.sparkContext.broadcast((bits, shards))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_bytes(whole, 1, 4 << 20)):
            none = np.zeros(batch.num_rows, dtype=np.int64)
            yield _sharded(shared.value[1], PHRASE, batch.column(0).to_numpy(), none, none, none, batch.column(1).to_pylist())

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_bytes(whole, 2, 4 << 20)):
            row, key, first, last = _anchors(batch.column(2), width, gram)
            if not row.size:
                continue
            # Neighbours of one key, as in a text of few words, go as one.
            new = np.ones(len(row), dtype=bool)
            new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1]) | (first[1:] != last[:-1] + 1)
            begin = np.flatnonzero(new)
            row, key, first, last = row[begin], key[begin], first[begin], np.maximum.reduceat(last, begin)
            taken = _may_head(shared.value[0], key)
            row, key, first, last = row[taken], key[taken], first[taken], last[taken]
            if not row.size:
                continue
            words, own, at = [], [], -1
            for i, a, b in zip(row.tolist(), first.tolist(), (last + width).tolist(), strict=True):
                if i != at:
                    own, at = batch.column(2)[i].as_buffer().to_pybytes().split(), i
                words.append(b" ".join(own[a:b]))
            doc, tag = batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row]
            yield _sharded(shared.value[1], STRETCH, key, doc, tag, first, words)

    rows = phrases.mapInArrow(deal, SHARDED).unionByName(
        texts.select("_doc", "_tag", F.col("_text").cast("binary")).mapInArrow(stretches, SHARDED)
    )
    inside = rows.repartitionById(shards.number, F.col("bucket")).sortWithinPartitions("kind")
    return written(inside.mapInArrow(locate, "_doc long, _tag long, first long, last long"), "phrase-spans")


def without_phrases(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM
) -> DataFrame:
    """Id, ``n_words``, ``n_removed``, ``spans`` (first word, end) and ``kept``, the words that stay."""
    texts = numbered(docs, id_col, text_col)
    found = occurrences(texts, confirmed(texts, width, gram), width, gram)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_bytes(whole, 1, 4 << 20)):
            words = [batch.column(1)[i].as_buffer().to_pybytes().split() for i in range(batch.num_rows)]
            masks = [
                marked(len(own), first.values.to_numpy(), last.values.to_numpy()) if first.is_valid else None
                for own, first, last in zip(words, batch.column(2), batch.column(3), strict=True)
            ]
            kept = [
                w if m is None else [x for x, gone in zip(w, m.tolist(), strict=True) if not gone]
                for w, m in zip(words, masks, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([len(w) - len(k) for w, k in zip(words, kept, strict=True)], pa.int64()),
                    pa.array([[] if m is None else runs(m).tolist() for m in masks], pa.list_(pa.int64())),
                    pa.array([b" ".join(k).decode() for k in kept], pa.string()),
                ],
                names=["_id", "n_words", "n_removed", "spans", "kept"],
            )

    kind = texts.schema["_id"].dataType.simpleString()
    both = with_runs(texts.withColumn("_text", F.col("_text").cast("binary")), found, "phrase-documents")
    return (
        both.select("_id", "_text", "_first", "_last")
        .mapInArrow(cut, f"_id {kind}, n_words long, n_removed long, spans array<long>, kept string")
        .withColumnRenamed("_id", id_col)
    )
