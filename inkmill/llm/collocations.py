"""Phrase collocations by stripes: each prefix keys an associative counter of its next words.

Phrases are contiguous words inside pieces, counted per language. Lengths are taken one after the other. For length m
each task keeps, for every prefix of m - 1 words, a counter of next words; equal prefixes meet and their counters are
merged element by element. A merged stripe gives the extensions of its prefix that are frequent; all its counts together,
with the end of a piece and rare words under one key, give the prefix total; its greatest count is the most that an
extension to the right keeps. The same rows keyed by their last m - 1 words give that to the left.

* A phrase can only be frequent if its first and its last m - 1 words are. Which ones are is known from a bitmap of fixed
  size; bits that two phrases share only let more rows through, and counts are exact.
* A stripe may have as many next words as there are words. The stripe of no words, and those of prefixes that are marked
  as hot, are dealt out over ``SHARDS`` by the next word; marks are bits too, alike in all tasks.
* Stripes lie in buckets by a hash of prefix and shard, one for each ``BUCKET_BYTES`` of text; a row has those of one bucket.
  Tasks sum counters up to ``HELD`` entries before they put them out. Merging streams over sorted buckets and holds one.

Null texts are empty, null languages ``und``. Empty texts have no words. Very long texts are read whole, in one go each.
Repeated rows count each time. Equal scores are ordered by count, then by phrase as bytes. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkmill.llm.common import LOWER, UPPER, bitmap, lookup, text_or_empty, written
from inkmill.llm.repeats import by_bytes, mixed

LONGEST, AT_LEAST, FIRST = 5, 100, 2_000
SHARDS = 64
HOT = 100_000  # how often a prefix occurs whose stripe is dealt out
HELD = 1_000_000  # entries that a task sums up before it puts them out
BUCKET_BYTES = 1 << 21  # of text, to one bucket of stripes
TEXT_BYTES = 1 << 22  # texts whose words are counted at once
SALT = 64  # parts in which the first of a language are sought before they meet

_BREAK = b"\xff"  # stands between pieces; no byte of UTF-8
_TABLE = bytes.maketrans(
    UPPER.encode() + b".,;:!?\n\x0b\x0c\r\t", LOWER.encode() + _BREAK * 10 + b" "
)
_BITS = 1024 * 32768  # as the bitmap has them


def pieces_of(text: bytes) -> list[bytes]:
    """Words in lower case, with a break wherever a piece ends."""
    return text.translate(_TABLE).replace(_BREAK, b" \xff ").split()


class Bits:
    """A bitmap in the worker."""

    def __init__(self, cells: bytes) -> None:
        self._bytes = np.frombuffer(cells, dtype=np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        slot = keys.view(np.int64) % _BITS
        return (self._bytes[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _collected(marks: DataFrame) -> bytes:
    """The bitmap, 4 MB whatever the input."""
    cells = np.zeros((1024, 4096), dtype=np.uint8)
    for row in marks.toLocalIterator():
        cells[int(row._cell)] = np.frombuffer(bytes(row._bits), dtype=np.uint8)
    return cells.tobytes()


def _seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode()))


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _joined(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word."""
    return mixed(keys * _STEP + words)


def phrase_hash(lang: str, phrase: bytes) -> int:
    """The hash of a phrase as the tasks have it, signed."""
    words = [np.array([xxhash.xxh64_intdigest(w)], dtype=np.uint64) for w in phrase.split(b" ")]
    key = np.array([_seed(lang)])
    for w in words:
        key = _joined(key, w)
    return int(key.view(np.int64)[0])


STRIPES = "bucket int, stripes binary"
_PACKED = pa.ipc.IpcWriteOptions(compression="zstd")
MERGED = "lang string, prefix binary, next binary, n long, hash long"
_ENTRY = ["bucket", "lang", "prefix", "shard", "next"]


def _entries(lang: str, texts: list[bytes], m: int, buckets: int, marks: Bits | None, hot: Bits | None) -> pa.Table:
    """Counted (prefix, next) of phrases of ``m`` words; a null next stands for what is not followed up."""
    tokens = pieces_of(_BREAK.join(texts))
    coded = pa.array(tokens, pa.binary()).dictionary_encode()
    del tokens
    words = coded.dictionary
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    listed = words.to_pylist()
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in listed], dtype=np.uint64)
    stop = listed.index(_BREAK) if _BREAK in listed else -1
    real = ids != stop
    if m == 1:
        n = np.bincount(ids[real], minlength=len(listed))
        at = np.flatnonzero(n)
        shard = (hashes[at] % np.uint64(SHARDS)).astype(np.int32)
        key = np.full(len(at), _seed(lang))
        return _table(buckets, lang, key, pa.array([b""] * len(at), pa.binary()), shard, words.take(pa.array(at)), n[at])
    size = len(ids) - (m - 2)  # places where a prefix of m - 1 words may begin
    if size <= 0:
        return _none()
    keys = np.full(size, _seed(lang))
    whole = np.ones(size, dtype=bool)
    for k in range(m - 1):
        keys = _joined(keys, hashes[ids[k : k + size]])
        whole &= real[k : k + size]
    asked = whole & marks.has(keys)
    starts = np.flatnonzero(asked)
    if not starts.size:
        return _none()
    after = starts + m - 1
    following = np.where(after < len(ids), ids[np.minimum(after, len(ids) - 1)], stop)
    # The last m - 1 words are the prefix that begins one place on.
    nextkeys = np.append(asked, False)[starts + 1]
    following = np.where((following == stop) | ~nextkeys, -1, following)
    # Equal prefixes by their words' numbers: one number for each distinct prefix, then one for each pair.
    prefix = ids[starts]
    for k in range(1, m - 1):
        prefix = np.unique(prefix * len(listed) + ids[starts + k], return_inverse=True)[1]
    pair = prefix * (len(listed) + 1) + following + 1
    _, first, n = np.unique(pair, return_index=True, return_counts=True)
    text = words.take(pa.array(ids[starts[first]]))
    if m > 2:
        more = [words.take(pa.array(ids[starts[first] + k])) for k in range(1, m - 1)]
        text = pc.binary_join_element_wise(text, *more, pa.scalar(b" ", pa.binary()))
    next_ = following[first]
    nexts = words.take(pa.array(np.where(next_ < 0, 0, next_), mask=next_ < 0))
    dealt = hashes[np.maximum(next_, 0)] % np.uint64(SHARDS)
    own = keys[starts[first]]
    shard = np.where((next_ >= 0) & hot.has(own), dealt, 0).astype(np.int32)
    return _table(buckets, lang, own, text, shard, nexts, n)


def _table(buckets, lang, keys, prefix, shard, nexts, n) -> pa.Table:
    bucket = (mixed(keys + shard.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    langs = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(n), np.int32)), pa.array([lang])).cast(pa.string())
    return pa.table(
        [pa.array(bucket), langs, prefix.cast(pa.binary()), pa.array(shard, pa.int32()), nexts.cast(pa.binary()), pa.array(n, pa.int64())],
        names=[*_ENTRY, "n"],
    )


def _none() -> pa.Table:
    none = pa.array([], pa.binary())
    return _table(1, "", np.zeros(0, np.uint64), none, np.zeros(0, np.int32), none, np.zeros(0, np.int64))


def _summed(tables: list[pa.Table]) -> pa.Table:
    """Counters added up element by element."""
    whole = pa.concat_tables(tables)
    return whole.group_by(_ENTRY, use_threads=False).aggregate([("n", "sum")]).rename_columns([*_ENTRY, "n"])


def _stripes(entries: pa.Table) -> Iterator[pa.RecordBatch]:
    """Entries as stripes, in order of their prefixes; those of a bucket are one packed block."""
    if not entries.num_rows:
        return
    whole = entries.sort_by([(c, "ascending") for c in _ENTRY[:4]]).combine_chunks()
    bucket = _plain(whole.column(0))
    begin = np.flatnonzero(_changes([bucket]))
    ends = np.append(begin[1:], len(bucket))
    whole = whole.drop_columns(["bucket"])
    for some in np.array_split(np.arange(len(begin)), len(begin) // 200 + 1):
        blocks = [_block(whole.slice(int(begin[i]), int(ends[i] - begin[i]))) for i in some]
        yield pa.RecordBatch.from_arrays(
            [bucket.take(pa.array(begin[some])), pa.array(blocks, pa.binary())], names=["bucket", "stripes"]
        )


def _block(entries: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, entries.schema, options=_PACKED) as out:
        out.write_table(entries)
    return sink.getvalue().to_pybytes()


def _plain(c: pa.ChunkedArray) -> pa.Array:
    c = c.combine_chunks()
    return c.chunk(0) if isinstance(c, pa.ChunkedArray) else c


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """Where a row differs from the one before."""
    n = len(columns[0])
    new = np.ones(n, dtype=bool)
    if n > 1:
        new[1:] = False
        for c in columns:
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return new


def stripes(texts: DataFrame, m: int, buckets: int, marks=None, hot=None) -> DataFrame:
    """Stripes of all prefixes of ``m - 1`` words that may be frequent, summed up in each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bits(marks.value) if marks else None
        warm = Bits(hot.value) if hot else None
        held: list[pa.Table] = []
        rows = summed = 0
        for batch in (part for whole in batches for part in by_bytes(whole, 1, TEXT_BYTES)):
            langs, data = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                made = _entries(lang, [t for x, t in zip(langs, data, strict=True) if x == lang], m, buckets, own, warm)
                held.append(made)
                rows += made.num_rows
            if rows > 2 * summed + HELD // 2:
                held = [_summed(held)]
                rows = summed = held[0].num_rows
                if rows > HELD:
                    yield from _stripes(held[0])
                    held, rows, summed = [], 0, 0
        if held:
            yield from _stripes(_summed(held))

    return texts.mapInArrow(count, STRIPES)


def merged(found: DataFrame, at_least: int) -> DataFrame:
    """Stripes merged element by element: (lang, prefix, next, n, hash) of what is frequent.

    A row without next has what is left of its prefix's total, so the rows of a prefix add up to that.
    """

    def close(entries: pa.Table) -> Iterator[pa.RecordBatch]:
        whole = _summed([entries])
        known = pc.is_valid(whole.column("next"))
        often = whole.filter(pc.and_(known, pc.greater_equal(whole.column("n"), at_least)))
        rest = whole.filter(pc.invert(pc.and_(known, pc.greater_equal(whole.column("n"), at_least))))
        columns = [often.column(c).to_pylist() for c in ("lang", "prefix", "next", "n")]
        hashes = [
            phrase_hash(a, b + b" " + c if b else c) for a, b, c in zip(*columns[:3], strict=True)
        ]
        left = rest.group_by(["lang", "prefix"], use_threads=False).aggregate([("n", "sum")])
        columns[0] += left.column("lang").to_pylist()
        columns[1] += left.column("prefix").to_pylist()
        columns[2] += [None] * left.num_rows
        columns[3] += left.column("n_sum").to_pylist()
        hashes += [None] * left.num_rows
        kinds = [pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        values = [*columns, hashes]
        for i in range(0, len(hashes), 50_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(v[i : i + 50_000], k) for v, k in zip(values, kinds, strict=True)],
                names=["lang", "prefix", "next", "n", "hash"],
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = summed = 0
        own = None
        for batch in batches:
            for i, bucket in enumerate(batch.column(0).to_pylist()):
                if held and bucket != own:
                    yield from close(pa.concat_tables(held))
                    held, rows, summed = [], 0, 0
                own = bucket
                held.append(unpacked(bucket, batch.column(1)[i]))
                rows += held[-1].num_rows
                if rows > 2 * summed + HELD // 8:
                    held = [_summed(held)]
                    rows = summed = held[0].num_rows
        if held:
            yield from close(pa.concat_tables(held))

    return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, MERGED)


def unpacked(bucket: int, block: pa.Scalar) -> pa.Table:
    """The entries of a bucket's stripes."""
    entries = pa.ipc.open_stream(block.as_buffer()).read_all()
    return entries.add_column(0, "bucket", pa.array(np.full(entries.num_rows, bucket, dtype=np.int32)))


def _spread(spark: SparkSession, rows: DataFrame, name: str):
    return spark.sparkContext.broadcast(_collected(bitmap(rows, F.col("hash"), name)))


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", at_least: int = AT_LEAST, longest: int = LONGEST, hot: int = HOT) -> DataFrame:
    """All phrases of up to ``longest`` words that occur at least so often: (lang, prefix, next, n, hash, words).

    Words are UTF-8 bytes. Rows without ``next`` and ``hash`` have the rest of the total of their prefix. Written.
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
        text_or_empty(text_col).cast("binary").alias("_text"),
    )
    size = texts.agg(F.sum(F.length("_text")).alias("n")).first().n or 0
    buckets = size // BUCKET_BYTES + 1
    levels = []
    marks = warm = None
    for m in range(1, longest + 1):
        level = written(merged(stripes(texts, m, buckets, marks, warm), at_least), f"collocations-{m}")
        levels.append(level.withColumn("words", F.lit(m)))
        often = level.filter("hash IS NOT NULL")
        if m < longest:
            marks = _spread(spark, often, f"collocation-marks-{m}")
            warm = _spread(spark, often.filter(F.col("n") >= hot), f"collocation-hot-{m}")
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.unionByName(level)
    return whole


def collocations(docs: DataFrame, first: int = FIRST, at_least: int = AT_LEAST, longest: int = LONGEST, **columns) -> DataFrame:
    """The best-scored phrases of each language: (lang, rank, phrase, a, l, r, n, score)."""
    rows = phrases(docs, at_least=at_least, longest=longest, **columns)
    space = F.lit(b" ")
    often = rows.filter("hash IS NOT NULL").select(
        "lang", "words", "n", F.col("prefix").cast("string").alias("prefix"),
        F.when(F.col("words") == 1, F.col("next")).otherwise(F.concat("prefix", space, "next")).cast("string").alias("phrase"),
    )
    often = written(often, "collocation-phrases")
    totals = rows.filter("words = 1").groupBy("lang").agg(F.sum("n").alias("total"))
    # Subsumption: the most that an extension by one word keeps; longer ones keep no more.
    longer = often.filter("words > 2")
    tail = F.expr("substring(phrase, instr(phrase, ' ') + 1)")
    kept = (
        longer.select("lang", F.col("prefix").alias("phrase"), "n")
        .unionByName(longer.select("lang", tail.alias("phrase"), "n"))
        .groupBy("lang", "phrase").agg(F.max("n").alias("_most"))
    )
    candidates = often.filter("words > 1").join(kept.hint("merge"), ["lang", "phrase"], "left")
    candidates = candidates.filter("_most IS NULL OR _most < n").select("lang", "phrase", F.col("n").alias("a"))
    split = F.split("phrase", " ")
    cut = candidates.withColumn("_w", split).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("_w") - 1))).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("_w", F.lit(1), F.col("k")), " ").alias("_left"),
        F.array_join(F.slice("_w", F.col("k") + 1, F.size("_w") - F.col("k")), " ").alias("_right"),
    )
    counts = often.select("lang", "phrase", "n")
    cut = lookup(cut, counts.select("lang", F.col("phrase").alias("_left"), F.col("n").alias("l")), ["lang", "_left"])
    cut = lookup(cut, counts.select("lang", F.col("phrase").alias("_right"), F.col("n").alias("r")), ["lang", "_right"])
    cut = cut.join(totals.select("lang", F.col("total").alias("n")), "lang")
    # Exact: products in 38 decimal digits; the quotient is at most 1000 n / at_least.
    score = F.expr("cast(cast(a as decimal(17,0)) * 1000 as decimal(20,0)) * cast(n as decimal(17,0)) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    scored = cut.withColumn("score", score.cast("long"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    ranked = best.select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salted = ranked.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALT)))
    inside = W.partitionBy("lang", "_salt").orderBy(*order)
    few = salted.withColumn("_nth", F.row_number().over(inside)).filter(F.col("_nth") <= first).drop("_salt", "_nth")
    return (
        few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long"))
        .filter(F.col("rank") <= first)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
