"""Windows that occur more than once, found by range-partitioned, sorted anchors.

A window is ``width`` consecutive symbols of one document: bytes or words. Each window is owned by its anchor,
the start of the ``gram`` symbols in it whose hash is least (the leftmost of equals). Equal windows have equal
anchors at equal places, so only the suffixes that start at anchors are sorted, a few per cent of all. What the
windows of one anchor cover is its context.

* An anchor's row is (lead, context, document, tag, place). ``lead`` begins with the first bytes of the suffix and
  ends with a hash of its gram; ``context`` is a hash of all its context, and where the anchor lies in it.
* Splitters drawn from a sample cut the rows into buckets by (lead, context, document, tag, place): a group of any
  size is cut as well, so no bucket grows with a hot group. A bucket is sorted by multikey quicksort.
* Anchors with one context have equal windows. Of anchors with one lead and several contexts, one per context
  goes on as an edge: its windows are compared one by one, as rows of the same kind.
* The first and last context of each bucket are left open and settled across buckets.

Documents compare by (id, tag). Where different texts share an id, or have none, the tag is the 64-bit hash of the text;
else it is 0.
Hashes have 64 bits and are compared only between rows that agree in ``lead`` already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkmill.llm.common import bitmap, with_bit, written

ROWS_PER_BUCKET = 600_000  # what a task sorts at once
SAMPLE_ROWS = 100_000  # keys from which splitters are drawn, or ``KEYS_PER_BUCKET`` for each bucket if that is more
KEYS_PER_BUCKET = 20
SAMPLE_BYTES = 1 << 25  # of text, in pieces, whose rows the sample may come from
ROWS_PER_BYTE = 0.07  # that there are at most, about
CHUNK = 1 << 18  # symbols hashed at once
NO_ID = -(1 << 63)  # stands for a null id and sorts first

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing step of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_SYMBOLS = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 2 * CHUNK)
        _POWERS[:] = [
            np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, dtype=np.uint64))))
            for b in (_BASE, _INVERSE)
        ]
    return _POWERS[0], _POWERS[1]


class Rolling:
    """Hashes of any stretch of a sequence of symbols, each in constant time."""

    def __init__(self, symbols: np.ndarray) -> None:
        up, self._down = _powers(len(symbols) + 1)
        self._sums = np.zeros(len(symbols) + 1, dtype=np.uint64)
        np.cumsum(symbols * up[: len(symbols)], out=self._sums[1:])

    def all(self, width: int) -> np.ndarray:
        n = len(self._sums) - width
        return mixed((self._sums[width:] - self._sums[:n]) * self._down[:n]) if n > 0 else self._sums[:0]

    def between(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self._sums[end] - self._sums[begin]) * self._down[begin] + (end - begin).astype(np.uint64))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    rest = width - size
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


def anchors(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int, gram: int):
    """Anchors of the pieces ``starts, sizes`` of a sequence: (at, first window, last window, hashes, rolling)."""
    rolling = Rolling(symbols)
    none = np.zeros(0, dtype=np.int64)
    if len(symbols) < width:
        return none, none, none, none.astype(np.uint64), rolling
    grams = rolling.all(gram)
    order = (grams & ~np.uint64((1 << 26) - 1)) | np.arange(len(grams), dtype=np.uint64)
    owner = (_least(order, width - gram + 1) & np.uint64((1 << 26) - 1)).astype(np.int64)
    piece = np.repeat(np.arange(len(starts)), sizes)
    windows = np.flatnonzero(piece[: len(owner)] == piece[width - 1 :][: len(owner)])
    if not windows.size:
        return none, none, none, none.astype(np.uint64), rolling
    at = owner[windows]
    change = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    first = windows[change]
    last = windows[np.concatenate((change[1:], [len(windows)])) - 1]
    at = at[change]
    return at, first, last, grams[at], rolling


def pieces(sizes: list[int], width: int, most: int = CHUNK) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences in chunks of (number, begin, end); long ones in pieces that share no window and lose none."""
    chunk, held = [], 0
    for i, size in enumerate(sizes):
        for begin in range(0, max(size - width + 1, 0), most):
            end = min(size, begin + most + width - 1)
            if chunk and held + end - begin > 2 * most:
                yield chunk
                chunk, held = [], 0
            chunk.append((i, begin, end))
            held += end - begin
    if chunk:
        yield chunk


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """Multikey quicksort: order by the first key, then within its ties by the next, and so on."""
    order = np.argsort(keys[0])
    tied = np.zeros(len(order), dtype=np.int64)
    for before, key in zip(keys, keys[1:], strict=False):
        values = before[order]
        tied += np.concatenate(([0], np.cumsum(values[1:] != values[:-1]))) if len(order) else 0
        _, tied = np.unique(tied, return_inverse=True) if len(order) else (None, tied)
        sizes = np.bincount(tied, minlength=1)
        where = np.flatnonzero(sizes[tied] > 1)
        if not where.size:
            break
        part = order[where]
        order[where] = part[np.lexsort((key[part], tied[where]))]
    return order


def _packed(*columns: np.ndarray) -> np.ndarray:
    """Keys as byte strings that sort like the rows."""
    sign = np.uint64(1 << 63)
    words = np.stack([c.astype(np.int64).view(np.uint64) ^ sign for c in columns], axis=1)
    return np.ascontiguousarray(words.astype(">u8")).view(f"S{8 * len(columns)}").ravel()


COLUMNS = ["lead", "context", "doc", "tag", "place"]
ROW = ", ".join(f"{c} long" for c in COLUMNS)
BUCKETED = f"bucket int, {ROW}"
JUDGED = f"kind int, {ROW}, n long, several boolean"
COVERED, EDGE, OPEN = 0, 1, 2


def hashed(*values) -> np.ndarray:
    """A hash of rows of whole numbers."""
    key = np.zeros(1, dtype=np.uint64)
    for v in values:
        key = mixed(key * _BASE + np.asarray(v).astype(np.int64).view(np.uint64))
    return key


def _extents(lead, sets, doc, tag, place) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows around one anchor that occur at the same anchors, told by ``sets``, as one stretch: (doc, tag, place)."""
    if not len(lead):
        return doc, tag, place
    first, last = place >> 16, (place >> 16) + (place & 0xFF)
    anchor = first + ((place >> 8) & 0xFF)
    order = np.lexsort((first, hashed(lead, sets, doc, tag, anchor)))
    new = np.zeros(len(order), dtype=bool)
    new[0] = True
    for key in (lead, sets, doc, tag, anchor):
        new[1:] |= key[order][1:] != key[order][:-1]
    begin = np.flatnonzero(new)
    least, most = first[order][begin], np.maximum.reduceat(last[order], begin)
    return doc[order][begin], tag[order][begin], (least << 16) | (most - least)


def _judge_bucket(lead, context, doc, tag, place, once: bool) -> dict[str, np.ndarray]:
    """What a sorted bucket tells: covered rows, edges, and the open contexts at its ends.

    Rows are covered if their context occurs earlier too; with ``once`` only the first row of a context that occurs
    again is, and windows around one anchor that occur at the same anchors are one row.
    """
    n = len(lead)
    new_group = np.concatenate(([True], lead[1:] != lead[:-1]))
    new = new_group | np.concatenate(([True], context[1:] != context[:-1]))
    firsts = np.flatnonzero(new)
    variant = np.cumsum(new) - 1
    members = np.diff(np.append(firsts, n))
    group = np.cumsum(new_group)[firsts] - 1
    several = np.bincount(group)[group] > 1
    is_open = np.zeros(len(firsts), dtype=bool)
    is_open[[0, -1]] = True
    if once:
        sets = np.add.reduceat(hashed(doc, tag, (place >> 16) + ((place >> 8) & 0xFF)), firsts)
        shown = (members > 1) & ~is_open
        at = firsts[shown]
        found = _extents(lead[at], sets[shown].view(np.int64), doc[at], tag[at], place[at])
    else:
        first = firsts[variant]
        at = np.flatnonzero((doc != doc[first]) | (tag != tag[first]) | (place != place[first]))
        found = doc[at], tag[at], place[at]
    rest = [firsts[several & ~is_open], firsts[is_open]]
    kinds = np.repeat([COVERED, EDGE, OPEN], [len(found[0]), *map(len, rest)])
    at = np.concatenate(rest)
    none = np.zeros(len(found[0]), dtype=np.int64)
    return {
        "kind": kinds.astype(np.int32),
        "lead": np.concatenate((none, lead[at])), "context": np.concatenate((none, context[at])),
        "doc": np.concatenate((found[0], doc[at])), "tag": np.concatenate((found[1], tag[at])),
        "place": np.concatenate((found[2], place[at])),
        "n": np.concatenate((none, members[variant[at]])),
        "several": np.concatenate((none > 0, several[variant[at]])),
    }


def bucketed(batch: pa.RecordBatch, cuts) -> pa.RecordBatch:
    """A batch with the bucket of each row, if splitters are given."""
    if cuts is None:
        return batch
    columns = [batch.column(i).to_numpy() for i in range(len(COLUMNS))]
    bucket = np.searchsorted(cuts.value, _packed(*columns), side="right").astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(bucket), *batch.columns], names=["bucket", *batch.schema.names])


def judged(rows: Callable, sample: DataFrame, share: float, once: bool, name: str) -> DataFrame:
    """Covered rows and edges of ``rows``, by buckets between splitters that ``sample`` gives.

    ``rows`` makes the rows with their buckets from the splitters, in the same Python worker that makes them.
    ``sample`` holds a ``share`` of the rows, drawn by a hash; its size does not go by the shuffle partitions.
    The result is a written table.
    """
    spark = sample.sparkSession
    keys = sample.select(*COLUMNS).toPandas()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, int(len(keys) / share / ROWS_PER_BUCKET) + 1)
    packed = np.sort(_packed(*[keys[c].to_numpy(dtype=np.int64) for c in COLUMNS]))
    cuts = packed[np.linspace(0, len(packed), buckets + 1)[1:-1].astype(int)] if len(packed) else packed
    parameter = spark.sparkContext.broadcast(cuts)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held)
        del held
        bucket = whole.column("bucket").to_numpy()
        columns = [whole.column(c).to_numpy() for c in COLUMNS]
        del whole
        for own in np.unique(bucket):
            part = columns if (bucket == own).all() else [c[bucket == own] for c in columns]
            order = multikey_order(part)
            found = _judge_bucket(*[c[order] for c in part], once)
            for begin in range(0, len(found["kind"]), 100_000):
                yield pa.RecordBatch.from_pydict({k: pa.array(v[begin : begin + 100_000]) for k, v in found.items()})

    sorted_in = rows(parameter).repartitionById(buckets, F.col("bucket"))
    table = written(sorted_in.mapInArrow(judge, JUDGED), name)
    # Across buckets: at most two open contexts of each.
    same = W.partitionBy("lead", "context")
    spread = (
        table.filter(f"kind = {OPEN}")
        .withColumn("total", F.sum("n").over(same))
        .withColumn("least", F.min(F.struct("doc", "tag", "place")).over(same))
        .withColumn("first", F.struct("doc", "tag", "place") == F.col("least"))
        .withColumn("most", F.max("several").over(W.partitionBy("lead")))
        .withColumn("contexts", F.size(F.collect_set("context").over(W.partitionBy("lead"))))
    )
    late = F.col("first") & (F.col("total") > 1) if once else ~F.col("first")
    settled = spread.filter(late).withColumn("kind", F.lit(COVERED)).unionByName(
        spread.filter(F.col("first") & (F.col("most") | (F.col("contexts") > 1)))
        .dropDuplicates(["lead", "context"])
        .withColumn("kind", F.lit(EDGE))
    )
    columns = ["kind", *COLUMNS]
    return table.filter(f"kind <> {OPEN}").select(*columns).unionByName(settled.select(*columns))


# ---- documents as sequences -------------------------------------------------------------------

Sequences = Callable[[list[bytes]], tuple[list[np.ndarray], Callable[[int, np.ndarray], np.ndarray] | None]]


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_doc``, ``_tag`` and ``_text`` next to the id.

    The tag is 0 only for ids that surely have one text; an id's texts all have a tag of 0, or their hashes.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    texts = docs.select(
        F.col(f"`{id_col}`").alias("_id"),
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("_doc"),
        text.alias("_text"),
    )
    hashes = texts.groupBy("_doc").agg(F.min(F.xxhash64("_text")).alias("least"), F.max(F.xxhash64("_text")).alias("most"))
    marks = bitmap(hashes.filter("least <> most"), F.xxhash64("_doc"), "shared-ids")
    flagged = with_bit(texts, F.xxhash64("_doc"), marks, "_shared")
    tag = F.when(F.col("_shared"), F.xxhash64("_text")).otherwise(F.lit(0).cast("long"))
    return flagged.select("_id", "_doc", tag.alias("_tag"), "_text")


def place(first: np.ndarray, before: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """First window, and how many windows there are and lie before the anchor, in one number."""
    return (first << 16) | (before << 8) | windows


def first_window(places: Column) -> Column:
    return F.shiftright(places, 16)


def _drawn(share: float, *values) -> np.ndarray:
    """Which rows are among a ``share`` of all, by a hash of their values."""
    return (hashed(*values) >> np.uint64(11)).astype(np.float64) < share * float(1 << 53)


class Sample(NamedTuple):
    """What a sample of anchors takes: a share of the pieces of texts, and a share of the rows of those."""

    pieces: float
    rows: float


def sample_of(size: int) -> Sample:
    """The sample for so many bytes of text; it grows only with the buckets that they need."""
    wanted = max(SAMPLE_ROWS, KEYS_PER_BUCKET * size * ROWS_PER_BYTE / ROWS_PER_BUCKET)
    read = max(SAMPLE_BYTES, 4 * wanted / ROWS_PER_BYTE)
    return Sample(min(1.0, read / max(size, 1)), min(1.0, wanted / max(min(size, read) * ROWS_PER_BYTE, 1)))


class Anchors(NamedTuple):
    """Anchors of a column of texts: row, lead, hash of the context, first window, windows before the anchor and after the first."""

    row: np.ndarray
    lead: np.ndarray
    context: np.ndarray
    first: np.ndarray
    before: np.ndarray
    windows: np.ndarray


def anchored(data: pa.Array, sequence, width: int, gram: int, *sampled) -> Iterator[Anchors]:
    """All anchors of a column of texts, by row and place; ``sampled``: ids, tags and the sample to draw."""
    for symbols, heads, chosen in chunks(data, sequence, width, *sampled):
        number = np.array([c[0] for c in chosen])
        begin = np.array([c[1] for c in chosen])
        sizes = np.array([c[2] - c[1] for c in chosen])
        starts = np.cumsum(sizes) - sizes
        at, first, last, grams, rolling = anchors(symbols, starts, sizes, width, gram)
        if at.size:
            piece = np.searchsorted(starts, at, side="right") - 1
            lead = (heads[at].astype(np.uint64) << np.uint64(32)) | (grams >> np.uint64(32))
            context = rolling.between(first, last + width) ^ mixed((at - first + 1).astype(np.uint64))
            own = first - starts[piece] + begin[piece]
            signed = lead.view(np.int64) ^ np.int64(NO_ID)
            yield Anchors(number[piece], signed, context.view(np.int64), own, at - first, last - first)


def anchor_rows(texts: DataFrame, sequence, width: int, gram: int, cuts=None, sample: Sample | None = None) -> DataFrame:
    """Rows (lead, context, doc, tag, place) of all anchors, or of a sample of them."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, tags, data = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            for a in anchored(data, sequence, width, gram, docs, tags, sample):
                own = [a.lead, a.context, docs[a.row], tags[a.row], place(a.first, a.before, a.windows)]
                if sample:
                    taken = _drawn(sample.rows, *own[1:])
                    own = [c[taken] for c in own]
                yield bucketed(pa.RecordBatch.from_arrays([pa.array(c) for c in own], names=COLUMNS), cuts)

    return texts.select("_doc", "_tag", F.col("_text").cast("binary")).mapInArrow(make, BUCKETED if cuts else ROW)


def chunks(data: pa.Array, sequence, width: int, docs=None, tags=None, sample: Sample | None = None):
    """Symbols and leading values of a column of texts, in chunks, with the pieces each holds; of a sample only its pieces."""
    held, begin, values = 0, 0, data
    sizes = np.diff(np.frombuffer(values.buffers()[1], dtype=np.int32, offset=4 * values.offset, count=len(values) + 1))
    while begin < len(values):
        end, held = begin, 0
        while end < len(values) and (end == begin or held + sizes[end] <= 4 * CHUNK):
            held += int(sizes[end])
            end += 1
        sequences = [sequence(v) for v in values.slice(begin, end - begin).to_pylist()]
        for chosen in pieces([len(s[0]) for s in sequences], width):
            if sample:
                at = np.array([begin + c[0] for c in chosen])
                taken = _drawn(sample.pieces, docs[at], tags[at], [c[1] for c in chosen])
                chosen = [c for c, t in zip(chosen, taken, strict=True) if t]
                if not chosen:
                    continue
            symbols = np.concatenate([sequences[i][0][a:b] for i, a, b in chosen])
            heads = np.concatenate([sequences[i][1][a:b] for i, a, b in chosen])
            yield symbols, heads, [(begin + i, a, b) for i, a, b in chosen]
        begin = end


def edge_windows(texts: DataFrame, edges: DataFrame, sequence, width: int, cuts=None) -> DataFrame:
    """The single windows of edges as rows: the lead stays, the context is the hash of the window."""
    listed = edges.groupBy(F.col("doc").alias("_doc"), F.col("tag").alias("_tag")).agg(
        F.collect_list("lead").alias("_leads"), F.collect_list("place").alias("_places")
    )
    marks = bitmap(edges, F.xxhash64("doc", "tag"), "edge-documents")
    asked = with_bit(texts, F.xxhash64("_doc", "_tag"), marks, "_asked")
    both = asked.filter("_asked").select("_doc", "_tag", F.col("_text").cast("binary").alias("_text")).join(
        listed.hint("merge"), ["_doc", "_tag"]
    )

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                doc, tag = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                symbols = sequence(batch.column(2)[i].as_buffer().to_pybytes())[0]
                leads = batch.column(3)[i].values.to_numpy()
                places = batch.column(4)[i].values.to_numpy()
                order = np.argsort(places)
                leads, places = leads[order], places[order]
                first, windows = places >> 16, places & 0xFF
                for some in np.array_split(np.arange(len(places)), len(places) // 5_000 + 1):
                    base = int(first[some].min())
                    top = int((first[some] + windows[some]).max()) + width
                    rolling = Rolling(symbols[base:top])
                    many = windows[some] + 1
                    start = np.repeat(first[some] - np.cumsum(many) + many, many) + np.arange(many.sum())
                    before = np.repeat(((places[some] >> 8) & 0xFF) + first[some], many) - start
                    hashes = rolling.between(start - base, start - base + width)
                    hashes = (hashes ^ mixed((before + 1).astype(np.uint64))).view(np.int64)
                    same = [np.full(len(start), x, dtype=np.int64) for x in (doc, tag)]
                    own = [np.repeat(leads[some], many), hashes, *same, place(start, before, 0)]
                    held.append(own)
                    rows += len(start)
                    if rows > 100_000:
                        yield bucketed(_rows(held), cuts)
                        held, rows = [], 0
        if held:
            yield bucketed(_rows(held), cuts)

    return both.mapInArrow(make, BUCKETED if cuts else ROW)


def _rows(held: list[list[np.ndarray]]) -> pa.RecordBatch:
    columns = [pa.array(np.concatenate(c)) for c in zip(*held, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=COLUMNS)


def by_bytes(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``most`` bytes in one column, and a row at least."""
    begin, held = 0, 0
    for i in range(batch.num_rows):
        held += batch.column(column)[i].as_buffer().size
        if held >= most:
            yield batch.slice(begin, i + 1 - begin)
            begin, held = i + 1, 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


def repeated(texts: DataFrame, sequence, width: int, gram: int, name: str, once: bool = False) -> DataFrame:
    """Runs of windows that occur earlier too: (_doc, _tag, first, last), as first symbol and last window's first symbol.

    With ``once`` instead one place of each stretch of windows that occurs more than once: every window that does lies in
    a stretch, and a stretch occurs wherever any window of it does next to the same anchor.
    ``sequence`` turns the UTF-8 bytes of a text into its symbols, 64-bit hashes, and leading values of 32 bits.
    """
    size = texts.agg(F.sum(F.octet_length("_text")).alias("n")).first().n or 0
    drawn = sample_of(size)
    sample = anchor_rows(texts, sequence, width, gram, sample=drawn)
    first = judged(
        lambda cuts: anchor_rows(texts, sequence, width, gram, cuts), sample, drawn.pieces * drawn.rows, once, f"{name}-anchors"
    )
    edges = first.filter(f"kind = {EDGE}")
    count = edges.count()
    wanted = max(SAMPLE_ROWS, KEYS_PER_BUCKET * count * width / ROWS_PER_BUCKET)
    share = min(1.0, wanted / max(count * width, 1))
    few = edges.filter(F.pmod(F.xxhash64("doc", "tag", "place"), F.lit(1_000_000)) < F.lit(int(np.ceil(share * 1_000_000))))
    sample = edge_windows(texts, few, sequence, width)
    second = judged(
        lambda cuts: edge_windows(texts, edges, sequence, width, cuts), sample, share, once, f"{name}-edges"
    )
    covered = first.filter(f"kind = {COVERED}").unionByName(second.filter(f"kind = {COVERED}"))
    place_ = F.col("place")
    return covered.select(
        F.col("doc").alias("_doc"),
        F.col("tag").alias("_tag"),
        first_window(place_).alias("first"),
        (first_window(place_) + place_.bitwiseAND(F.lit(0xFF))).alias("last"),
    )


def with_runs(texts: DataFrame, covered: DataFrame, name: str) -> DataFrame:
    """``texts`` with the arrays ``_first`` and ``_last`` of what is covered, null where nothing is.

    Documents that are surely not covered do not move.
    """
    listed = covered.groupBy("_doc", "_tag").agg(
        F.collect_list("first").alias("_first"), F.collect_list("last").alias("_last")
    )
    flagged = with_bit(texts, F.xxhash64("_doc", "_tag"), bitmap(covered, F.xxhash64("_doc", "_tag"), name), "_asked")
    moved = flagged.filter("_asked").drop("_asked").join(listed.hint("merge"), ["_doc", "_tag"], "left")
    none = F.lit(None).cast("array<long>")
    still = flagged.filter("NOT _asked").drop("_asked").withColumns({"_first": none, "_last": none})
    return moved.unionByName(still)
