"""Benchmark decontamination: passages of documents within a small edit distance of a benchmark item.

Texts are compared in lower case (A-Z) with single spaces between words, as bytes. An item of L bytes leaks into
a document if some stretch of it is within ``floor(edits * L)`` edits, a tenth by default.

* Windows as long as the item are proposed where a band of diagonals shares enough grams with it: of 8 bytes, of 6 for
  items below ``SMALL`` bytes. With e edits at least D - qe of the item's D distinct grams of q bytes survive next to each
  other, so no passage is lost here unless an item repeats its own grams. A band gives windows at its best supported
  diagonals, at that of its first gram and at its ends.
* Windows and items are embedded by the CGK random walk, which maps edit to Hamming distance, several times.
  Bit samples of the embeddings are compared, as often as ``recall`` asks for at an agreement of ``AGREE``. Samples
  come only from steps that the item fills: beyond them both sides would be padding. Few unrelated windows pass.
* Windows that collide are verified by exact edit distance (bit-parallel, best stretch around the window).

Embedding a window at every byte for every item length is out of reach of any budget, hence the first step.

The benchmark goes through in blocks of ``BLOCK`` items, each against all documents; only a block is held at a time.
Null or empty items and texts match nothing. Items of fewer than ``SHORT`` bytes count where they occur as whole
words without any edit. Repeated items and repeated documents give repeated rows; null ids are handed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.llm.near import _LOWERED
from inkmill.llm.repeats import BYTE_SYMBOLS, Rolling, by_bytes, mixed

GRAM = 8
SMALL_GRAM = 6  # for items below SMALL bytes, all of whose 8-grams the edits allowed could break
SMALL = 35
EDITS = 0.1
SHORT = 16
BLOCK = 5_000
WALKS = 16  # embeddings
BITS = 6  # sampled steps that have to agree
AGREE = 0.5  # least share of bits on which passages within the distance are taken to agree
SUPPORTED = 3  # diagonals of a band with the most grams, at which windows start
PART = 1 << 19  # bytes of text whose grams are looked at together
_TABLE = 1 << 20


def normalised(text: bytes) -> bytes:
    return b" ".join(_LOWERED[np.frombuffer(text, dtype=np.uint8)].tobytes().split())


# ---- CGK embedding --------------------------------------------------------------------------------


def walks(texts: list[bytes], steps: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings of texts by one random walk, and how many steps each text fills.

    At each step the byte at hand is put out, then the walk stays or goes on by that byte's coin. Zeros follow a text.
    """
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    width = int(sizes.max(initial=0)) + 1
    padded = np.zeros((len(texts), width), dtype=np.uint8)
    for i, text in enumerate(texts):
        padded[i, : len(text)] = np.frombuffer(text, dtype=np.uint8)
    coins = np.random.default_rng(seed).integers(0, 2, size=(steps, 256), dtype=np.int64)
    at, rows = np.zeros(len(texts), dtype=np.int64), np.arange(len(texts))
    out = np.zeros((len(texts), steps), dtype=np.uint8)
    filled = np.zeros(len(texts), dtype=np.int64)
    for step in range(steps):
        now = padded[rows, at]
        out[:, step] = now
        filled += at < sizes
        at = np.minimum(at + coins[step, now], sizes)
    return out, filled


def repetitions(recall: float, bits: int = BITS, agree: float = AGREE) -> int:
    return int(np.ceil(np.log(1 - recall) / np.log(1 - agree**bits)))


def collide(windows: list[bytes], items: list[bytes], recall: float) -> np.ndarray:
    """Which windows agree with their items on all steps of a sample, in any repetition."""
    hit = np.zeros(len(windows), dtype=bool)
    times = -(-repetitions(recall) // WALKS)
    distinct = list(dict.fromkeys(items))
    where = {x: i for i, x in enumerate(distinct)}
    number = np.array([where[x] for x in items], dtype=np.int64)
    steps = 3 * max(map(len, items), default=0)
    for walk in range(WALKS):
        left = np.flatnonzero(~hit)
        if not left.size:
            break
        ours, _ = walks([windows[i] for i in left], steps, walk)
        theirs, filled = walks(distinct, steps, walk)
        same = ours == theirs[number[left]]
        draw = np.random.default_rng(1000 + walk).random((times, BITS))
        found = np.zeros(len(left), dtype=bool)
        for sample in draw:
            at = (sample[None, :] * filled[number[left], None]).astype(np.int64)
            found |= np.take_along_axis(same, at, 1).all(axis=1)
        hit[left] = found
    return hit


# ---- exact verification ---------------------------------------------------------------------------


def best_stretch(item: bytes, region: bytes) -> tuple[int, int]:
    """Least edit distance of the item to any stretch of the region, and where the first such stretch ends."""
    m, every = len(item), (1 << len(item)) - 1
    masks: dict[int, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    up, down, score, top = every, 0, m, 1 << (m - 1)
    best, end = m, 0
    for at, c in enumerate(region):
        equal = masks.get(c, 0)
        diagonal = (((equal & up) + up) ^ up) | equal | down
        right, left = down | ~(diagonal | up) & every, up & diagonal
        score += bool(right & top) - bool(left & top)
        right, left = right << 1 & every, left << 1 & every
        up, down = left | ~(diagonal | right) & every, right & diagonal
        if score < best:
            best, end = score, at + 1
    return best, end


class _Grams:
    """Grams of one width of some items of a block, and where texts share enough of them."""

    def __init__(self, texts: list[bytes], chosen: list[int], allowed: np.ndarray, gram: int) -> None:
        self.gram, self.allowed, self.items = gram, allowed, len(texts)
        self.longest = max((len(texts[i]) for i in chosen), default=0)
        self.needed = np.ones(len(texts), dtype=np.int64)
        grams, owners, offsets = [], [], []
        for i in chosen:
            own = Rolling(BYTE_SYMBOLS[np.frombuffer(texts[i], dtype=np.uint8)]).all(gram)
            grams.append(own)
            owners.append(np.full(len(own), i))
            offsets.append(np.arange(len(own)))
            self.needed[i] = max(1, len(np.unique(own)) - gram * allowed[i])
        none = np.zeros(0, dtype=np.int64)
        grams = np.concatenate(grams) if grams else none.astype(np.uint64)
        owners = np.concatenate(owners) if owners else none
        offsets = np.concatenate(offsets) if offsets else none
        order = np.argsort(grams, kind="stable")
        self.owners, self.offsets = owners[order], offsets[order]
        self.grams, self.starts, self.counts = np.unique(grams[order], return_index=True, return_counts=True)
        self.table = np.zeros(_TABLE, dtype=bool)
        self.table[(self.grams & np.uint64(_TABLE - 1)).astype(np.int64)] = True

    def proposals(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, least diagonal of the band, greatest, one to start a window at)."""
        if not len(self.grams):
            return
        begin, held = 0, 0
        for i, text in enumerate(texts):
            held += len(text)
            if held >= PART or i + 1 == len(texts):
                for first, *rest in self._proposed(texts[begin : i + 1]):
                    yield begin + first, *rest
                begin, held = i + 1, 0

    def _proposed(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        values = np.frombuffer(b"\0".join(texts), dtype=np.uint8)
        hashes = Rolling(BYTE_SYMBOLS[values]).all(self.gram)
        at = np.flatnonzero(self.table[(hashes & np.uint64(_TABLE - 1)).astype(np.int64)])
        found = np.minimum(np.searchsorted(self.grams, hashes[at]), len(self.grams) - 1)
        hit = self.grams[found] == hashes[at]
        at, found = at[hit], found[hit]
        many = self.counts[found]
        total = np.cumsum(many)
        begin = 0
        while begin < len(at):  # in parts, as a frequent gram may belong to many items
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + 2_000_000)))
            yield from self._bands(at[begin:end], found[begin:end], many[begin:end], starts)
            # Bands may go on in the next part: step back by the longest item.
            if end >= len(at):
                break
            back = int(np.searchsorted(at, at[end - 1] - 2 * self.longest))
            begin = back if back > begin else end

    def _bands(self, at, found, many, starts) -> Iterator[tuple[int, int, int, int, int]]:
        slot = np.repeat(self.starts[found] - np.cumsum(many) + many, many) + np.arange(many.sum())
        position, gram = np.repeat(at, many), np.repeat(found, many)
        item = self.owners[slot]
        text = np.searchsorted(starts, position, side="right") - 1
        # Texts with fewer grams of an item than any passage needs are done.
        pair = text * self.items + item
        low = int(pair.min())
        some = np.bincount(pair - low)[pair - low] >= self.needed[item]
        if not some.any():
            return
        slot, position, gram, item, text = (x[some] for x in (slot, position, gram, item, text))
        diagonal = position - self.offsets[slot] - starts[text]
        width = 2 * self.allowed[item] + 1
        # Two rows of bands, shifted by half, so that some band holds all diagonals of a passage.
        shifted = diagonal + (1 << 40)
        bands = np.concatenate((shifted // (2 * width) * 2, (shifted + width) // (2 * width) * 2 + 1))
        key = np.stack([np.tile(text, 2), np.tile(item, 2), bands, np.tile(gram, 2)])
        order = np.lexsort(key[::-1])
        key, diagonal, offset = key[:, order], np.tile(diagonal, 2)[order], np.tile(self.offsets[slot], 2)[order]
        if not key.shape[1]:
            return
        new = np.concatenate(([True], (key[:3, 1:] != key[:3, :-1]).any(axis=0)))
        first = np.flatnonzero(new)
        fresh = new | np.concatenate(([True], key[3, 1:] != key[3, :-1]))
        distinct = np.add.reduceat(fresh.astype(np.int64), first)
        enough = distinct >= self.needed[key[1, first]]
        ends = np.append(first[1:], key.shape[1])
        for k in np.flatnonzero(enough):
            own, early = diagonal[first[k] : ends[k]], offset[first[k] : ends[k]]
            values, support = np.unique(own, return_counts=True)
            low, high = int(values[0]), int(values[-1])
            best = values[np.argsort(-support, kind="stable")[:SUPPORTED]]
            for start in {low, high, int(own[early.argmin()]), *best.tolist()}:
                yield int(key[0, first[k]]), int(key[1, first[k]]), low, high, start


class Items:
    """A block of benchmark items and their grams."""

    def __init__(self, ids: list, texts: list[bytes], edits: float) -> None:
        self.ids, self.texts = ids, texts
        self.allowed = np.array([int(edits * len(t)) for t in texts], dtype=np.int64)
        self.short = [i for i, t in enumerate(texts) if 0 < len(t) < SHORT]
        small = [i for i, t in enumerate(texts) if SHORT <= len(t) < SMALL]
        large = [i for i, t in enumerate(texts) if len(t) >= SMALL]
        self.grams = [_Grams(texts, small, self.allowed, SMALL_GRAM), _Grams(texts, large, self.allowed, GRAM)]

    def leaks(self, texts: list[bytes], recall: float) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, edits, end of the passage), the best of each text and item."""
        windows, items, regions = [], [], []
        proposed = dict.fromkeys(p for grams in self.grams for p in grams.proposals(texts))
        for text, item, low, high, start in proposed:
            size, slack = len(self.texts[item]), int(self.allowed[item])
            start = min(max(start, 0), max(len(texts[text]) - size, 0))
            windows.append(texts[text][start : start + size])
            items.append(self.texts[item])
            regions.append((text, item, max(0, low - slack), high + size + slack))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        done = set()
        for begin in range(0, len(windows), 2_000):
            part = slice(begin, begin + 2_000)
            for k in np.flatnonzero(collide(windows[part], items[part], recall)):
                region = regions[begin + int(k)]
                if region in done:
                    continue
                done.add(region)
                text, item, low, high = region
                edits, end = best_stretch(self.texts[item], texts[text][low:high])
                if edits <= self.allowed[item]:
                    best[text, item] = min(best.get((text, item), (edits, low + end)), (edits, low + end))
        for i in self.short:
            sought = b" " + self.texts[i] + b" "
            for j, text in enumerate(texts):
                found = (b" " + text + b" ").find(sought)
                if found >= 0:
                    best[j, i] = (0, found + len(self.texts[i]))
        for (text, item), (edits, end) in best.items():
            yield text, item, edits, end


def leaked(
    docs: DataFrame,
    benchmark: DataFrame,
    edits: float = EDITS,
    recall: float = 0.999,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Rows (id, item, ``edits``, ``passage_end``): the best match of each document and item that leaks into it.

    ``passage_end`` is the end of the passage in the normalised text, in bytes.
    """
    items = benchmark.select(F.col(f"`{item_col}`").alias("i"), F.col(f"`{item_text_col}`").cast("string").alias("t"))
    texts = docs.select(
        F.col(f"`{id_col}`").alias("_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("_text"),
    )
    kind, item_kind = texts.schema["_id"].dataType, items.schema["i"].dataType
    schema = f"_id {kind.simpleString()}, _item {item_kind.simpleString()}, edits int, passage_end int"
    blocks = max(1, -(-items.count() // BLOCK))
    parts = []
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("t", "i"), F.lit(blocks)) == block).collect()
        shared = docs.sparkSession.sparkContext.broadcast(
            ([r.i for r in rows], [normalised((r.t or "").encode()) for r in rows])
        )

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = Items(*shared.value, edits)
            item_type = None
            for batch in (part for whole in batches for part in by_bytes(whole, 1, 1 << 24)):
                texts = [normalised(t) for t in batch.column(1).to_pylist()]
                found = list(own.leaks(texts, recall))
                if found:
                    ids = batch.column(0).to_pylist()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[f[0]] for f in found], batch.schema.field(0).type),
                            pa.array([own.ids[f[1]] for f in found], item_type),
                            pa.array([f[2] for f in found], pa.int32()),
                            pa.array([f[3] for f in found], pa.int32()),
                        ],
                        names=["_id", "_item", "edits", "passage_end"],
                    )

        parts.append(texts.mapInArrow(search, schema))
    whole = reduce(DataFrame.unionByName, parts)
    return whole.withColumnsRenamed({"_id": id_col, "_item": item_col})
