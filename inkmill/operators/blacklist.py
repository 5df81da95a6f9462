"""User blacklist of advertisements: maintenance, and similarity matching of paragraphs.

A match is an entry inside the paragraph, the paragraph inside an entry, or two texts alike by
sequence ratio or trigram overlap. Texts of which one holds the other meet by six-grams that both offer. Texts that are alike
share nothing rare for certain, so paragraphs stream past blocks of entries of a fitting length, each against a whole block at
once: by shared trigrams, by shared characters, and those that share enough by their longest common subsequence, which bounds
the sequence ratio. No match is lost.
"""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.functions.arrays import unnest
from inkmill.functions.text import normalize_match_text, split_paragraphs, strip
from inkmill.operators.keyed import lookup_by_key
from inkmill.session import stored

# Lengths and thresholds of a match.
MIN_LENGTH = 6
MIN_FUZZY_LENGTH = 10
MIN_FUZZY_RATIO = 0.35
MIN_CONTAINED_RATIO = 0.65
LIMIT = 0.78

# With lengths a, b and M matched characters the sequence ratio 2M/(a+b) reaches LIMIT only if min/max >= LIMIT/(2-LIMIT).
# The overlap 2k/(x+y) of two sets needs the same of their sizes. M never exceeds the characters that the texts share.
MIN_SEQUENCE_RATIO = LIMIT / (2 - LIMIT)


class Added(NamedTuple):
    entries: DataFrame
    rejected: DataFrame


def read_entries(raw: DataFrame) -> DataFrame:
    """Usable entries ``(id, text, norm, ordinal, created_at)``; those without id or text are dropped."""
    text = strip(F.coalesce(F.col("text").cast("string"), F.lit("")))
    ident = strip(F.coalesce(F.col("id").cast("string"), F.lit("")))
    created = F.col("created_at") if "created_at" in raw.columns else F.lit(None)
    return (
        raw.select(ident.alias("id"), text.alias("text"), F.col("ordinal"), created.cast("string").alias("created_at"))
        .filter((F.col("id") != "") & (F.col("text") != ""))
        .withColumn("norm", normalize_match_text(F.col("text")))
        .select("id", "text", "norm", "ordinal", "created_at")
    )


def add_entries(entries: DataFrame, additions: DataFrame) -> Added:
    """Add ``additions(text, ordinal, created_at)``.

    Too short texts are rejected; a text equal to a known one after normalisation keeps the known row.
    """
    new = additions.select(strip(F.col("text")).alias("text"), "ordinal", F.col("created_at").cast("string"))
    new = new.withColumn("norm", normalize_match_text(F.col("text")))
    last = F.broadcast(entries.agg(F.coalesce(F.max("ordinal"), F.lit(-1)).alias("last")))  # one row
    usable = (
        new.filter(F.length("norm") >= MIN_LENGTH)
        .join(last)
        .select(
            F.substring(F.sha2("norm", 256), 1, 16).alias("id"),
            "text",
            "norm",
            (F.col("last") + 1 + F.col("ordinal")).alias("ordinal"),
            "created_at",
        )
    )
    added = usable.groupBy("norm").agg(F.min_by(F.struct("id", "text", "ordinal", "created_at"), "ordinal").alias("r"))
    fresh = added.join(entries.select("norm"), "norm", "left_anti").select(
        "r.id", "r.text", "norm", "r.ordinal", "r.created_at"
    )
    return Added(entries.unionByName(fresh), new.filter(F.length("norm") < MIN_LENGTH).drop("norm"))


def remove_entry(entries: DataFrame, entry_id: str) -> DataFrame:
    return entries.filter(~F.col("id").eqNullSafe(F.lit(entry_id)))


def remove_entries(entries: DataFrame, ids: DataFrame) -> DataFrame:
    return entries.join(ids.select("id"), "id", "left_anti")


NEAR, ALIKE, WITHIN, AROUND = range(4)
_CELLS = 1 << 20
_WINDOWS = (1, 8, 32)  # six-grams from which the least is taken, the most that an entry has
_STEP = 1.5  # lengths in one class reach from one to this
_BLOCK = 1 << 15  # characters of the entries of one block, about
_TASKS, _GROUPS = 4, 4  # tasks to each shuffle partition, as they differ in length, and groups of a block and texts to each task
SIGNATURE = "kind int, token long, len int"


def _hashed(tokens: np.ndarray) -> np.ndarray:
    x = tokens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (_hashed(tokens) >> np.uint64(44)).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)


def _trigrams(codes: np.ndarray) -> np.ndarray:
    return np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:])


def _sixes(codes: np.ndarray) -> np.ndarray:
    """Hashes of all six-grams."""
    n = len(codes) - MIN_LENGTH + 1
    made = np.zeros(n, dtype=np.uint64)
    for k in range(MIN_LENGTH):
        made = _hashed(made.view(np.int64) + codes[k : k + n])
    return made >> np.uint64(2)


def _least(hashes: np.ndarray, window: int) -> np.ndarray:
    """The least ones of each ``window`` neighbours, in order, without direct repeats."""
    window, reach = min(window, len(hashes)), 1
    while reach < window:
        step = min(reach, window - reach)
        hashes = np.minimum(hashes[:-step], hashes[step:])
        reach += step
    return hashes[np.concatenate(([True], hashes[1:] != hashes[:-1]))]


def _window(length: int) -> int:
    return max(w for w in _WINDOWS if w <= length - MIN_LENGTH + 1)


def _whole_tokens(codes: np.ndarray, is_entry: bool) -> list[tuple[int, np.ndarray]]:
    """Tokens by which texts meet of which one holds the other.

    An entry inside a paragraph: its least six-gram is the least of some window of the paragraph too. A paragraph inside an
    entry is at least ``LIMIT`` of it, so its least six-gram is the least of some window of that length in the entry.
    """
    sixes = _sixes(codes)
    salted = lambda h, w: _hashed((h ^ np.uint64(w)).view(np.int64)).view(np.int64) & np.int64((1 << 62) - 1)
    if is_entry:
        least = int(np.ceil(LIMIT * len(codes) - 1e-9))
        return [
            (WITHIN, salted(sixes.min(keepdims=True), _window(len(codes)))),
            (AROUND, salted(_least(sixes, max(least - MIN_LENGTH + 1, 1)), 99)),
        ]
    found = [salted(_least(sixes, w), w) for w in _WINDOWS if w <= len(sixes)]
    return [(WITHIN, np.concatenate(found)), (AROUND, salted(sixes.min(keepdims=True), 99))]


def _part_tokens(codes: np.ndarray, sequence: bool = True) -> list[tuple[int, np.ndarray]]:
    """What alike texts share: trigrams, and with ``sequence`` the characters, whose number bounds the sequence ratio."""
    if len(codes) < MIN_FUZZY_LENGTH:
        return []
    alike = [(ALIKE, _trigrams(codes))]
    return [(NEAR, codes), *alike] if sequence else alike


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of the tokens of entries."""
    for batch in batches:
        kinds, cells = [], []
        for text in batch.column(1).to_pylist():
            for kind, tokens in _whole_tokens(_codes(text), True):
                kinds.append(np.full(len(tokens), kind, dtype=np.int32))
                cells.append(_cell(tokens).astype(np.int32))
        if kinds:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(kinds)), pa.array(np.concatenate(cells))], names=["kind", "cell"]
            )


def _signatures(texts: DataFrame, counts, is_entry: bool, name: str) -> DataFrame:
    """Rows (name, kind, token, len) of texts(name, norm): the tokens by which texts meet of which one holds the other.

    Entries are counted in the cells of a table of fixed size; tokens of empty cells are in no entry and need not be asked for.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for batch in batches:
            held, rows = [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes = _codes(text)
                for kind, tokens in _whole_tokens(codes, is_entry):
                    tokens = np.unique(tokens[table[kind][_cell(tokens)] > 0])
                    held.append((key, kind, tokens, len(codes)))
                    rows += len(tokens)
                if rows > 100_000:
                    yield _signature_rows(held, name)
                    held, rows = [], 0
            if rows:
                yield _signature_rows(held, name)

    return texts.mapInArrow(make, f"{name} long, {SIGNATURE}")


def _signature_rows(held: list[tuple], name: str) -> pa.RecordBatch:
    sizes = [len(h[2]) for h in held]
    spread = lambda i, kind: pa.array(np.repeat(np.array([h[i] for h in held], dtype=kind), sizes))
    tokens = pa.array(np.concatenate([h[2] for h in held]))
    return pa.RecordBatch.from_arrays(
        [spread(0, np.int64), spread(1, np.int32), tokens, spread(3, np.int32)], names=[name, "kind", "token", "len"]
    )


def _filled(entries: DataFrame) -> dict[int, np.ndarray]:
    """How often the tokens of each cell occur among the entries; 8 MB, whatever their number."""
    table = {kind: np.zeros(_CELLS, dtype=np.int32) for kind in (WITHIN, AROUND)}
    cells = entries.select("ordinal", "norm").mapInArrow(_counted, "kind int, cell int").groupBy("kind", "cell").count()
    for batch in cells.toArrow().to_batches():  # at most twice the cells
        kinds, at, n = (batch.column(i).to_numpy() for i in range(3))
        for kind, counts in table.items():
            own = kinds == kind
            counts[at[own]] = np.minimum(n[own], 1 << 30)
    return table


def _ranges(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` numbers from each start on, one range after the other."""
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())


class _Block:
    """Entries that a text is compared with all at once."""

    def __init__(self, ordinals: list[int], norms: list[str], sequence: bool) -> None:
        self.sequence = sequence
        sized = sorted(zip(map(len, norms), ordinals, norms, strict=True))
        self.ordinals, codes = np.array([o for _, o, _ in sized]), [_codes(n) for *_, n in sized]
        self.lengths = np.array([len(c) for c in codes])
        grams = [_trigrams(c) for c in codes]
        self.sizes = np.array([len(g) for g in grams])
        every, owner = np.concatenate(grams), np.repeat(np.arange(len(codes)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.grams, first = np.unique(every[order], return_index=True)
        self.owners, self.bounds = owner[order], np.append(first, len(every))
        if sequence:
            self.chars, at = np.unique(np.concatenate(codes), return_inverse=True)
            owner = np.repeat(np.arange(len(codes)), self.lengths)
            place = np.concatenate([np.arange(n) for n in self.lengths])
            self.counts = np.zeros((len(self.chars), len(codes)), np.int32)
            np.add.at(self.counts, (at, owner), 1)
            # Bits of the places of every character, a free one behind each entry for what is carried out of it.
            self.words = self.lengths // 64 + 1
            self.starts = np.cumsum(self.words) - self.words
            self.bits = np.zeros((len(self.chars), self.words.sum()), np.uint64)
            bit = np.uint64(1) << (place & 63).astype(np.uint64)
            np.bitwise_or.at(self.bits, (at, self.starts[owner] + (place >> 6)), bit)
            self.full = np.bitwise_or.reduce(self.bits, axis=0)

    def _shared_grams(self, grams: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.grams, grams)
        at = at[self.grams[np.minimum(at, len(self.grams) - 1)] == grams]
        taken = _ranges(self.bounds[at], self.bounds[at + 1] - self.bounds[at])
        return np.bincount(self.owners[taken], minlength=len(self.ordinals))

    def _subsequences(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries that share enough characters with the text, and how long their common subsequences are."""
        a, least = len(codes), MIN_SEQUENCE_RATIO - 1e-9
        first, last = np.searchsorted(self.lengths, [a * least, a / least])
        if first == last:
            return np.arange(0), np.arange(0)
        own, back, n = np.unique(codes, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.chars, own)
        known = self.chars[np.minimum(at, len(self.chars) - 1)] == own
        shared = np.minimum(self.counts[at[known], first:last], n[known, None]).sum(axis=0)
        chosen = first + np.flatnonzero(2 * shared >= (LIMIT - 1e-9) * (a + self.lengths[first:last]))
        if not len(chosen):
            return chosen, chosen
        taken = _ranges(self.starts[chosen], self.words[chosen])
        masks = [int.from_bytes(m.tobytes(), "little") for m in self.bits[np.ix_(at[known], taken)]]
        full = self.full[taken]
        text = (np.cumsum(known) - 1)[back[known[back]]]
        v = _unmatched(map(masks.__getitem__, text.tolist()), int.from_bytes(full.tobytes(), "little"))
        left = np.bitwise_count(np.frombuffer(v.to_bytes(full.nbytes, "little"), np.uint64)).astype(np.int64)
        ends = np.cumsum(self.words[chosen])
        return chosen, self.lengths[chosen] - np.add.reduceat(left, ends - self.words[chosen])

    def alike(self, norm: str) -> np.ndarray:
        """Ordinals of the entries that may score ``LIMIT`` by trigrams, or by the sequence ratio with ``sequence``."""
        codes = _codes(norm)
        found = np.zeros(len(self.ordinals), dtype=bool)
        for kind, tokens in _part_tokens(codes, self.sequence):
            if kind == ALIKE:
                found |= 2 * self._shared_grams(tokens) >= (LIMIT - 1e-9) * (len(tokens) + self.sizes)
            else:
                chosen, most = self._subsequences(tokens)
                found[chosen] |= 2 * most >= (LIMIT - 1e-9) * (len(codes) + self.lengths[chosen])
        return self.ordinals[found]


def _class(length: Column) -> Column:
    return F.floor(F.log(length) / F.lit(math.log(_STEP))).cast("int")


def alike_pairs(norms: DataFrame, entries: DataFrame, sequence: bool = True) -> DataFrame:
    """Pairs ``(norm, ordinal)`` that may be alike: no pair that scores ``LIMIT`` by trigrams or sequence ratio is missing.

    An entry is put into a block of every class of lengths it may be alike to. Blocks come first in their groups,
    so a task holds one block and lets the texts of its class pass by.
    """
    spark = norms.sparkSession
    size = F.length("norm")
    least = F.greatest(F.ceil(size * MIN_FUZZY_RATIO - 1e-6), F.lit(MIN_FUZZY_LENGTH))
    classes = F.sequence(_class(least), _class(F.floor(size / MIN_FUZZY_RATIO + 1e-6)))
    placed = entries.filter(size >= MIN_FUZZY_LENGTH).select(
        F.col("ordinal").cast("long").alias("ordinal"), "norm", F.explode(classes).alias("class")
    )
    number = placed.groupBy("class").agg(F.ceil(F.sum(size) / F.lit(_BLOCK)).alias("n"))
    held = (
        placed.join(number, "class")
        .groupBy("class", F.pmod(F.xxhash64("norm"), F.col("n")).alias("block"))
        .agg(F.collect_list(F.struct("ordinal", "norm")).alias("held"))
    )
    blocks = stored(held, "blacklist-blocks")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    deals = math.ceil(_GROUPS * _TASKS * parts / max(blocks.count(), 1))
    group = ["class", "block", "deal"]
    dealt = blocks.select("class", "block", F.explode(F.expr(f"sequence(0L, {deals - 1}L)")).alias("deal"), "held")
    texts = norms.select("norm", _class(size).alias("class"), F.pmod(F.xxhash64("norm"), F.lit(deals)).alias("deal"))
    asked = texts.filter(size >= MIN_FUZZY_LENGTH).join(blocks.select("class", "block"), "class")
    rows = dealt.withColumn("norm", F.lit(None).cast("string")).unionByName(asked, allowMissingColumns=True)
    ordered = rows.repartition(_TASKS * parts, *group).sortWithinPartitions(*group, F.col("norm").isNotNull())

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            found, ordinals = [], []
            for norm, held in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                if norm is None:
                    block = _Block([h["ordinal"] for h in held], [h["norm"] for h in held], sequence)
                    continue
                alike = block.alike(norm).tolist()
                found += [norm] * len(alike)
                ordinals += alike
            if found:
                yield pa.RecordBatch.from_pydict({"norm": pa.array(found, pa.string()), "ordinal": pa.array(ordinals, pa.int64())})

    return ordered.select("norm", "held").mapInArrow(meet, "norm string, ordinal long")


def candidate_pairs(norms: DataFrame, entries: DataFrame, sequence: bool = True) -> DataFrame:
    """Pairs ``(norm, ordinal)`` that may match: no pair that scores ``LIMIT`` is missing.

    Without ``sequence`` pairs that only the sequence ratio could bring there are not looked for.
    """
    spark = norms.sparkSession
    table = spark.sparkContext.broadcast(_filled(entries))
    # The signatures of the list are written first: by their size the planner broadcasts them or shuffles both sides.
    asked = _signatures(entries.select(F.col("ordinal").cast("long"), "norm"), table, True, "ordinal")
    keys = stored(asked.withColumnRenamed("len", "e_len"), "blacklist-keys")
    offered = _signatures(norms.select(F.xxhash64("norm").alias("pid"), "norm"), table, False, "pid")
    a, b = F.col("len"), F.col("e_len")
    possible = F.when(F.col("kind") == WITHIN, a >= b).otherwise((a <= b) & (a >= b * LIMIT - 1e-6))
    # Both sides are exchanges of the join's own, so the partition of a common token can be split.
    met = offered.join(keys.hint("rebalance"), ["kind", "token"]).filter(possible)
    # Paragraphs go by their hash here, so text is moved once per pair. Equal hashes can only let more through.
    pairs = met.select("pid", "ordinal").distinct()
    whole = pairs.join(norms.withColumn("pid", F.xxhash64("norm")), "pid").select("norm", "ordinal")
    return whole.unionByName(alike_pairs(norms, entries, sequence)).distinct()


def _unmatched(masks: Iterable[int], full: int) -> int:
    """Places (of ``full``) outside the longest common subsequence with a text, whose characters' places are ``masks``.

    Bit by bit for whole entries at once; what an entry carries out falls on a bit that is not in ``full``.
    """
    v = full
    for mask in masks:
        u = v & mask
        v = ((v + u) | (v - u)) & full
    return v


def _subsequence(text: str, masks: dict[str, int], length: int) -> int:
    """Length of the longest common subsequence."""
    return length - _unmatched((masks.get(c, 0) for c in text), (1 << length) - 1).bit_count()


class _Entry:
    """An entry with what its comparisons need."""

    def __init__(self, norm: str) -> None:
        self.norm = norm
        self.grams = {norm[i : i + 3] for i in range(len(norm) - 2)}
        self.masks: dict[str, int] = {}
        for i, c in enumerate(norm):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def score(self, p: str, sequence: bool) -> tuple[float, str] | None:
        a, b = len(p), len(self.norm)
        if self.norm in p:
            return 1.0, "contains"
        if p in self.norm and a >= b * MIN_CONTAINED_RATIO:
            return a / b, "contained"
        if min(a, b) < MIN_FUZZY_LENGTH or min(a, b) / max(a, b) < MIN_FUZZY_RATIO:
            return None
        grams = {p[i : i + 3] for i in range(a - 2)}
        score = 2 * len(grams & self.grams) / (len(grams) + len(self.grams))
        # The matched characters are a common subsequence, so its length bounds the ratio.
        if sequence and min(a, b) / max(a, b) >= MIN_SEQUENCE_RATIO - 1e-9:
            most = 2 * _subsequence(p, self.masks, b) / (a + b)
            if most >= max(score, LIMIT - 1e-9):
                score = max(score, difflib.SequenceMatcher(None, p, self.norm, autojunk=False).ratio())
        return score, "fuzzy"


_ENTRIES_KEPT = 5_000


def scored_pairs(pairs: DataFrame, sequence: bool = True) -> DataFrame:
    """Scores of pairs ``(norm, ordinal, entry_id, entry_norm)`` that reach the limit; without ``sequence`` by trigrams alone."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Entry] = {}
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            rows = []
            for norm, ordinal, ident, text in zip(*columns, strict=True):
                entry = known.get(text)
                if entry is None:
                    if len(known) >= _ENTRIES_KEPT:
                        known.clear()
                    entry = known[text] = _Entry(text)
                found = entry.score(norm, sequence)
                if found is not None and found[0] >= LIMIT:
                    rows.append((norm, ordinal, ident, *found))
            if rows:
                names = ["norm", "ordinal", "entry_id", "score", "method"]
                yield pa.RecordBatch.from_pydict({n: list(v) for n, v in zip(names, zip(*rows), strict=True)}, _SCORED)

    chosen = pairs.select("norm", F.col("ordinal").cast("long").alias("ordinal"), "entry_id", "entry_norm")
    return chosen.mapInArrow(score, "norm string, ordinal long, entry_id string, score double, method string")


_SCORED = pa.schema(
    [("norm", pa.string()), ("ordinal", pa.int64()), ("entry_id", pa.string()), ("score", pa.float64()), ("method", pa.string())]
)


def all_matches(norms: DataFrame, blacklist: DataFrame, sequence: bool = True) -> DataFrame:
    """Every match ``(norm, ordinal, entry_id, score, method)``; of entries alike after normalisation the first."""
    entries = blacklist.filter(F.length("norm") >= MIN_LENGTH).groupBy("norm").agg(
        F.min(F.struct(F.col("ordinal").cast("long").alias("ordinal"), F.col("id").alias("id"))).alias("e")
    )
    entries = stored(entries.select("e.ordinal", F.col("e.id").alias("entry_id"), F.col("norm")), "blacklist-entries")
    # Paragraphs repeat; each text is matched once. They are read three times, so they are written.
    distinct = stored(norms.select("norm").filter(F.length("norm") >= MIN_LENGTH).distinct(), "blacklist-texts")
    named = entries.withColumnRenamed("norm", "entry_norm")
    return scored_pairs(candidate_pairs(distinct, entries, sequence).join(named, "ordinal"), sequence)


def best_matches(norms: DataFrame, blacklist: DataFrame, sequence: bool = True) -> DataFrame:
    """Best entry per normalised text ``(norm, score, method, entry_id)``; ties go to the first entry."""
    best = F.max_by(
        F.struct("score", "method", "entry_id"), F.struct(F.col("score"), (-F.col("ordinal")).alias("o"))
    )
    return all_matches(norms, blacklist, sequence).groupBy("norm").agg(best.alias("m")).select("norm", "m.*")


def normalized_paragraphs(chapters: DataFrame) -> DataFrame:
    """``(book_id, chapter_index, paragraph, norm)`` of all paragraphs."""
    rows = unnest(chapters, ["book_id", "chapter_index"], split_paragraphs(F.col("text")), "p", "paragraph")
    return rows.select("book_id", "chapter_index", "paragraph", normalize_match_text(strip(F.col("p"))).alias("norm"))


def paragraph_matches(chapters: DataFrame, blacklist: DataFrame) -> DataFrame:
    """``(book_id, chapter_index, paragraph, score, method, entry_id)`` of the matched paragraphs."""
    paragraphs = normalized_paragraphs(chapters)
    found = best_matches(paragraphs.select("norm"), blacklist)
    return lookup_by_key(paragraphs, found, ["norm"]).filter("score is not null").drop("norm")
