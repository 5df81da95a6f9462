"""Toxicity by a noisy channel: disguised words are restored first, then the restored text is scored.

* A character language model of order four is counted over all documents: 32 symbols (letters, digits, the rest in classes), so
  its table has 2^20 cells whatever the input. It is interpolated with the lower orders.
* The channel turns letters into digits and signs that look like them, puts blanks or signs between letters, repeats
  letters, and masks them. A token that shows a trace of this becomes a lattice: every character offers what it may
  have been, at the price of that disguise, and Viterbi's algorithm finds the path that model and channel together make likeliest.
  Tokens of plain letters have one path only, themselves, and are not decoded.
* Restored texts are scored by the beginnings of their words, hashed to ``CELLS`` cells. How many labelled documents of either
  kind hold a cell is counted over all documents with labels; the cells that tell toxic ones are kept, the ``MOST`` that tell
  most. What a document has of them becomes a probability by a logistic curve. It is fitted on at most ``SAMPLE`` labelled
  documents, which the cells were not counted on.

Labels are learnt from only where ``held_out`` is false: documents whose CRC-32 of the id as text is not divisible by 5.
Null ids count as empty text there, which is held out. Null texts are empty; they and empty ones get what a text without
any sign gets. Texts of any length are read whole. Equal texts get equal scores. Of several labels of one id the largest
counts; null labels are not used. If no labelled document is toxic, or all are, the rate shrunk to a half is every score.
Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.llm.common import bitmap, lookup, with_bit, written
from inkmill.llm.quality import logistic
from inkmill.llm.repeats import by_bytes

FOLDS, HELD, FITTED = 5, 0, 4  # by CRC-32: fold 0 is held out, fold 4 fits the curve, the others are counted
CELLS = 1 << 22
MOST = 50_000  # cells that a model keeps
SAMPLE = 8_000  # labelled documents that the curve is fitted on, at most
EVIDENCE = 18.0  # how many nats a cell has to tell, so that none of some million cells does by chance
PREFIXES = (4, 5, 6, 8)  # bytes of beginnings of words that are cells, next to whole words
KNOWN_WORDS = 600_000  # words a worker remembers

# ---- the character model ------------------------------------------------------------------------

SYMBOLS, ORDER = 32, 4
GRAMS = SYMBOLS**ORDER
_CONTEXTS = SYMBOLS ** (ORDER - 1)
BREAK, DIGIT, SIGN, HIGH = 0, 27, 28, 29
_KIND = np.full(256, SIGN, dtype=np.int64)
_KIND[[0x20, 9, 10, 11, 12, 13]] = BREAK
_KIND[[ord(c) for c in ".,;:!?\"'()"]] = BREAK
_KIND[48:58] = DIGIT
_KIND[65:91] = np.arange(1, 27)
_KIND[97:123] = np.arange(1, 27)
_KIND[128:192] = HIGH
_KIND[192:] = HIGH + 1

# Signs that stand for letters, those that may stand between letters, and those that mask one.
LOOKS: dict[str, str] = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
BETWEEN = " .-_*~'`,/\\"
MASKS = "*#%"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Prices in nats: a look-alike, a blank or sign between letters, a repeated letter, a mask, and a sign that is only itself.
LOOK, GAP, REPEAT, MASK, PLAIN = 2.5, 1.0, 1.0, 2.0, 2.0


def symbols(text: bytes) -> np.ndarray:
    return _KIND[np.frombuffer(text, dtype=np.uint8)]


def gram_counts(text: bytes) -> np.ndarray:
    """Counts of the four-symbol sequences of a text, as a table of ``GRAMS`` cells."""
    s = symbols(b"   " + text + b" ")
    n = len(s) - ORDER + 1
    codes = s[:n]
    for k in range(1, ORDER):
        codes = codes * SYMBOLS + s[k : k + n]
    return np.bincount(codes, minlength=GRAMS)


def character_model(counts: np.ndarray) -> np.ndarray:
    """Costs (negative logarithms) of a symbol after three, interpolated by Witten and Bell's rule."""
    below = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(1, ORDER + 1):
        table = counts.reshape(SYMBOLS ** (ORDER - order), -1).sum(axis=0).reshape(-1, SYMBOLS).astype(np.float64)
        total, kinds = table.sum(axis=1, keepdims=True), (table > 0).sum(axis=1, keepdims=True)
        lower = np.tile(below.reshape(-1, SYMBOLS), (table.shape[0] // max(below.size // SYMBOLS, 1), 1))
        below = np.where(total > 0, (table + kinds * lower) / np.maximum(total + kinds, 1), lower)
    return -np.log(below).ravel().astype(np.float32)


# ---- lattice and decoding -------------------------------------------------------------------------

Arc = tuple[int, str, float]  # end, letters put out, price


def lattice(token: str) -> list[list[Arc]]:
    """Arcs from each place of a token: what its characters may have been before the channel."""
    arcs: list[list[Arc]] = []
    n = len(token)
    for i, c in enumerate(token):
        run = i + 1
        while run < n and token[run] == c:
            run += 1
        own: list[Arc] = []
        if c.isalpha():
            own.append((i + 1, c, 0.0))
            if run - i >= 3:  # a run may stand for one letter or two
                own += [(run, c, REPEAT), (run, c * 2, REPEAT)]
        elif c == " ":
            own.append((i + 1, " ", 0.0))
        else:
            own.append((i + 1, c, PLAIN))
        for letter in LOOKS.get(c, ""):
            own.append((i + 1, letter, LOOK))
            if run - i >= 3:
                own.append((run, letter, LOOK + REPEAT))
        if c in BETWEEN and 0 < i < n - 1:
            own.append((run, "", GAP))
        if c in MASKS:
            own += [(i + 1, letter, MASK) for letter in LETTERS]
        arcs.append(own)
    return arcs


@cache
def _codes(letters: str) -> tuple[int, ...]:
    return tuple(symbols(letters.encode()).tolist())


def decode(token: str, costs) -> str:
    """The likeliest text behind a token, by Viterbi over places and the last three symbols; ties go to the least text."""
    best: list[dict[int, tuple[float, str]]] = [{0: (0.0, "")}] + [{} for _ in token]
    for i, arcs in enumerate(lattice(token)):
        coded = [(best[end], letters, price, _codes(letters)) for end, letters, price in arcs]
        for context, (cost, text) in best[i].items():
            for ends, letters, price, steps in coded:
                c, state = cost + price, context
                for s in steps:
                    c += costs[state * SYMBOLS + s]
                    state = (state * SYMBOLS + s) % _CONTEXTS
                held = ends.get(state)
                if held is None or c < held[0] or (c == held[0] and text + letters < held[1]):
                    ends[state] = (c, text + letters)
    return min((cost + costs[state * SYMBOLS + BREAK], text) for state, (cost, text) in best[-1].items())[1]


#: A trace of the channel: three single characters in a row with blanks between, a letter next to a sign or digit, or a run of three.
_SPACED = r"(?<![^\s])\S(?:[ ]\S){2,}(?![^\s])"
_MIXED = r"[^\W\d_][0-9@$!|+(<€£¡*#%._~`/\\-]+[^\W_]|[0-9@$!|+(<€£¡][^\W\d_]|([^\W\d_])\1\1"
_TOKEN = re.compile(_SPACED + r"|\S+")
_RUN = re.compile(_SPACED)
_MAY_RUN = re.compile(r" \S \S(?!\S)")
_TRACE = re.compile(_MIXED)
LONGEST_TOKEN = 64  # longer ones are decoded in parts of this length
_ENDS = "\"'()[]{}<>.,;:!?-_*~`/\\"


class Restorer:
    """Texts without disguise."""

    def __init__(self, costs: np.ndarray) -> None:
        self._costs = array("f", costs.tolist())

    def token(self, token: str) -> str:
        """A token as it is, or if it shows a trace of the channel, what is likeliest behind it."""
        spaced = len(token) > 4 and token[1] == " "
        if not spaced and not _TRACE.search(token):
            return token
        bare = token.strip(_ENDS)
        parts = [bare[i : i + LONGEST_TOKEN] for i in range(0, len(bare), LONGEST_TOKEN)]
        return "".join(decode(p, self._costs) for p in parts) if bare else token

    def restore(self, text: str) -> str:
        """The text in lower case with its disguised tokens restored."""
        return _TOKEN.sub(lambda m: self.token(m.group()), text.lower())

    @staticmethod
    def tokens(text: str) -> list[str]:
        """What may be words: tokens, and runs of single characters as one token each."""
        low = text.lower()
        found = low.split()
        if _MAY_RUN.search(low):
            found += _RUN.findall(low)
        return found


# ---- scoring --------------------------------------------------------------------------------------

_SPLIT = re.compile(r"[^\W\d_]+")


def cells(word: str) -> list[int]:
    """Cells of a word: itself and its beginnings, each hashed with its kind."""
    b = word.encode()
    return [crc32(b, 1) % CELLS, *[crc32(b[:n]) % CELLS for n in PREFIXES if len(b) >= n]]


class Seen:
    """Tokens met before, restored once, with the cells or the weights of their words."""

    def __init__(self, restorer: Restorer, weights: dict[int, float] | None = None) -> None:
        self._restorer, self._weights = restorer, weights
        self._known: set[str] = set()
        self._told: dict[str, tuple] = {}

    def _meet(self, tokens: set[str]) -> None:
        """Works out tokens that are new; only those that tell something are kept with it."""
        if len(self._known) >= KNOWN_WORDS:
            self._known.clear()
            self._told.clear()
            return self._meet_all(tokens)
        return self._meet_all(tokens - self._known)

    def _meet_all(self, new: set[str]) -> None:
        for token in new:
            words = _SPLIT.findall(self._restorer.token(token))
            if self._weights is None:
                self._told[token] = tuple(c for w in words for c in cells(w))
            else:
                best = (max((self._weights.get(c, 0.0) for c in cells(w)), default=0.0) for w in words)
                if found := tuple(x for x in best if x):
                    self._told[token] = found
        self._known |= new

    def distinct(self, text: str) -> np.ndarray:
        """The cells of a text."""
        tokens = set(self._restorer.tokens(text))
        self._meet(tokens)
        found: set[int] = set()
        for token in tokens:
            found.update(self._told[token])
        return np.fromiter(found, dtype=np.int64, count=len(found))

    def signs(self, text: str) -> tuple[float, float, float]:
        """The strongest sign, all of them, and how many there are for the length."""
        tokens = self._restorer.tokens(text)
        self._meet(set(tokens))
        told = self._told
        found = [x for t in tokens if t in told for x in told[t]]
        return max(found, default=0.0), float(np.log1p(sum(found))), 10 * len(found) / (len(tokens) + 20)


@dataclass
class Model:
    """What is learnt: a table of fixed size, at most ``MOST`` weights, and a curve."""

    costs: np.ndarray
    weights: dict[int, float] = field(default_factory=dict)
    curve: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def score(self, seen: Seen, text: str) -> float:
        x = float(np.array(seen.signs(text)) @ self.curve[:-1] + self.curve[-1])
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def fold(ids: Column) -> Column:
    return F.crc32(F.coalesce(ids.cast("string"), F.lit("")).cast("binary")) % FOLDS


def _strings(data: pa.Array) -> list[str]:
    return [t.decode("utf-8", "replace") for t in data.to_pylist()]


def _language(texts: DataFrame) -> np.ndarray:
    """The character model of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(GRAMS, dtype=np.int64)
        for batch in (p for whole in batches for p in by_bytes(whole, 1, 1 << 20)):
            total += gram_counts(b"   ".join(batch.column(1).to_pylist()))
        at = np.flatnonzero(total)
        for i in range(0, len(at), 100_000):
            some = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["gram", "n"])

    table = texts.select("_id", "_text").mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(GRAMS, dtype=np.int64)
    rows = table.toArrow()  # at most GRAMS rows
    counts[rows.column("gram").to_numpy()] = rows.column("n").to_numpy()
    return character_model(counts)


def _telling(labelled: DataFrame, costs) -> dict[int, float]:
    """Cells that tell toxic documents, with the logarithm of how much more often they hold them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen(Restorer(costs.value))
        held = np.zeros((2, CELLS), dtype=np.int32)
        docs = np.zeros(2, dtype=np.int64)
        for batch in (p for whole in batches for p in by_bytes(whole, 1, 1 << 22)):
            for text, toxic in zip(_strings(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                held[toxic, seen.distinct(text)] += 1
                docs[toxic] += 1
        at = np.flatnonzero(held.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1], pa.int32()), pa.array(docs[:1]), pa.array(docs[1:])], names=["cell", "clean", "toxic"]
        )
        for i in range(0, len(at), 100_000):
            some = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), *[pa.array(h[some].astype(np.int64)) for h in held]],
                names=["cell", "clean", "toxic"],
            )

    counted = written(
        labelled.select("_id", "_text", "_toxic").mapInArrow(count, "cell int, clean long, toxic long")
        .groupBy("cell").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")),
        "toxicity-cells",
    )
    whole = counted.filter("cell = -1").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).first()
    if not whole.clean or not whole.toxic:
        return {}
    n, p = F.col("clean") + F.col("toxic"), F.lit(whole.toxic / (whole.toxic + whole.clean))
    share = F.col("toxic") / n
    # n times the divergence of the cell's share from the rate: what the cell tells, in nats.
    away = n * (share * F.log(share / p) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - p))).otherwise(0.0))
    odds = F.log((F.col("toxic") + 0.05) / (whole.toxic + 0.1)) - F.log((F.col("clean") + 0.05) / (whole.clean + 0.1))
    kept = counted.filter("cell >= 0 AND toxic > 0").filter((share > p) & (away >= EVIDENCE))
    kept = kept.select("cell", odds.alias("odds")).filter("odds > 1.5").orderBy(F.desc("odds"), "cell").limit(MOST)
    return {r.cell: float(r.odds) for r in kept.collect()}


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id") -> DataFrame:
    """Id, ``held_out``, ``score`` and ``predicted`` of every document."""
    spark = docs.sparkSession
    texts = docs.select(
        F.col(f"`{id_col}`").alias("_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("_text"),
    )
    costs = _language(texts)
    shared = spark.sparkContext.broadcast(costs)
    known = written(
        labels.filter(F.col(f"`{label_id}`").isNotNull() & F.col("toxic").isNotNull())
        .filter(fold(F.col(f"`{label_id}`")) != HELD)
        .groupBy(F.col(f"`{label_id}`").alias("_id")).agg((F.max("toxic") > 0).cast("int").alias("_toxic")),
        "toxicity-labels",
    )
    # Only documents that may have a label move.
    marks = bitmap(known, F.xxhash64("_id"), "toxicity-labelled")
    asked = with_bit(texts.filter(F.col("_id").isNotNull()), F.xxhash64("_id"), marks, "_asked").filter("_asked")
    labelled = lookup(asked.select("_id", "_text"), known, ["_id"], "inner")
    weights = _telling(labelled.filter(fold(F.col("_id")) != FITTED), shared)
    fitting = known.filter(fold(F.col("_id")) == FITTED)
    share = min(1.0, SAMPLE / max(fitting.count(), 1))
    drawn = F.pmod(F.xxhash64(F.lit("curve"), "_id"), F.lit(1_000_000)) < int(share * 1_000_000)
    told = spark.sparkContext.broadcast(weights)

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen(Restorer(shared.value), told.value)
        for batch in (p for whole in batches for p in by_bytes(whole, 1, 1 << 22)):
            found = [seen.signs(t) for t in _strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([f[i] for f in found], pa.float64()) for i in range(3)], batch.column(2)],
                names=["a", "b", "c", "toxic"],
            )

    sample = lookup(asked.filter(fold(F.col("_id")) == FITTED).filter(drawn).select("_id", "_text"), fitting, ["_id"], "inner")
    rows = sorted(map(tuple, sample.mapInArrow(signs, "a double, b double, c double, toxic int").collect()))
    model = Model(costs, weights, _curve(rows))
    learnt = spark.sparkContext.broadcast(model)
    kind = texts.schema["_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = learnt.value
        seen = Seen(Restorer(own.costs), own.weights)
        for batch in (p for whole in batches for p in by_bytes(whole, 1, 1 << 22)):
            values = [own.score(seen, t) for t in _strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=["_id", "score"])

    found = texts.mapInArrow(score, f"_id {kind}, score double")
    return found.select(
        F.col("_id").alias(id_col), (fold(F.col("_id")) == HELD).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def _curve(rows: list[tuple]) -> np.ndarray:
    """The logistic curve over signs; a constant where the sample has one kind only."""
    curve = np.zeros(4)
    if rows:
        labels = np.array([r[3] for r in rows])
        if 0 < labels.sum() < len(labels):
            return logistic(np.array([r[:3] for r in rows]), labels, ridge=0.1)
        rate = (labels.sum() + 0.5) / (len(labels) + 1)
        curve[-1] = np.log(rate / (1 - rate))
    return curve
