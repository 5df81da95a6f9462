"""Token counts of byte-level BPE at every prefix of a text, by prefix dynamic programming.

The encoding of a piece without its last token is the encoding of what is left. So the last token of each
prefix is the one token that ends there and goes together with the last token of the shorter prefix, and the
count is one more than the shorter prefix has. Two tokens go together when undoing their merges, latest first,
never meets a merge across the border that the encoder would have made earlier.

A text is cut into units: white space with the piece after it. What follows a unit does not change the counts
of its prefixes, so that counts add up along the text. Units repeat; each worker keeps a table of them, bounded in
number and bytes. Short pieces are worked out together, all prefixes of one length at a time. A long piece without a
break goes by itself: an automaton of all tokens names those that end at each byte, longest first, and what goes
together is remembered; time and memory are linear in the piece.

``prefix_counts`` gives one row per document: id, ``n_bytes``, ``n_tokens`` and ``steps``: for each UTF-8 byte of
the text a signed byte, the count of the prefix that ends there less the one before. Running sums of ``steps``
are the counts at every prefix; ``fitting`` cuts texts to a budget from them and encodes nothing again. A prefix
that ends inside a character counts its bytes as they stand.

Null texts count as empty: no bytes, no tokens, no steps. Strings of special tokens inside a text count as one
token, as the library has it by default. Repeated rows give repeated answers, null ids are handed through.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.llm.common import text_or_empty

KEPT_UNITS = 400_000  # units a worker remembers
KEPT_BYTES = 64_000_000  # and their bytes
KEPT_BORDERS = 1_000_000  # pairs of tokens whose border is remembered
LONG_PIECE = 256  # bytes from which a piece is worked out by itself
CHUNK_BYTES = 4_000_000  # text that a worker looks at together

# How the vocabulary cuts texts into pieces, here with the white space before a piece.
_SPACE = r"\p{White_Space}"
_BLANKS = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_UNIT = (
    rf" ?\p{{L}}++"
    rf"|(?:{_SPACE}*[^\P{{White_Space}}\ ])?'(?:s|t|re|ve|m|ll|d)"
    rf"|{_SPACE}*+(?:\p{{L}}++|\p{{N}}++|[^{_SPACE}\p{{L}}\p{{N}}]++)|{_SPACE}+"
)
_SHORT_ENDINGS = ("'re", "'ve", "'ll")


def _printable_bytes() -> dict[str, int]:
    """Vocabulary files write each byte as a printable character: itself, or one from 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens by number: the bytes first, then one for each merge in the order of the merges."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        to_byte = _printable_bytes()
        self.specials = [t["content"] for t in data["added_tokens"]]
        merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        number = {c: b for c, b in to_byte.items()}
        self.left = np.arange(256 + len(merges), dtype=np.int64)
        self.right = self.left.copy()
        for i, (a, b) in enumerate(merges):
            self.left[256 + i], self.right[256 + i] = number[a], number[b]
            number[a + b] = 256 + i
        pairs = self.left[256:] << 20 | self.right[256:]
        order = np.argsort(pairs)
        self._pairs, self._made = pairs[order], order + 256
        # A token that does not encode to itself is never part of an encoding.
        names = list(number)
        plain = Tokenizer.from_file(path).model
        whole = [t for t in names if len(plain.tokenize(t)) == 1]
        nodes: dict[tuple[int, int], int] = {}
        tokens = [-1]
        self._ending = ahocorasick.Automaton()
        self._merged = dict(zip(pairs.tolist(), range(256, 256 + len(merges)), strict=True))
        self._parts = list(zip(self.left.tolist(), self.right.tolist(), strict=True))
        self._borders: dict[int, bool] = {}
        for name in whole:
            self._ending.add_word("".join(chr(to_byte[c]) for c in name), (len(name), number[name]))
            at = 0
            for c in name:
                key = (at, to_byte[c])
                if key not in nodes:
                    nodes[key] = len(tokens)
                    tokens.append(-1)
                at = nodes[key]
            tokens[at] = number[name]
        edges = np.fromiter((n << 8 | b for n, b in nodes), dtype=np.int64, count=len(nodes))
        order = np.argsort(edges)
        self._edges = edges[order]
        self._child = np.fromiter(nodes.values(), dtype=np.int64, count=len(nodes))[order]
        self._token = np.array(tokens, dtype=np.int32)
        self._ending.make_automaton()

    def fits(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether the encoder leaves each two tokens next to each other as they are."""
        fine = np.ones(len(first), dtype=bool)
        at = np.arange(len(first))
        a, b, later = first.astype(np.int64), second.astype(np.int64), np.full(len(first), 1 << 40)
        while at.size:
            pair = a << 20 | b
            found = np.minimum(np.searchsorted(self._pairs, pair), len(self._pairs) - 1)
            merged = (self._pairs[found] == pair) & (self._made[found] < later)
            fine[at[merged]] = False
            # Of both, undo the later merge; bytes cannot be undone.
            open_a, open_b = a >= 256, b >= 256
            undo_a = open_a & ((a > b) | ~open_b)
            later = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            go = ~merged & (open_a | open_b)
            at, a, b, later = at[go], a[go], b[go], later[go]
        return fine

    def _border(self, a: int, b: int) -> bool:
        """:meth:`fits` for one pair of tokens."""
        later = 1 << 40
        while True:
            if self._merged.get(a << 20 | b, later) < later:
                return False
            if a >= 256 and (a > b or b < 256):
                later, a = a, self._parts[a][1]
            elif b >= 256:
                later, b = b + 1, self._parts[b][0]
            else:
                return True

    def long_prefixes(self, piece: bytes) -> np.ndarray:
        """Token counts at every prefix of one piece, from its first byte to its last."""
        last, counts = array("i", bytes(4 * len(piece))), array("i", bytes(4 * len(piece)))
        known, done = self._borders, -1
        for end, (size, token) in self._ending.iter(piece.decode("latin-1")):
            if end == done:  # a longer token went together with what is before it
                continue
            before = end - size
            if before >= 0:
                pair = last[before] << 20 | token
                fine = known.get(pair)
                if fine is None:
                    if len(known) >= KEPT_BORDERS:
                        known.clear()
                    fine = known[pair] = self._border(last[before], token)
                if not fine:
                    continue
                counts[end] = counts[before] + 1
            else:
                counts[end] = 1
            last[end], done = token, end
        return np.frombuffer(counts, dtype=np.int32)

    def prefixes(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token counts at every prefix of all pieces, one after the other, and where each piece starts."""
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        starts = np.cumsum(sizes) - sizes
        short = [p for p in pieces if len(p) < LONG_PIECE]
        if len(short) == len(pieces):
            return self._short_prefixes(pieces)
        counts = np.zeros(int(sizes.sum()), dtype=np.int32)
        counts[np.repeat(sizes < LONG_PIECE, sizes)] = self._short_prefixes(short)[0]
        for i in np.flatnonzero(sizes >= LONG_PIECE).tolist():
            counts[starts[i] : starts[i] + sizes[i]] = self.long_prefixes(pieces[i])
        return counts, starts

    def _short_prefixes(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        starts = np.cumsum(sizes) - sizes
        text = np.frombuffer(b"".join(pieces), dtype=np.uint8).astype(np.int64)
        ends = np.repeat(starts + sizes, sizes)
        starting: list[np.ndarray] = []  # by length less one: the token that starts at each byte, or -1
        at, node = np.arange(len(text)), np.zeros(len(text), dtype=np.int64)
        while at.size:
            step = node << 8 | text[at + len(starting)]
            found = np.minimum(np.searchsorted(self._edges, step), len(self._edges) - 1)
            hit = self._edges[found] == step
            at, node = at[hit], self._child[found[hit]]
            tokens = np.full(len(text), -1, dtype=np.int32)
            tokens[at] = self._token[node]
            starting.append(tokens)
            inside = at + len(starting) < ends[at]
            at, node = at[inside], node[inside]
        last = np.zeros(len(text), dtype=np.int64)
        counts = np.zeros(len(text), dtype=np.int32)
        order = np.argsort(-sizes, kind="stable")
        longest, begins = -sizes[order], starts[order]
        for i in range(1, int(sizes.max(initial=0)) + 1):
            # The last bytes of the prefixes of length i, as long as they have no token.
            left = begins[: np.searchsorted(longest, -i, side="right")] + (i - 1)
            for size in range(min(i, len(starting)), 0, -1):
                begin = left - (size - 1)
                token = starting[size - 1][begin]
                maybe = np.flatnonzero(token >= 0)
                if not maybe.size:
                    continue
                if size < i:
                    maybe = maybe[self.fits(last[begin[maybe] - 1], token[maybe])]
                done = left[maybe]
                last[done] = token[maybe]
                counts[done] = 1 if size == i else counts[begin[maybe] - 1] + 1
                keep = np.ones(len(left), dtype=bool)
                keep[maybe] = False
                left = left[keep]
                if not left.size:
                    break
        return counts, starts


class PrefixCounter:
    """Steps and totals of texts, with a bounded table of units."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self._units = regex.compile(_UNIT)
        specials = [regex.escape(s) for s in sorted(self.vocabulary.specials, key=len, reverse=True)]
        self._special = regex.compile("(" + "|".join(specials) + ")") if specials else None
        self._steps: dict[str, bytes] = {}
        self._totals: dict[str, int] = {}
        self._held = 0

    def _learn(self, units: set[str], with_steps: bool) -> None:
        known = self._steps if with_steps else self._totals
        new = [u for u in units if u not in known]
        self._held += sum(map(len, new))
        # Most units are a word with one space or none before it: one piece each.
        plain = [u for u in new if u.lstrip(_BLANKS) in (u, u[1:]) and u[0] in (" ", u.lstrip(_BLANKS)[:1])]
        plain = [u for u in plain if u not in _SHORT_ENDINGS]
        if plain:
            pieces = [u.encode() for u in plain]
            counts, starts = self.vocabulary.prefixes(pieces)
            ends = np.append(starts[1:], len(counts))
            self._totals.update(zip(plain, counts[ends - 1].tolist(), strict=True))
            if with_steps:
                steps = np.diff(counts, prepend=0)
                steps[starts] = 1
                data = steps.astype(np.int8).tobytes()
                cuts = zip(starts.tolist(), ends.tolist(), strict=True)
                self._steps.update(zip(plain, (data[a:b] for a, b in cuts), strict=True))
        rest = list(set(new).difference(plain))
        for unit, values in zip(rest, self._values(rest), strict=True):
            self._totals[unit] = int(values[-1])
            self._steps[unit] = np.diff(values, prepend=0).astype(np.int8).tobytes()

    def _values(self, units: list[str]) -> Iterator[np.ndarray]:
        """Counts at the prefixes of units with white space of their own.

        At the end of a text white space is one piece; before anything else its last character belongs to
        the piece that follows if it is a space, and stands alone if not.
        """
        parts = []
        for unit in units:
            core = unit.lstrip(_BLANKS)
            run = unit[: len(unit) - len(core)]
            parts.append((run, run[-1:], run[-1:] + core if run[-1:] == " " and core else core))
        pieces = list({piece for part in parts for piece in part})
        data = [piece.encode() for piece in pieces]
        counts, starts = self.vocabulary.prefixes(data)
        own = {p: counts[a : a + len(d)] for p, d, a in zip(pieces, data, starts.tolist(), strict=True)}
        for run, last, tail in parts:
            values = own[run]
            if tail:
                head = len(values) - len(last.encode())
                before = int(values[head - 1]) if head else 0
                if last == " ":
                    added = own[tail][1:]
                else:
                    added = own[tail] + (int(own[last][-1]) if last else 0)
                values = np.concatenate((values, added + before))
                if tail in _SHORT_ENDINGS:
                    values[-2] = values[-3] + 1  # the sign alone, then a letter
            yield values

    def _segment(self, text: str) -> list[str]:
        return self._units.findall(text)

    def _pieces(self, text: str) -> list[str]:
        if self._special is None or not any(s in text for s in self.vocabulary.specials):
            return [text]
        return self._special.split(text)

    def count(self, texts: list[str], with_steps: bool) -> list[tuple[int, bytes | None]]:
        if len(self._totals) > KEPT_UNITS or self._held > KEPT_BYTES:
            self._steps.clear()
            self._totals.clear()
            self._held = 0
        parts = [self._pieces(t) for t in texts]
        plain = [self._segment(p[0]) if len(p) == 1 else None for p in parts]
        wanted: set[str] = set()
        for units, pieces in zip(plain, parts, strict=True):
            if units is not None:
                wanted.update(units)
            else:
                for i in range(0, len(pieces), 2):
                    wanted.update(self._segment(pieces[i]))
                    wanted.update(self._segment("".join(pieces[i : i + 2])))
        self._learn(wanted, with_steps or any(u is None for u in plain))
        total, step = self._totals.__getitem__, self._steps.__getitem__
        found: list[tuple[int, bytes | None]] = []
        for units, pieces in zip(plain, parts, strict=True):
            if units is not None:
                found.append((sum(map(total, units)), b"".join(map(step, units)) if with_steps else None))
                continue
            counted, steps = 0, b""
            for i in range(0, len(pieces), 2):
                own = sum(map(total, self._segment(pieces[i])))
                if i + 1 < len(pieces):  # a special string: one token as soon as it is whole
                    together = b"".join(map(step, self._segment(pieces[i] + pieces[i + 1])))[:-1]
                    rest = own + 1 - int(np.frombuffer(together, dtype=np.int8).sum(dtype=np.int64))
                    steps += together + np.int8(rest).tobytes()
                    own += 1
                else:
                    steps += b"".join(map(step, self._segment(pieces[i])))
                counted += own
            found.append((counted, steps if with_steps else None))
        return found


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_counts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", steps: bool = True
) -> DataFrame:
    """Id, ``n_bytes``, ``n_tokens`` and, unless ``steps`` is off, the step of every prefix."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            ids, texts, sizes = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            begin = 0
            while begin < len(sizes):
                end, held = begin, 0
                while end < len(sizes) and (end == begin or held + sizes[end] <= CHUNK_BYTES):
                    held += sizes[end]
                    end += 1
                found = own.count(texts.slice(begin, end - begin).to_pylist(), steps)
                columns = [
                    ids.slice(begin, end - begin),
                    pa.array(sizes[begin:end], pa.int64()),
                    pa.array([n for n, _ in found], pa.int64()),
                ]
                names = ["_id", "n_bytes", "n_tokens"]
                if steps:
                    columns.append(pa.array([s for _, s in found], pa.binary()))
                    names.append("steps")
                yield pa.RecordBatch.from_arrays(columns, names=names)
                begin = end

    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), text_or_empty(f"`{text_col}`").alias("_text")).withColumn(
        "_size", F.octet_length("_text").cast("long")
    )
    kind = texts.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, n_bytes long, n_tokens long" + ", steps binary" * steps
    return texts.mapInArrow(count, schema).withColumnRenamed("_id", id_col)


def counts_from(steps: bytes) -> np.ndarray:
    """Token counts at every prefix, from the shortest to the whole text."""
    return np.cumsum(np.frombuffer(steps, dtype=np.int8), dtype=np.int64)


def fitting(text: Column, steps: Column, budget: int) -> Column:
    """The longest prefix of each text, cut between characters, that has at most ``budget`` tokens."""

    @F.pandas_udf("string")
    def cut(texts, all_steps):
        import pandas as pd

        kept = []
        for value, own in zip(texts, all_steps, strict=True):
            data = (value or "").encode()
            good = np.concatenate(([True], counts_from(own or b"") <= budget))
            whole = np.concatenate(((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80, [True]))
            kept.append(data[: int(np.flatnonzero(good & whole)[-1])].decode())
        return pd.Series(kept)

    return cut(text, steps)
