"""Conversation structure repair by lightest derivations (Knuth's generalisation of Dijkstra's algorithm).

The rows of a conversation become a sequence of roles ``(s?(ua)+)?`` by edits: Keep, Rerole, Delete, Insert. A partial
repair is an item ``(rows used, role last put out)``. A hyperedge joins an item and one edit, an axiom with a cost and a
letter, into the next item; its function adds the costs and appends the letter. Values are (cost, audit), compared as
pairs. The function is superior: no result is less than what it is made of. It is monotone too: two audits of one item
that cost the same never begin with one another, for more letters would be inserts, which cost. So the agenda pops
items in the order of their least values, and the first goal item popped is the cheapest repair with the least audit.

Rows are sorted by (conversation, turn, role, text) over ranges, so a conversation of any size is cut:

* Inside a range rows are taken in blocks of ``BLOCK``. A conversation that begins and ends in its range is repaired there.
* Those at the ends of a range, and very long ones, go on as blocks, and meet by conversation. A block's lightest exits
  from an item are themselves axioms of a derivation over blocks. Blocks stream past in order; a task holds one block,
  four items and their digests, so memory does not grow with the rows. Only the digest of a repaired conversation, which
  is sequential by its definition, and its audit make one task see all blocks of a long one.
* Rows that repeat inside a conversation are collapsed before the sort; a row met ``copies`` times is one row.

Null roles and texts count as one space, null conversations are one conversation, null turns come first. Rows of one turn
are ordered by role and text. Empty and white texts are blank. Long texts are never cut. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from inkmill.llm.common import bitmap, with_bit, written
from inkmill.llm.repeats import by_bytes

BLOCK = 128  # rows whose repairs are derived at once
BLOCK_BYTES = 1 << 22
HELD = 32  # blocks of one conversation that a range keeps before it passes them on
START, SYSTEM, USER, ASSISTANT = range(4)
GOALS = (START, ASSISTANT)

# What an edit costs, and the roles that may follow.
DELETE, REROLE, INSERT, CUT = 3, 2, 2, 1
FOLLOWS = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LEGAL = ("su", "ua", "au")
SPACE = " \t\n\x0b\x0c\r"
DAMAGES = 20

Row = tuple  # (role, initial, text, stays, cut, deletes)
Value = tuple[int, str]


def axioms(state: int, row: Row) -> list[tuple[int, str, int]]:
    """Edits of a row after ``state`` as (cost, letters, next state); ``deletes`` copies have to go in any case."""
    _, initial, _, stays, cut, deletes = row
    gone, letters = DELETE * deletes, "D" * deletes
    if not stays:
        return [(gone, letters, state)]
    follow, found = FOLLOWS[state], INITIALS.get(initial)
    made = [(gone + DELETE, "D" + letters, state), (gone + REROLE + cut, "R" + letters, follow)]
    if found == follow or (found == SYSTEM and state == START):
        made.append((gone + cut, "K" + letters, found))
    return made


def lightest(rows: list[Row], start: int, goals: tuple[int, ...] = ()) -> dict[int, Value]:
    """Least values of the items after all rows, from ``start``; with ``goals`` only that which finalises first."""
    agenda = [(0, "", 0, start)]
    final: set[tuple[int, int]] = set()
    ends: dict[int, Value] = {}
    n = len(rows)
    while agenda:
        cost, audit, used, state = heappop(agenda)
        if (used, state) in final:
            continue
        final.add((used, state))
        if used == n:
            if not goals or state in goals:
                ends[state] = (cost, audit)
            if state in goals or len(ends) == 4:
                break
        else:
            for more, letters, after in axioms(state, rows[used]):
                if (used + 1, after) not in final:
                    heappush(agenda, (cost + more, audit + letters, used + 1, after))
        if (used, FOLLOWS[state]) not in final:
            heappush(agenda, (cost + INSERT, audit + "I", used, FOLLOWS[state]))
    return ends


def repaired(rows: list[Row], start: int, audit: str) -> Iterator[tuple[str, bytes]]:
    """Roles and texts that an audit leaves, block by block; the letters alone tell the roles."""
    state, at = start, 0
    for row in [*rows, None]:
        while at < len(audit) and audit[at] == "I":
            state = FOLLOWS[state]
            yield NAMES[state], b""
            at += 1
        if row is None:
            return
        role, initial, text, stays, _, deletes = row
        if stays:
            if audit[at] == "K":
                state = INITIALS[initial]
                yield role, text
            elif audit[at] == "R":
                state = FOLLOWS[state]
                yield NAMES[state], text
            at += 1
        at += deletes


def _fed(digest, lines: Iterator[tuple[str, bytes]], empty: bool):
    """A digest after more lines, and whether it has seen none yet."""
    digest = digest.copy()
    for role, text in lines:
        digest.update((b"" if empty else b"\n") + role.encode() + b":" + text)
        empty = False
    return digest, empty


# ---- what is told of a conversation, block by block -----------------------------------------------




class Block:
    """Rows of one conversation that follow each other, with their counts."""

    def __init__(self) -> None:
        self.rows: list[Row] = []
        self.bytes = 0
        self.least = self.most = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = None

    def add(self, turn, role: str, text: bytes, copies: int, again: bool, blank: bool, cut: bool) -> None:
        if not copies:
            return  # tells only that the conversation is there
        if turn is not None and turn != self.most:
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.most = turn
        initial = role[:1]
        if self.last is not None:
            self.illegal += self.last + initial not in LEGAL
        self.first = initial if self.first is None else self.first
        self.last = initial
        self.illegal += copies - 1
        stays = not (blank or again)
        if blank:
            self.blank += copies
        else:
            self.duplicate += copies - stays
            self.truncated += stays and cut
        self.rows.append((role, initial, text, stays, int(cut), copies - stays))
        self.bytes += len(text)

    def full(self, most: int) -> bool:
        return len(self.rows) >= most or self.bytes >= BLOCK_BYTES


class Conversation:
    """A derivation over blocks: the four items after the blocks so far, each with its value and digest."""

    def __init__(self) -> None:
        self.items = {START: ((0, ""), hashlib.sha256(), True)}
        self.all = Block()

    def add(self, block: Block, last: bool = False) -> None:
        whole = self.all
        if block.turns:
            whole.turns += block.turns - (whole.most == block.least)
            whole.least = block.least if whole.least is None else whole.least
            whole.most = block.most
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(whole, name, getattr(whole, name) + getattr(block, name))
        if block.rows:
            whole.illegal += whole.last is not None and whole.last + block.first not in LEGAL
            whole.last = block.last
        found: dict[int, tuple] = {}
        for start, ((cost, audit), _, _) in self.items.items():
            for end, (more, letters) in lightest(block.rows, start, GOALS if last else ()).items():
                value = (cost + more, audit + letters)
                if end not in found or value < found[end][0]:
                    found[end] = (value, start, letters)
        self.items = {
            end: (value, *_fed(self.items[start][1], repaired(block.rows, start, letters), self.items[start][2]))
            for end, (value, start, letters) in found.items()
        }

    def result(self) -> tuple:
        (cost, audit), digest, _ = min(
            (item for state, item in self.items.items() if state in GOALS), key=lambda item: item[0]
        )
        t = self.all
        gaps = 0 if t.least is None else t.most - t.least + 1 - t.turns
        return gaps, t.blank, t.duplicate, t.truncated, t.illegal, cost, audit, digest.hexdigest()


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_RESULT = ", ".join(f"{n} long" for n in RESULT[:6]) + ", audit string, repaired_sha256 string"
_ROWS = "array<struct<role:string,initial:string,text:binary,stays:boolean,cut:int,deletes:long>>"
_BLOCK = "least long, most long, turns long, first string, last string, _rows " + _ROWS
_ARROW_ROWS = pa.list_(
    pa.struct(
        [("role", pa.string()), ("initial", pa.string()), ("text", pa.binary()), ("stays", pa.bool_()),
         ("cut", pa.int32()), ("deletes", pa.int64())]
    )
)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    """Rows (conversation, part, seq, result or None, block or None) as a batch."""
    out: dict[str, pa.Array] = {
        "conv_id": pa.array([r[0] for r in rows], kind),
        "part": pa.array([r[1] for r in rows], pa.int32()),
        "seq": pa.array([r[2] for r in rows], pa.int64()),
    }
    for i, name in enumerate(RESULT):
        values = [r[3][i] if r[3] else getattr(r[4], name, None) for r in rows]
        out[name] = pa.array(values, pa.string() if i > 5 else pa.int64())
    for name in ("least", "most", "turns", "first", "last"):
        values = [getattr(r[4], name) if r[4] else None for r in rows]
        out[name] = pa.array(values, pa.string() if name in ("first", "last") else pa.int64())
    names = ("role", "initial", "text", "stays", "cut", "deletes")
    listed = [[dict(zip(names, row, strict=True)) for row in r[4].rows] if r[4] else None for r in rows]
    out["_rows"] = pa.array(listed, _ARROW_ROWS)
    return pa.RecordBatch.from_pydict(out)


def _ranges(kind: pa.DataType, most: int):
    """Repairs the conversations of a sorted range; those that may go on elsewhere come out as blocks."""

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        made: list[tuple] = []
        size = seq = 0
        own, blocks, passing, any_row = None, [Block()], True, False

        def passed() -> int:
            """Blocks so far go on to where the conversation's other blocks are."""
            nonlocal seq
            moved = 0
            for block in blocks:
                made.append((own, part, seq, None, block))
                seq += 1
                moved += block.bytes
            blocks.clear()
            return moved

        for batch in (p for whole in batches for p in by_bytes(whole, 3, 1 << 24)):
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for conv, *row in zip(*columns, strict=True):
                if not any_row or conv != own:
                    if any_row:
                        if passing:
                            size += passed()
                        else:
                            whole = Conversation()
                            for i, block in enumerate(blocks):
                                whole.add(block, i == len(blocks) - 1)
                            made.append((own, part, 0, whole.result(), None))
                    # The first conversation of a range may have begun in the one before.
                    own, blocks, passing, any_row = conv, [Block()], not any_row, True
                if blocks[-1].full(most):
                    if len(blocks) >= HELD:
                        passing = True
                    if passing:
                        size += passed()
                    blocks.append(Block())
                blocks[-1].add(*row)
                if size > 4 * BLOCK_BYTES or len(made) >= 2_000:
                    yield _batch(made, kind)
                    made, size = [], 0
        if any_row:
            passed()  # the last one may go on in the next range
        if made:
            yield _batch(made, kind)

    return repair


def _meet(kind: pa.DataType):
    """Repairs conversations from their blocks, which come in order."""

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, whole, any_row, made = None, Conversation(), False, []
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if not any_row or r["conv_id"] != own:
                    if any_row:
                        made.append((own, 0, 0, whole.result(), None))
                    own, whole, any_row = r["conv_id"], Conversation(), True
                block = Block()
                block.rows = [tuple(row.values()) for row in r["_rows"]]
                for name in ("least", "most", "turns", "first", "last", "blank", "duplicate", "truncated", "illegal"):
                    setattr(block, name, r[name])
                whole.add(block)
                if len(made) >= 2_000:
                    yield _batch(made, kind)
                    made = []
        if any_row:
            made.append((own, 0, 0, whole.result(), None))
        if made:
            yield _batch(made, kind)

    return repair


# ---- the table --------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage by a hash of conversation and turn; ``copies`` tells how often a row is there."""
    key = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(key[0], F.lit(":"), key[1]).cast("binary")) % DAMAGES
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return (
        conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), kind.alias("_kind"))
        .select(
            "conv_id", "turn",
            F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
            F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.translate("text", ".!?", ""))
            .otherwise(F.col("text")).alias("text"),
            F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1).cast("long").alias("copies"),
        )
    )


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Counts, cost, audit and digest of each conversation of ``rows(conv_id, turn, role, text, copies)``.

    Rows of no copies only name their conversation.
    """
    there = rows.filter("copies > 0").withColumn("_digest", F.md5("text"))
    # A row that is surely the only one of its role and text in its conversation does not move for that.
    groups = there.groupBy("conv_id", "role", "_digest").agg(F.count("*").alias("n"))
    same = F.xxhash64("conv_id", "role", "_digest")
    marks = bitmap(groups.filter("n > 1"), same, "dialogue-repeats")
    flagged = with_bit(there, same, marks, "_repeated")
    once = flagged.filter("NOT _repeated").select("conv_id", "turn", "role", "text", "copies", F.lit(False).alias("again"))
    collapsed = written(
        flagged.filter("_repeated").groupBy("conv_id", "turn", "role", "text", "_digest").agg(F.sum("copies").alias("copies")),
        "dialogue-copies",
    )
    firsts = collapsed.groupBy("conv_id", "role", "_digest").agg(
        F.bool_or(F.col("turn").isNull()).alias("_first_null"), F.min("turn").alias("_first")
    )
    firsts = firsts.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(firsts.columns[:3])], "_first_null", "_first")
    several = collapsed.join(
        firsts.hint("rebalance").hint("merge"),
        collapsed["conv_id"].eqNullSafe(firsts["_0"]) & (collapsed["role"] == firsts["_1"]) & (collapsed["_digest"] == firsts["_2"]),
    )
    again = F.when(F.col("_first_null"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("_first"))
    several = several.select("conv_id", "turn", "role", "text", "copies", again.alias("again"))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    named = rows.filter("copies = 0").select("conv_id").distinct().select(
        "conv_id", F.lit(None).cast(kinds["turn"]).alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"),
        F.lit(0).cast("long").alias("copies"), F.lit(False).alias("again"),
    )
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    judged = once.unionByName(several).unionByName(named).select(
        "conv_id", "turn", "role", "text", "copies", "again",
        (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    order = ["conv_id", "turn", "role", "text"]
    ranged = judged.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("text", F.col("text").cast("binary"))
    conv = kinds["conv_id"]
    kind = to_arrow_type(conv)
    schema = f"conv_id {conv.simpleString()}, part int, seq long, {_RESULT}, {_BLOCK}"
    first = written(ranged.mapInArrow(_ranges(kind, block), schema), "dialogue-ranges")
    open_ = first.filter("_rows IS NOT NULL")
    met = open_.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_meet(kind), schema)
    return first.filter("_rows IS NULL").select("conv_id", *RESULT).unionByName(met.select("conv_id", *RESULT))
