"""Near duplicates by a chosen-path set similarity join.

A document is the set of its distinct shingles in lower case, of five words unless asked otherwise. Documents with equal sets form a class; one of
each goes on. In each of ``TREES`` independent trees a document follows a path of selected tokens, at every level the
shingle with the least hash. A node holds the documents that share a path. Nodes with few documents are compared
exhaustively; larger ones branch by the next token. A pair with a similarity of 0.8 agrees at a level with probability
0.8; nodes of unlike documents are small after few levels, and at four levels 20 trees miss one such pair in 30,000.

Many near copies of one text stay together longer. Once four tokens agree, the documents of a large node are also
compared with leaders: the one that stays in large nodes longest, which is like most others, and the least number. Over
all trees each document has up to 40 leaders and goes on with the best of them. That links dense groups at little cost.
Members of large nodes that it leaves in different components are then joined exactly, on full sets: with shingles in
order from rare to common, two sets similar enough share one in their prefixes, and both have enough left after the
first one they share. Members of one component are not compared again, so dense groups are not compared pair by pair, and
families that share a common core but are not alike enough meet on their rare shingles only.

Inside a node a sketch of one byte for each lane estimates similarities. Of pairs that may reach the threshold, those
go on that hold the node's clusters together by best estimates, a second one for each document, and all between clusters
whose estimates are less than sure. They are confirmed on full sets. Components join them over all documents.

Texts without words have empty sets and are linked with nothing, null texts too; a text of fewer words than a shingle is one. Classes
have numbers of their own, so different texts without an id, or with one id, are linked each by itself. A null id
never is the smallest; its ``component_id`` is null unless another id is reachable. Rows that repeat id and text carry
equal answers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.llm.common import LOWER, UPPER, bitmap, lookup, with_bit, written
from inkmill.llm.components import components
from inkmill.llm.phrases import _IS_SPACE
from inkmill.llm.repeats import BYTE_SYMBOLS, Rolling, by_bytes, mixed

WORDS = 5  # words of a shingle
TREES, LEVELS = 20, 4
LANES = TREES * LEVELS
#: Depths at which nodes are looked at; beyond ``LEVELS`` a path goes on with the tokens of the next trees.
DEPTHS = (1, 2, 3, 4, 6, 9, 14, 22, 34, 52, 80)
SMALL = 48  # a node of so many documents or fewer is compared exhaustively
LED = 3  # leaders that a document of a large node goes on with before the exact join
CELLS = 20  # bits of a shingle's cell, in which members are counted to order shingles from rare to common
SIMILAR = (80, 100)  # a link: 100 * intersection >= 80 * union
MAYBE = 0.60  # least estimate of a pair that is confirmed; four deviations below 0.8
SURE = 0.95
LAST = (1 << 63) - 1  # stands for a null id

_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[[ord(c) for c in UPPER]] = [ord(c) for c in LOWER]
_FACTORS = mixed(np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of ``width`` words of a text."""
    values = _LOWERED[np.frombuffer(text, dtype=np.uint8)]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (~_IS_SPACE[values]).view(np.int8), [0]))))
    words = Rolling(BYTE_SYMBOLS[values]).between(edges[::2], edges[1::2])
    width = min(width, len(words))
    count = len(words) - width + 1 if width else 0
    found = words[:count]
    for i in range(1, width):
        found = mixed(found * np.uint64(0x9FB21C651E98DF25) + words[i : i + count])
    return np.unique(found)


def _signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def signatures(texts: DataFrame, width: int) -> DataFrame:
    """``_id``, ``_hash``, set size ``n``, set hash (``a``, ``b``), ``lanes`` and ``sketch`` from (_id, _hash, _text binary)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_bytes(whole, 2, 1 << 21)):
            sets = [shingles(batch.column(2)[i].as_buffer(), width) for i in range(batch.num_rows)]
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            filled = np.flatnonzero(sizes)
            a, b = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            lanes = np.zeros((len(sets), LANES), dtype=np.uint32)
            if filled.size:
                values = np.concatenate([sets[i] for i in filled])
                starts = np.cumsum(sizes[filled]) - sizes[filled]
                a[filled] = np.add.reduceat(mixed(values), starts)
                b[filled] = np.add.reduceat(mixed(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
                for lane, factor in enumerate(_FACTORS):
                    hashed = ((values * factor) >> np.uint64(32)).astype(np.uint32)
                    lanes[filled, lane] = np.minimum.reduceat(hashed, starts)
            flat = pa.array(lanes.view(np.int32).ravel())
            offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * LANES)
            tail = mixed(lanes.astype(np.uint64)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(sizes), pa.array(_signed(a)), pa.array(_signed(b)),
                    pa.ListArray.from_arrays(offsets, flat), pa.array([r.tobytes() for r in tail], pa.binary()),
                ],
                names=["_id", "_hash", "n", "a", "b", "lanes", "sketch"],
            )

    return texts.select("_id", "_hash", "_text").mapInArrow(
        sign, "_id long, _hash long, n long, a long, b long, lanes array<int>, sketch binary"
    )


def nodes_of(classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The nodes of all trees: (node, _id) of the small ones, and (root, _id, depth) of those that stay large.

    From depth ``LEVELS`` on, what is in a large node keeps that node as its root; the depth is the greatest at which
    its node was large. Every level is a written table.
    """
    own = F.concat(
        F.slice("lanes", F.col("tree") * LEVELS + 1, F.lit(LANES)), F.slice("lanes", F.lit(1), F.col("tree") * LEVELS)
    )
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    rows = classes.select("_id", "lanes", trees).select(
        "_id", "tree", F.lit(None).cast("long").alias("root"),
        F.xxhash64("tree", F.element_at("lanes", F.col("tree") * LEVELS + 1)).alias("node"),
    )
    small, large = [], []
    for depth, following in zip(DEPTHS, [*DEPTHS[1:], None], strict=True):
        counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        level = written(lookup(rows, counts, ["node"], "inner"), f"near-level-{depth}")
        small.append(level.filter(F.col("size") <= SMALL).select("node", "_id"))
        rest = level.filter(F.col("size") > SMALL)
        if depth >= LEVELS:
            rest = rest.withColumn("root", F.coalesce("root", "node"))
            large.append(rest.select("root", "_id", F.lit(depth).alias("depth")))
        if following is None or rest.isEmpty():
            break
        rows = rest.join(classes.select("_id", "lanes"), "_id").select(
            "_id", "tree", "root", F.xxhash64(F.lit(following), "tree", F.slice(own, 1, following)).alias("node")
        )
    return reduce(DataFrame.unionByName, small), reduce(DataFrame.unionByName, large) if large else None


def led(large: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (u, v) of documents in large nodes with the leaders most like them.

    Leaders of a root are its least number, and the one that stayed longest in a large node: what stays agrees with most of
    the others at every level, so it is near the middle of the group. Each document goes on with its ``LED`` best.
    """
    leaders = large.groupBy("root").agg(
        F.array(F.min("_id"), -F.max(F.struct("depth", -F.col("_id")))["col2"]).alias("leaders")
    )
    members = large.select("root", "_id").distinct()
    asked = (
        lookup(members, leaders, ["root"], "inner")
        .select("_id", F.explode("leaders").alias("leader"))
        .filter("_id <> leader")
        .distinct()
    )
    one = lookup(asked, classes.select("_id", F.col("sketch").alias("one")), ["_id"], "inner")
    two = lookup(one, classes.select(F.col("_id").alias("leader"), F.col("sketch").alias("two")), ["leader"], "inner")

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (
                np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(-1, LANES) for k in (2, 3)
            )
            same = (a == b).sum(axis=1)
            keep = pa.array(same >= int(np.ceil(MAYBE * LANES)))
            columns = [batch.column(0), batch.column(1), pa.array(same.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "leader", "same"]).filter(keep)

    near = two.select("_id", "leader", "one", "two").mapInArrow(estimate, "_id long, leader long, same int")
    best = near.groupBy("_id").agg(F.collect_list(F.struct("same", (-F.col("leader")).alias("least"))).alias("all"))
    chosen = best.select("_id", F.explode(F.slice(F.sort_array("all", asc=False), 1, LED)).alias("to")).select(
        "_id", (-F.col("to.least")).alias("leader")
    )
    return chosen.select(F.least("_id", "leader").alias("u"), F.greatest("_id", "leader").alias("v"))


# ---- inside a node --------------------------------------------------------------------------------


def _root(parents: list[int], i: int) -> int:
    while parents[i] != i:
        parents[i] = parents[parents[i]]
        i = parents[i]
    return i


def chosen_pairs(sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a node to confirm, as positions; documents are in order of their ids.

    Rows are compared in blocks with all rows, and nothing but candidates is kept.
    """
    n = len(sketches)
    least = int(np.ceil(MAYBE * LANES))
    left, right, same = [], [], []
    for begin in range(0, n, 64):
        block = (sketches[begin : begin + 64, None, :] == sketches[None, begin:, :]).sum(axis=2, dtype=np.int32)
        i, j = np.nonzero(block >= least)
        ahead = j > i
        left.append(i[ahead] + begin)
        right.append(j[ahead] + begin)
        same.append(block[i[ahead], j[ahead]])
    left, right, same = (np.concatenate(x) for x in (left, right, same))
    if len(left) < 2:
        return left, right
    order = np.lexsort((right, left, -same))
    left, right, same = left[order], right[order], same[order]
    parents, taken = list(range(n)), np.zeros(n, dtype=np.int64)
    keep = np.zeros(len(left), dtype=bool)
    sure = int(np.ceil(SURE * LANES))
    certain = int(np.searchsorted(-same, -sure, side="right"))
    for k, (i, j) in enumerate(zip(left[:certain].tolist(), right[:certain].tolist(), strict=True)):
        a, b = _root(parents, i), _root(parents, j)
        if a != b:
            parents[max(a, b)] = min(a, b)
        if a != b or taken[i] < 2 or taken[j] < 2:
            keep[k] = True
            taken[i] += 1
            taken[j] += 1
    roots = np.array([_root(parents, i) for i in range(n)])
    keep[certain:] = roots[left[certain:]] != roots[right[certain:]]
    return left[keep], right[keep]


def candidates(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (u, v) of documents in small nodes to confirm, u below v."""
    rows = lookup(nodes, classes.select("_id", "sketch"), ["_id"], "inner")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            whole = table.to_batches()[0]
            ids = whole.column(0).to_numpy()
            # The last node of a batch may go on in the next one.
            cut = int(np.searchsorted(ids, ids[-1]))
            rest = whole.slice(cut)
            if cut:
                yield from _pairs(whole.slice(0, cut))
        if rest is not None:
            yield from _pairs(rest)

    sorted_in = rows.repartition(parts, "node").sortWithinPartitions("node", "_id").select("node", "_id", "sketch")
    return sorted_in.mapInArrow(compare, "u long, v long")


def _pairs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    nodes, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    sketches = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(-1, LANES)
    starts = np.flatnonzero(np.concatenate(([True], nodes[1:] != nodes[:-1])))
    sizes = np.diff(np.append(starts, len(nodes)))
    us, vs = [], []
    least = int(np.ceil(MAYBE * LANES))
    two = starts[sizes == 2]
    for begin in range(0, len(two), 10_000):
        some = two[begin : begin + 10_000]
        near = some[(sketches[some] == sketches[some + 1]).sum(axis=1) >= least]
        us.append(ids[near])
        vs.append(ids[near + 1])
    for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        left, right = chosen_pairs(sketches[start : start + size])
        us.append(ids[start + left])
        vs.append(ids[start + right])
    if us:
        u, v = np.concatenate(us), np.concatenate(vs)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def confirmed(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs whose full sets are similar enough; ``texts`` has one row (_id, _text) for each id."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, whole = SIMILAR
        for batch in batches:
            u, v, keep, held, own = batch.column(0), batch.column(1), [], None, None
            for i in range(batch.num_rows):
                if held is None or u[i].as_py() != held:
                    held, own = u[i].as_py(), shingles(batch.column(2)[i].as_buffer(), width)
                other = shingles(batch.column(3)[i].as_buffer(), width)
                shared = len(own) + len(other) - len(np.union1d(own, other))
                keep.append(whole * shared >= part * (len(own) + len(other) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([u.filter(mask), v.filter(mask)], names=["u", "v"])

    first = pairs.join(texts.select(F.col("_id").alias("u"), F.col("_text").alias("_one")).hint("merge"), "u")
    both = first.join(texts.select(F.col("_id").alias("v"), F.col("_text").alias("_two")).hint("merge"), "v")
    return both.select("u", "v", "_one", "_two").mapInArrow(confirm, "u long, v long")


# ---- members of large nodes, exactly ----------------------------------------------------------------


def _commonness(texts: DataFrame, width: int) -> np.ndarray:
    """In how many of the texts the shingles of each cell occur. Of fixed size."""

    span = 1 << CELLS - 4  # cells that travel as one row

    def packed(counts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for part, own in sorted(counts.items()):
            full = np.flatnonzero(own)
            if full.size:
                lists = [pa.array([full.astype(np.int32)], pa.list_(pa.int32())), pa.array([own[full]], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *lists], names=["part", "cells", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELLS, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(cells, shingles(text.as_buffer(), width) >> np.uint64(64 - CELLS), 1)
        yield from packed(dict(enumerate(cells.reshape(-1, span))))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in enumerate(batch.column(0).to_pylist()):
                own = counts.setdefault(part, np.zeros(span, dtype=np.int64))
                own[batch.column(1)[i].values.to_numpy()] += batch.column(2)[i].values.to_numpy()
        yield from packed(counts)

    schema = "part int, cells array<int>, n array<long>"
    found = texts.select("_text").mapInArrow(count, schema).repartition(16, "part").mapInArrow(add, schema)
    cells = np.zeros(1 << CELLS, dtype=np.int32)
    for batch in found.toArrow().to_batches():
        for i, part in enumerate(batch.column(0).to_pylist()):
            own = np.minimum(batch.column(2)[i].values.to_numpy(), (1 << 31) - 1)
            cells[part * span + batch.column(1)[i].values.to_numpy()] = own
    return cells


def _met(group: np.ndarray, ids: np.ndarray, n: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one shingle, of different groups, whose sets may be similar enough.

    ``left`` is how many shingles a set has from this one on. Of the first shingle that two sets share, both have at
    least as many as they must share. Rows of the largest group are met by the others only.
    """
    part, whole = SIMILAR
    kinds, kind, sizes = np.unique(group, return_inverse=True, return_counts=True)
    if len(kinds) < 2:
        return
    others = np.flatnonzero(kind != np.argmax(sizes))
    step = max(1, (1 << 18) // len(ids))
    for begin in range(0, len(others), step):
        some = others[begin : begin + step]
        both = n[some, None] + n[None, :]
        needed = (part * both + part + whole - 1) // (part + whole)
        near = (group[some, None] != group[None, :]) & (left[some, None] >= needed) & (left[None, :] >= needed)
        i, j = np.nonzero(near)
        if i.size:
            one, two = ids[some[i]], ids[j]
            yield np.minimum(one, two), np.maximum(one, two)


def joined(members: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Pairs (u, v) of ``members`` (_id, _group) of different groups to confirm, with all that are similar enough."""
    own = written(members.join(texts.hint("merge"), "_id"), "near-members")
    common = own.sparkSession.sparkContext.broadcast(_commonness(own, width))
    parts = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, whole = SIMILAR
        for batch in (some for whole_batch in batches for some in by_bytes(whole_batch, 2, 1 << 21)):
            firsts, sizes = [], []
            for text in batch.column(2):
                own_set = shingles(text.as_buffer(), width)
                order = np.lexsort((own_set, common.value[own_set >> np.uint64(64 - CELLS)]))
                n = len(own_set)
                firsts.append(own_set[order[: n - (part * n + whole - 1) // whole + 1]])
                sizes.append(n)
            many = np.array([len(f) for f in firsts])
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            n = np.repeat(np.array(sizes, dtype=np.int64), many)
            doc = np.repeat(np.arange(len(many)), many)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_signed(np.concatenate(firsts))), pa.array(batch.column(0).to_numpy()[doc]),
                    pa.array(batch.column(1).to_numpy()[doc]), pa.array(n.astype(np.int32)), pa.array((n - at).astype(np.int32)),
                ],
                names=["shingle", "_id", "_group", "n", "left"],
            )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and batch.column(0)[batch.num_rows - 1] != held[0].column(0)[0]:
                whole = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
                keys = whole.column(0).to_numpy()
                # The last shingle of a batch may go on in the next one.
                cut = int(np.searchsorted(keys, keys[-1]))
                yield from _meetings(whole.slice(0, cut))
                held = [whole.slice(cut)]
            else:
                held.append(batch)
                if len(held) == 1 and batch.column(0)[0] != batch.column(0)[batch.num_rows - 1]:
                    keys = batch.column(0).to_numpy()
                    cut = int(np.searchsorted(keys, keys[-1]))
                    yield from _meetings(batch.slice(0, cut))
                    held = [batch.slice(cut)]
        if held:
            yield from _meetings(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    rows = own.select("_id", "_group", "_text").mapInArrow(prefixes, "shingle long, _id long, _group long, n int, left int")
    sorted_in = rows.repartition(parts, "shingle").sortWithinPartitions("shingle")
    return sorted_in.mapInArrow(meet, "u long, v long")


def _meetings(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if not batch.num_rows:
        return
    keys, ids, group, n, left = (batch.column(k).to_numpy() for k in range(5))
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    us, vs, held = [], [], 0
    for start, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        own = slice(start, start + size)
        for u, v in _met(group[own], ids[own], n[own].astype(np.int64), left[own].astype(np.int64)):
            us.append(u)
            vs.append(v)
            held += len(u)
            if held > 100_000:
                yield _distinct(us, vs)
                us, vs, held = [], [], 0
    if us:
        yield _distinct(us, vs)


def _distinct(us: list[np.ndarray], vs: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.stack((np.concatenate(us), np.concatenate(vs)), axis=1), axis=0)
    columns = [pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)]
    return pa.RecordBatch.from_arrays(columns, names=["u", "v"])


# ---- all documents ------------------------------------------------------------------------------------


def texts_of(ids: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """One row (_id, _text) for each class of ``ids``: the text of the row that stands for it. Written."""
    sought = ids.join(classes.select("_id", "_least", "_hash"), "_id")
    marks = bitmap(sought, F.xxhash64("_least", "_hash"), "near-ends")
    named = texts.withColumnRenamed("_id", "_least")
    asked = with_bit(named, F.xxhash64("_least", "_hash"), marks, "_asked").filter("_asked").drop("_asked")
    found = asked.join(sought.hint("merge"), ["_least", "_hash"]).dropDuplicates(["_least", "_hash"])
    return written(found.select("_id", "_text"), "near-texts")


def least_ids(reached: DataFrame, classes: DataFrame) -> DataFrame:
    """``_id`` and ``_component``, the least document id of its component, of every class that is linked."""
    linked = reached.withColumnRenamed("node", "_id").join(classes.select("_id", "_least"), "_id")
    least = linked.groupBy("component").agg(F.min("_least").alias("_component"))
    return lookup(linked.select("_id", "component"), least, ["component"], "inner").select("_id", "_component")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Id, ``n_shingles``, ``component_id`` and ``kept`` of every document, by shingles of ``words`` words."""
    texts = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("_text"),
    ).withColumn("_hash", F.xxhash64("_text"))
    signed = written(signatures(texts, words), "near-signatures")
    keys = ["n", "a", "b"]
    # A class has a number, its least id, and with the hash of a text under that id the row that stands for it.
    classes = written(
        signed.filter("n > 0")
        .groupBy(*keys)
        .agg(F.min(F.struct("_id", "_hash")).alias("_one"), F.first("lanes").alias("lanes"), F.first("sketch").alias("sketch"))
        .select(
            F.monotonically_increasing_id().alias("_id"), F.col("_one._id").alias("_least"), "_one._hash", *keys, "lanes", "sketch"
        ),
        "near-classes",
    )
    small, large = nodes_of(classes)
    pairs = candidates(small, classes)
    if large is not None:
        pairs = pairs.unionByName(led(large, classes))
    pairs = written(pairs.distinct(), "near-pairs")
    ends = pairs.select(F.col("u").alias("_id")).unionByName(pairs.select(F.col("v").alias("_id"))).distinct()
    if large is not None:
        large = written(large.select("_id").distinct(), "near-large")
        ends = ends.unionByName(large).distinct()
    wanted = texts_of(ends, classes, texts)
    links = written(confirmed(pairs, wanted, words), "near-links")
    reached = components(links)
    if large is not None:
        grouped = large.join(reached.withColumnRenamed("node", "_id"), "_id", "left")
        members = grouped.select("_id", F.coalesce("component", "_id").alias("_group"))
        more = written(joined(members, wanted, words).distinct(), "near-more-pairs")
        links = written(confirmed(more, wanted, words), "near-more-links")
        if not links.isEmpty():
            reached = components(links.unionByName(reached.select(F.col("node").alias("u"), F.col("component").alias("v"))))
    named = classes.select("_id", "_least", *keys).join(least_ids(reached, classes), "_id", "left").select(
        *keys, F.coalesce("_component", "_least").alias("_component")
    )
    full = lookup(signed.filter("n > 0").select("_id", *keys), named, keys).select("_id", "n", "_component")
    none = signed.filter("n = 0").select("_id", "n", F.col("_id").alias("_component"))
    return full.unionByName(none).select(
        F.when(F.col("_id") != LAST, F.col("_id")).alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("_component") != LAST, F.col("_component")).alias("component_id"),
        (F.col("_id") == F.col("_component")).alias("kept"),
    )
