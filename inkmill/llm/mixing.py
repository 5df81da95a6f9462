"""Mixing overlapping sources to target weights by min-cost flow.

A document belongs to one or more sources; documents with the same sources form a pattern. A pattern can give up
to ``most`` times its words, each further round at a higher cost, and its words may count for any of its sources.
Quotas come from the weights: all words are shared by weight, but a source asks for at most ``most`` times what it
has, and the excess is shared among the others until none is above. The cheapest flow that fills the quotas as far
as possible tells how many words each pattern gives to which source; the cost is convex, so patterns are repeated
evenly. The flow sees one node for each pattern and source, not documents; sums of their sizes are all it needs.

Documents are then selected by a seeded hash: all of a pattern are taken for each whole round, and for the rest
those with the least hashes, up to a cut found by two passes of 4,096 bins; what is still missing is topped up by
single documents, each the one that comes nearest. Reruns agree, as the hash depends on seed, id and text alone.

Null texts have size 0 and are taken 0 times as far as words go. A null source is a source of its own and sorts last;
an empty or null list of sources counts as the null source. Rows that repeat id and text are selected together.
The driver holds sums by pattern, so a table may have as many patterns as fit there, whatever the documents.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.llm.common import WORD, text_or_empty, written

MOST = 3  # rounds of a document
_BINS = 4096
_TOP_UPS = 6


def word_count(text: str) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def by_code_point(name: str | None) -> tuple[bool, str]:
    return name is None, name or ""


def quotas(sizes: dict[str | None, int], weights: dict[str | None, float], total: float, most: int = MOST) -> dict:
    """Targets by weight, none above ``most`` times its source's size."""
    targets: dict[str | None, float] = {}
    free = sorted(sizes, key=by_code_point)
    while free:
        left = total - sum(targets.values())
        weight = sum(weights[s] for s in free)
        above = [s for s in free if left * weights[s] / weight > most * sizes[s]]
        if not above:
            targets |= {s: left * weights[s] / weight for s in free}
            break
        targets |= {s: float(most * sizes[s]) for s in above}
        free = [s for s in free if s not in set(above)]
    return targets


class Flow:
    """Min-cost flow by shortest augmenting paths with potentials; whole units."""

    def __init__(self, nodes: int) -> None:
        self.edges: list[list[int]] = [[] for _ in range(nodes)]
        self.to, self.room, self.cost = [], [], []

    def add(self, a: int, b: int, room: int, cost: int) -> int:
        for u, v, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.edges[u].append(len(self.to))
            self.to.append(v)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        n = len(self.edges)
        potential = [0] * n
        while True:
            far, via = [None] * n, [-1] * n
            far[source] = 0
            queue = [(0, source)]
            while queue:
                d, u = heapq.heappop(queue)
                if d > far[u]:
                    continue
                for e in self.edges[u]:
                    if self.room[e] > 0:
                        v, reach = self.to[e], d + self.cost[e] + potential[u] - potential[self.to[e]]
                        if far[v] is None or reach < far[v]:
                            far[v], via[v] = reach, e
                            heapq.heappush(queue, (reach, v))
            if far[sink] is None:
                return
            potential = [p + f if f is not None else p for p, f in zip(potential, far, strict=True)]
            amount, v = None, sink
            while v != source:
                e = via[v]
                amount = self.room[e] if amount is None else min(amount, self.room[e])
                v = self.to[e ^ 1]
            v = sink
            while v != source:
                e = via[v]
                self.room[e] -= amount
                self.room[e ^ 1] += amount
                v = self.to[e ^ 1]


@dataclass
class Plan:
    sizes: dict
    targets: dict
    words: dict  # by pattern: words to take


def plan(patterns: dict[tuple, int], weights: dict | None, most: int = MOST) -> Plan:
    """Words to take of each pattern, a tuple of sources in order, from the patterns' sizes."""
    sources = sorted({s for p in patterns for s in p}, key=by_code_point)
    if weights is None:
        weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    sizes = {s: sum(n for p, n in patterns.items() if s in p) for s in sources}
    targets = quotas(sizes, weights, sum(patterns.values()), most)
    names = sorted(patterns, key=lambda p: [by_code_point(s) for s in p])
    flow = Flow(2 + len(names) + len(sources))
    at = {s: 2 + len(names) + i for i, s in enumerate(sources)}
    given = {}
    for i, name in enumerate(names):
        given[name] = [flow.add(0, 2 + i, patterns[name], 2 * r + 1) for r in range(most)]
        for s in name:
            flow.add(2 + i, at[s], most * patterns[name], 0)
    for s in sources:
        flow.add(at[s], 1, round(targets[s]), 0)
    flow.run(0, 1)
    return Plan(sizes, targets, {p: sum(flow.room[e ^ 1] for e in es) for p, es in given.items()})


def mix(
    docs: DataFrame,
    sources: Column,
    size: Column,
    weights: dict | None = None,
    most: int = MOST,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, Plan]:
    """Id, ``sources``, ``size``, ``copies`` and ``taken`` words of every document; and the plan.

    ``sources`` is an array column. Without ``weights``, sources in code point order weigh 5, 2, 1, repeating.
    """
    spark = docs.sparkSession
    listed = F.array_distinct(sources.cast("array<string>"))
    known = F.filter(listed, lambda s: s.isNotNull())
    ordered = F.when(F.size(listed) > F.size(known), F.concat(F.array_sort(known), F.array(F.lit(None).cast("string"))))
    pattern = F.when(F.coalesce(F.size(listed), F.lit(0)) <= 0, F.array(F.lit(None).cast("string"))).otherwise(
        F.coalesce(ordered, F.array_sort(known))
    )
    hashed = F.pmod(F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), text_or_empty(f"`{text_col}`")), F.lit(1 << 48))
    rows = written(
        docs.select(
            F.col(f"`{id_col}`").alias("_id"), F.to_json(pattern).alias("_key"), size.cast("long").alias("_size"),
            hashed.alias("_hash"),
        ),
        "mix-sizes",
    )
    totals = {r._key: r.n or 0 for r in rows.groupBy("_key").agg(F.sum("_size").alias("n")).collect()}
    chosen = plan({tuple(json.loads(k)): n for k, n in totals.items()}, weights, most)
    words = {k: chosen.words[tuple(json.loads(k))] for k in totals}
    rounds = {k: words[k] // n if n else 0 for k, n in totals.items()}
    rest = {k: words[k] - rounds[k] * n for k, n in totals.items()}

    def with_plan(values: list[tuple], columns: str) -> DataFrame:
        """Rows with what the driver knows of their pattern: one row for each, as many as the plan holds anyway."""
        return rows.join(F.broadcast(spark.createDataFrame(values, f"_key string, {columns}")), "_key")

    # Cuts: first by the upper 12 bits of the hash, then by the next 12 within the bin that crosses the rest.
    cuts, held = dict.fromkeys(totals, 0), dict.fromkeys(totals, 0)
    width = 1 << 48
    for _ in range(2):
        starts, full = dict(cuts), set()
        bins = with_plan(list(cuts.items()), "_cut long").filter(
            (F.col("_hash") >= F.col("_cut")) & (F.col("_hash") < F.col("_cut") + width)
        )
        width //= _BINS
        sums = bins.groupBy("_key", F.floor((F.col("_hash") - F.col("_cut")) / width).alias("_bin"))
        for r in sums.agg(F.sum("_size").alias("n")).orderBy("_bin").collect():
            if r._key in full:
                continue
            if held[r._key] + r.n > rest[r._key]:
                full.add(r._key)
                cuts[r._key] = starts[r._key] + r._bin * width
            else:
                held[r._key] += r.n
                cuts[r._key] = starts[r._key] + (r._bin + 1) * width
    # Top up: the document that brings the sum nearest, one at a time; the last may go beyond by less than was missing.
    more: dict[str, list[int]] = {k: [] for k in totals}
    for _ in range(_TOP_UPS):
        gaps = [(k, rest[k] - held[k], cuts[k], more[k]) for k in totals if rest[k] > held[k]]
        if not gaps:
            break
        fits = (
            with_plan(gaps, "_gap long, _cut long, _more array<long>")
            .filter("_hash >= _cut AND _size > 0 AND _size < 2 * _gap AND NOT array_contains(_more, _hash)")
            .groupBy("_key", "_hash", "_gap")
            .agg(F.sum("_size").alias("n"))
            .filter("n < 2 * _gap")
            .groupBy("_key")
            .agg(F.min(F.struct(F.abs(F.col("n") - F.col("_gap")), "_hash", "n")).alias("best"))
            .collect()
        )
        for r in fits:
            more[r._key].append(r.best._hash)
            held[r._key] += r.best.n
        if not fits:
            break
    decided = with_plan(
        [(k, rounds[k], cuts[k], more[k]) for k in totals], "_rounds long, _cut long, _more array<long>"
    )
    extra = (F.col("_hash") < F.col("_cut")) | F.array_contains("_more", F.col("_hash"))
    copies = F.col("_rounds") + F.when(extra, 1).otherwise(0)
    mixed = decided.select(
        F.col("_id").alias(id_col),
        F.from_json("_key", "array<string>").alias("sources"),
        F.col("_size").alias("size"),
        copies.alias("copies"),
        (F.col("_size") * copies).alias("taken"),
    )
    return mixed, chosen


def by_source(chosen: Plan, spark: SparkSession) -> DataFrame:
    """``source``, ``source_size`` and ``target``."""
    rows = [(s, chosen.sizes[s], float(chosen.targets[s])) for s in chosen.sizes]
    return spark.createDataFrame(rows, "source string, source_size long, target double")
