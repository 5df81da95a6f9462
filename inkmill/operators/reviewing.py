"""Review of cleaned chapters: the list of changes, and their acceptance or rejection.

A chapter is compared inside its own row. Changes come from the lineage of its paragraphs, or for
texts of unknown origin from an alignment of the two paragraph lists.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from inkmill.functions.alignment import Automaton, differing
from inkmill.functions.arrays import unnest
from inkmill.functions.text import BLANKS, WS, let, replace_first, split_paragraphs, strip
from inkmill.operators import chain
from inkmill.operators import rulebook as rb
from inkmill.operators.chain import Chapter

KEYS = ["book_id", "chapter_index"]

# How a change without an issue is described, and when a near text is replaced.
DEFAULT_CATEGORY, DEFAULT_RULE, DEFAULT_REASON = "text_change", "cleaned_text_diff", "保守清洗产生的文本修改"
MIN_BLOCK, BLOCK_SHARE = 6, 0.6

_CHANGES = "array<struct<tag:string,i1:int,i2:int,j1:int,j2:int,original:string,replacement:string,at:int>>"
_CHANGE_TYPE = ArrayType(
    StructType(
        [StructField("tag", StringType()), *[StructField(n, IntegerType()) for n in ("i1", "i2", "j1", "j2")]]
        + [StructField("original", StringType()), StructField("replacement", StringType()), StructField("at", IntegerType())]
    )
)
#: What a change is told by, for a reviewer.
TOLD = [
    ("tag", pa.string()), ("i1", pa.int32()), ("i2", pa.int32()), ("j1", pa.int32()), ("j2", pa.int32()),
    ("original", pa.string()), ("replacement", pa.string()), ("category", pa.string()), ("rule", pa.string()),
    ("reason", pa.string()), ("confidence", pa.string()), ("default_accepted", pa.bool_()),
]
TOLD_SQL = "array<struct<" + ",".join(
    f"{n}:{'int' if t == pa.int32() else 'boolean' if t == pa.bool_() else 'string'}" for n, t in TOLD
) + ">>"
_CHANGES_ARROW = pa.list_(
    pa.struct(
        [("tag", pa.string()), *[(n, pa.int32()) for n in ("i1", "i2", "j1", "j2")]]
        + [("original", pa.string()), ("replacement", pa.string()), ("at", pa.int32())]
    )
)


class Issue(NamedTuple):
    """A finding of a chapter; ``place`` is its place among all of them."""

    place: int
    fact: rb.Fact
    original: str
    replacement: str
    applied: bool


def places(text: str, paragraphs: list[str]) -> list[tuple[int, int]]:
    """Begin and end of each paragraph in the text, searched forward."""
    found, cursor = [], 0
    for p in paragraphs:
        at = text.find(p, cursor)
        begin = at if at >= 0 else cursor
        cursor = begin + len(p)
        found.append((begin, cursor))
    return found


def text_changes(original: str, target: str, before: list[str], after: list[str]) -> list[dict]:
    """Differences of two texts by their paragraphs; those of a replaced block are paired one by one."""
    left, right = places(original, before), places(target, after)
    found = []

    def change(tag, i, j, at):
        old, new = original[i[0] : i[1]], target[j[0] : j[1]]
        if old != new:
            found.append(dict(tag=tag, i1=i[0], i2=i[1], j1=j[0], j2=j[1], original=old, replacement=new, at=at))

    for _, i1, i2, j1, j2 in differing(before, after):
        paired = min(i2 - i1, j2 - j1)
        for k in range(paired):
            change("replace", left[i1 + k], right[j1 + k], i1 + k)
        j = right[j2][0] if j2 < len(right) else len(target)
        for k in range(i1 + paired, i2):
            change("delete", left[k], (j, j), k)
        i = left[i2][0] if i2 < len(left) else len(original)
        for k in range(j1 + paired, j2):
            change("insert", (i, i), right[k], i2)
    return found


@F.arrow_udf(_CHANGE_TYPE)
def _aligned_changes(original: pa.Array, target: pa.Array, before: pa.Array, after: pa.Array) -> pa.Array:
    """Changes of texts of unknown origin; only changed chapters get here with values."""
    rows = zip(*(c.to_pylist() for c in (original, target, before, after)), strict=True)
    return pa.array([[] if r[0] is None else text_changes(*r) for r in rows], _CHANGES_ARROW)


@F.arrow_udf(ArrayType(IntegerType()))
def _before(sizes: pa.Array) -> pa.Array:
    """Sums of all sizes before each place of a list."""
    sizes = sizes.combine_chunks() if isinstance(sizes, pa.ChunkedArray) else sizes
    offsets, values = sizes.offsets.to_numpy(), sizes.values.to_numpy()
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    own = np.repeat(sums[offsets[:-1]], np.diff(offsets))
    flat = (sums[offsets[0] : offsets[-1]] - own).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(flat))


@F.arrow_udf(StringType())
def _walked(texts: pa.Array, begins: pa.Array, ends: pa.Array, kept: pa.Array) -> pa.Array:
    """Texts put together of what lies between the changes and what stands for them."""

    def run(text, i1, i2, new):
        out, last = [], 0
        for a, b, n in zip(i1, i2, new, strict=True):
            out += [text[last:a] if a > last else "", n]
            last = b
        return "".join([*out, text[last:]])

    rows = zip(*(c.to_pylist() for c in (texts, begins, ends, kept)), strict=True)
    return pa.array([None if r[0] is None else run(*r) for r in rows], pa.string())


@F.arrow_udf(StringType())
def _replace_near(texts: pa.Array, old: pa.Array, new: pa.Array) -> pa.Array:
    """Replace texts one after the other, a missing one by its longest common block if that is long enough."""

    def run(text, olds, news):
        for o, n in zip(olds, news):
            if o in text:
                text = text.replace(o, n, 1)
                continue
            begin, size = Automaton(o).longest_in(text)
            if size >= max(MIN_BLOCK, int(len(o) * BLOCK_SHARE)):
                text = text[:begin] + n + text[begin + size :]
        return text

    rows = zip(texts.to_pylist(), old.to_pylist(), new.to_pylist())
    return pa.array([None if t is None else run(t, o, n) for t, o, n in rows], pa.string())


# Spark copies deterministic calls into every place that uses them; these are to run once.
_aligned_changes = _aligned_changes.asNondeterministic()
_before = _before.asNondeterministic()
_walked = _walked.asNondeterministic()
_replace_near = _replace_near.asNondeterministic()


_SPAN_TYPE = ArrayType(StructType([StructField("a", IntegerType()), StructField("b", IntegerType())]))
_SPAN_ARROW = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


@F.arrow_udf(_SPAN_TYPE)
def _spans(texts: pa.Array, paragraphs: pa.Array) -> pa.Array:
    rows = zip(texts.to_pylist(), paragraphs.to_pylist(), strict=True)
    return pa.array([[{"a": a, "b": b} for a, b in places(t or "", ps or [])] for t, ps in rows], _SPAN_ARROW)


def spans(text: Column, paragraphs: Column) -> Column:
    """``struct<a, b>`` per paragraph: its place in the text, searched forward."""
    return _spans(text, paragraphs)


def review_target(original: Column, cleaned: Column, issues: Column) -> Column:
    """Cleaned text, or for an unchanged chapter the text with every usable suggestion made."""
    usable = F.filter(
        issues,
        lambda i: (i["confidence"] != "low") & (i["original"] != "") & (i["original"] != i["replacement"]),
    )
    suggested = F.aggregate(usable, original, lambda t, i: replace_first(t, i["original"], i["replacement"]))
    return F.when(cleaned != original, cleaned).otherwise(suggested)


def matching_issue(original: Column, replacement: Column, issues: Column) -> Column:
    """The issue a change stems from: the first applied one that fits, else the first that fits.

    Issues fit when one of the two originals holds the other, or the new text holds the replacement.
    """
    bare = strip(original)

    def fits(i):
        o, r = strip(i["original"]), strip(i["replacement"])
        return ((o != "") & (F.contains(original, o) | F.contains(o, bare))) | (
            (r != "") & F.contains(replacement, r)
        )

    def chosen(found):
        applied = F.filter(found, lambda i: i["applied"])
        return F.coalesce(F.get(applied, F.lit(0)), F.get(found, F.lit(0)))

    return let(F.filter(issues, fits), chosen)


def _described(change: Column, issue: Column) -> Column:
    return F.struct(
        *[change[n].alias(n) for n in ("tag", "i1", "i2", "j1", "j2", "original", "replacement")],
        F.coalesce(issue["category"], F.lit(DEFAULT_CATEGORY)).alias("category"),
        F.coalesce(issue["rule"], F.lit(DEFAULT_RULE)).alias("rule"),
        F.coalesce(issue["reason"], F.lit(DEFAULT_REASON)).alias("reason"),
        F.coalesce(issue["confidence"], F.lit("high")).alias("confidence"),
        (issue.isNull() | (issue["confidence"] == "high")).alias("default_accepted"),
        issue["place"].alias("place"),
    )


def _suggestion(issue: Column) -> Column:
    """A finding that no difference shows becomes a change of its own."""
    zero = F.lit(0)
    return F.struct(
        F.lit("issue_replace").alias("tag"),
        *[zero.alias(n) for n in ("i1", "i2", "j1", "j2")],
        *[issue[n].alias(n) for n in ("original", "replacement", "category", "rule", "reason", "confidence")],
        (issue["confidence"] == "high").alias("default_accepted"),
        issue["place"].alias("place"),
    )


def _fitting(original: str, replacement: str, issues: list[Issue]) -> Issue | None:
    """The issue of :func:`matching_issue`."""
    bare, first = original.strip(), None
    for i in issues:
        o, r = (i.original or "").strip(), (i.replacement or "").strip()
        if (o and (o in original or bare in o)) or (r and r in replacement):
            if i.applied:
                return i
            first = first or i
    return first


def judged_changes(chapter: Chapter, mode: str) -> list[tuple]:
    """Changes of a judged chapter as :func:`chapter_changes` lists them, without the place of their issue."""
    if chapter.text is None:
        return []
    text, issues, nearby = chapter.text, [], {}
    for i, _, f in chapter.findings():
        issue = Issue(len(issues), rb.FACTS[f.fact], f.original, f.replacement, f.applied)
        issues.append(issue)
        nearby.setdefault(i, []).append(issue)
    usable = [i for i in issues if i.fact.confidence != "low" and i.original != "" and i.original != i.replacement]
    cleaned = chain.cleaned_text(chapter, mode)
    told, shown = [], set()

    def tell(tag, i1, i2, j1, j2, old, new, own):
        found = _fitting(old, new, own)
        if found is None:
            told.append((tag, i1, i2, j1, j2, old, new, DEFAULT_CATEGORY, DEFAULT_RULE, DEFAULT_REASON, "high", True))
        else:
            shown.add(found.place)
            f = found.fact
            told.append((tag, i1, i2, j1, j2, old, new, f.category, f.rule, f.reason, f.confidence, f.confidence == "high"))

    if cleaned != text:
        j = 0
        for i, (raw, new, begin) in enumerate(zip(chapter.raws, chapter.texts, chapter.begins, strict=True)):
            if raw != new:
                own = nearby.get(i, [])
                tell("replace" if new else "delete", begin, begin + len(raw), j, j + len(new), raw, new, own)
            j += len(new) + 2 if new else 0
    else:
        # Suggestions for an unchanged chapter have no lineage; they are aligned.
        target = text
        for i in usable:
            target = target.replace(i.original, i.replacement, 1)
        if target != text:
            before, after = (chain.split(t)[0] for t in (text, target))
            for c in text_changes(text, target, before, after):
                tell(*(c[n] for n in ("tag", "i1", "i2", "j1", "j2", "original", "replacement")), issues)
    for i in usable:
        if i.place not in shown:
            f = i.fact
            told.append(
                ("issue_replace", 0, 0, 0, 0, i.original, i.replacement, f.category, f.rule, f.reason, f.confidence, f.confidence == "high")
            )
    return told


def chapter_changes(chapters: DataFrame, lineage: bool = True) -> DataFrame:
    """Add ``target_text`` and ``changes`` to chapters.

    ``chapters(book_id, chapter_index, original_text, cleaned_text, issues, own, lineage)`` as made by
    :func:`from_judged` or :func:`from_tables`. With lineage a change is matched to the issues of its
    own paragraph, else to all issues of its chapter.
    """
    numbered = F.transform(
        "issues", lambda i, place: F.struct(*[i[n].alias(n) for n in _ISSUE_FIELDS], place.alias("place"))
    )
    differs = F.col("original_text") != F.col("target_text")
    before = F.when(differs, split_paragraphs(F.col("original_text"))).otherwise(F.array().cast("array<string>"))
    after = F.when(differs, split_paragraphs(F.col("target_text"))).otherwise(F.array().cast("array<string>"))
    staged = (
        chapters.withColumn("issues", numbered)
        .withColumn("target_text", review_target(F.col("original_text"), F.col("cleaned_text"), F.col("issues")))
        .withColumn("_before", before)
        .withColumn("_after", after)
    )
    # Suggestions for an unchanged chapter have no lineage; they are aligned.
    known = F.col("cleaned_text") != F.col("original_text") if lineage else F.lit(False)
    align = differs & ~known
    asked = [F.when(align, F.col(c)) for c in ("original_text", "target_text", "_before", "_after")]
    staged = staged.withColumn("_aligned", _aligned_changes(*asked))
    staged = staged.withColumn("_raw", F.when(known, F.col("lineage")).otherwise(F.col("_aligned")))

    def described(c):
        # With lineage only the issues of the own paragraph come into question.
        own = F.when(known, F.get(F.col("own"), c["at"])).otherwise(F.transform("issues", lambda i: i["place"]))
        nearby = F.transform(own, lambda at: F.get(F.col("issues"), at))
        return let(matching_issue(c["original"], c["replacement"], nearby), lambda i: _described(c, i))

    staged = staged.withColumn("_told", F.transform("_raw", described))
    def unseen(shown):
        return F.filter(
            "issues",
            lambda i: ~F.coalesce(F.array_contains(shown, i["place"]), F.lit(False))
            & (i["confidence"] != "low")
            & (i["original"] != "")
            & (i["original"] != i["replacement"]),
        )

    left = let(F.filter(F.transform("_told", lambda c: c["place"]), lambda p: p.isNotNull()), unseen)
    changes = F.concat(F.col("_told"), F.transform(left, _suggestion))
    return staged.withColumn("changes", changes).drop("_before", "_after", "_aligned", "_raw", "_told", "own", "lineage")


_ISSUE_FIELDS = ["paragraph", "category", "confidence", "rule", "reason", "original", "replacement", "applied"]


def from_judged(judged: DataFrame, cleaned: Column) -> DataFrame:
    """Chapters ready for review straight from their judged paragraphs, without a join."""

    def listed(p, i):
        def one(f):
            fact = rb.fact_of(f)
            return F.struct(
                i.alias("paragraph"), fact["category"].alias("category"), fact["confidence"].alias("confidence"),
                fact["rule"].alias("rule"), fact["reason"].alias("reason"), f["original"].alias("original"),
                f["replacement"].alias("replacement"), f["applied"].alias("applied"),
            )

        return F.transform(p["issues"], one)

    # Places are sums of the lengths before, with those of the separators; only changes are kept.
    body = strip(F.col("text"))
    lead = F.length("text") - F.length(F.ltrim(F.col("text"), F.lit(BLANKS)))
    gaps = F.transform(F.regexp_extract_all(body, F.lit(rf"\n[{WS}]*\n+"), F.lit(0)), lambda g: F.length(g))
    zipped = F.arrays_zip(F.col("paragraphs").alias("p"), gaps.alias("gap"))
    staged = judged.withColumns(
        {
            "_lead": lead,
            "_i": F.transform(zipped, lambda z: F.length(z["p"]["raw"]) + F.coalesce(z["gap"], F.lit(0))),
            "_j": F.transform("paragraphs", lambda p: F.when(p["text"] == "", 0).otherwise(F.length(p["text"]) + 2)),
            "_n": F.transform("paragraphs", lambda p: F.size(p["issues"])),
        }
    )
    staged = staged.withColumns({f"_sum{c}": _before(F.col(c)) for c in ("_i", "_j", "_n")})
    walked = F.arrays_zip(F.col("paragraphs").alias("p"), F.col("_sum_i").alias("i"), F.col("_sum_j").alias("j"))

    def change(z, at):
        gone = z["p"]["text"] == ""
        i1 = F.col("_lead") + z["i"]
        return F.struct(
            F.when(gone, "delete").otherwise("replace").alias("tag"),
            i1.alias("i1"), (i1 + F.length(z["p"]["raw"])).alias("i2"),
            z["j"].alias("j1"), (z["j"] + F.length(z["p"]["text"])).alias("j2"),
            z["p"]["raw"].alias("original"), z["p"]["text"].alias("replacement"), at.alias("at"),
        )

    lineage = F.filter(F.transform(walked, change), lambda c: c["original"] != c["replacement"])
    # Places of the issues of each paragraph in the list of all issues.
    none = F.array().cast("array<int>")
    own = F.transform(
        F.arrays_zip(F.col("_sum_n").alias("b"), F.col("_n").alias("n")),
        lambda z: F.when(z["n"] > 0, F.sequence(z["b"], z["b"] + z["n"] - 1)).otherwise(none),
    )
    return staged.select(
        *KEYS, "title", F.col("text").alias("original_text"), cleaned.alias("cleaned_text"),
        F.flatten(F.transform("paragraphs", listed)).alias("issues"), own.alias("own"), lineage.alias("lineage"),
    )


def from_tables(cleaned: DataFrame, issues: DataFrame) -> DataFrame:
    """Chapters ready for review from the two result tables; issues of a chapter are gathered per chapter."""
    order = F.struct("paragraph", "seq", *[n for n in _ISSUE_FIELDS if n != "paragraph"])
    gathered = issues.groupBy(*KEYS).agg(F.array_sort(F.collect_list(order)).alias("issues"))
    typed = "array<struct<" + ",".join(
        f"{n}:{'int' if n in ('paragraph', 'seq') else 'boolean' if n == 'applied' else 'string'}"
        for n in ["paragraph", "seq", *[f for f in _ISSUE_FIELDS if f != "paragraph"]]
    ) + ">>"
    return (
        cleaned.select(*KEYS, "title", "original_text", "cleaned_text")
        .join(gathered, KEYS, "left")
        .withColumn("issues", F.coalesce("issues", F.array().cast(typed)))
        .withColumn("own", F.lit(None).cast("array<array<int>>"))
        .withColumn("lineage", F.lit(None).cast(_CHANGES))
    )


def change_rows(changed: DataFrame) -> DataFrame:
    """``review_changes``: one row per change, numbered from 0 in each chapter."""
    return unnest(changed, KEYS, "changes", "c", "change_index").select(*KEYS, "change_index", "c.*").drop("place")


def gathered_decisions(decisions: DataFrame) -> DataFrame:
    """``(book_id, chapter_index, _decided)``: the decisions of each chapter by change, which travel once and together."""

    def greatest(listed):  # of several decisions on one change
        def last(c, i):
            return (i + 1 == F.size(listed)) | (F.get(listed, i + 1)["change_index"] != c["change_index"])

        return F.filter(listed, last)

    listed = F.array_sort(F.collect_list(F.struct("change_index", "accepted")))
    return decisions.groupBy(*KEYS).agg(listed.alias("_listed")).select(
        *KEYS, F.map_from_entries(let(F.col("_listed"), greatest)).alias("_decided")
    )


def accepted(changes: Column) -> Column:
    """One flag per change; a change nobody decided on keeps its default."""
    return F.transform(changes, lambda c, i: F.coalesce(F.try_element_at(F.col("_decided"), i), c["default_accepted"]))


def with_decisions(changed: DataFrame, decisions: DataFrame | None) -> DataFrame:
    """Add ``accepted``, one flag per change; a change nobody decided on keeps its default."""
    if decisions is None:
        return changed.withColumn("accepted", F.transform("changes", lambda c: c["default_accepted"]))
    met = changed.join(gathered_decisions(decisions), KEYS, "left")
    return met.withColumn("accepted", accepted(F.col("changes"))).drop("_decided")


#: What of a change is needed to make it.
NEEDED = ["tag", "i1", "i2", "original", "replacement", "default_accepted"]
_LISTS = ", ".join(f"{n} array<{'int' if t == pa.int32() else 'boolean' if t == pa.bool_() else 'string'}>" for n, t in TOLD if n in NEEDED)


def moved_to_decisions(chapters: DataFrame, decisions: DataFrame) -> DataFrame:
    """``with_decisions`` of chapters ``(book_id, chapter_index, title, original_text, changes)``.

    On their way the changes of a chapter are one text: as rows, many small values take several times the space of what they say.
    """
    lists = F.to_json(F.struct(*[F.col(f"changes.{n}").alias(n) for n in NEEDED]))
    moved = chapters.select(*KEYS, "title", "original_text", lists.alias("_lists"))
    met = moved.join(gathered_decisions(decisions), KEYS, "left").withColumn("_read", F.from_json("_lists", _LISTS))
    changes = F.arrays_zip(*[F.col(f"_read.{n}").alias(n) for n in NEEDED])
    back = met.select(*KEYS, "title", "original_text", "_decided", changes.alias("changes"))
    return back.withColumn("accepted", accepted(F.col("changes"))).drop("_decided")


def apply_decisions(changed: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """``reviewed_text`` of each chapter after the accepted changes."""
    return apply_accepted(with_decisions(changed, decisions))


def apply_accepted(decided: DataFrame) -> DataFrame:
    """``reviewed_text`` of chapters with one flag per change."""
    original = F.col("original_text")
    both = F.arrays_zip(F.col("changes").alias("c"), F.col("accepted").alias("ok"))
    regular = F.filter(both, lambda z: z["c"]["tag"] != "issue_replace")

    kept = F.transform(regular, lambda z: F.when(z["ok"], z["c"]["replacement"]).otherwise(z["c"]["original"]))
    ends = [F.transform(regular, lambda z: z["c"]["i1"]), F.transform(regular, lambda z: z["c"]["i2"])]
    # Texts without changes do not travel to Python.
    changed_text = F.size(regular) > 0
    walked = F.coalesce(_walked(F.when(changed_text, original), *ends, kept), original)
    extra = F.transform(
        F.filter(both, lambda z: (z["c"]["tag"] == "issue_replace") & z["ok"]), lambda z: z["c"]
    )

    def suggest(acc, c):
        return F.struct(
            replace_first(acc["text"], c["original"], c["replacement"]).alias("text"),
            (acc["missed"] | ~F.contains(acc["text"], c["original"])).alias("missed"),
        )

    staged = (
        decided.withColumn("_walked", walked)
        .withColumn("_extra", extra)
        .withColumn(
            "_exact",
            F.aggregate("_extra", F.struct(F.col("_walked").alias("text"), F.lit(False).alias("missed")), suggest),
        )
    )
    # Only chapters in which a suggestion is not found word for word travel to Python.
    near = _replace_near(
        F.when(F.col("_exact.missed"), F.col("_walked")),
        F.transform("_extra", lambda c: c["original"]),
        F.transform("_extra", lambda c: c["replacement"]),
    )
    staged = staged.withColumn("_near", near)
    text = F.coalesce(F.col("_near"), F.col("_exact.text"))
    tidy = strip(F.regexp_replace(text, rf"\n[{WS}]*\n(?:[{WS}]*\n)+", "\n\n"))
    return staged.withColumn(
        "reviewed_text", F.when(text != original, tidy).otherwise(text)
    ).drop("_walked", "_extra", "_exact", "_near")
