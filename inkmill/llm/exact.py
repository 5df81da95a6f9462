"""Exact deduplication by progressive refinement: length, prefix hash, full hash.

Only built-in functions; the text of a document never moves. A first scan takes lengths and hashes of
prefixes, which need no more than the head of a text. Documents alone with their length, or alone with
their length and prefix, are done. A second scan hashes whole texts of the groups that are left.

The second scan knows the surviving groups by a bitmap of fixed size, the only thing that is broadcast.
Two groups may share a bit: that costs a hash and changes nothing, as the full hashes decide.

Null texts count as empty and are all equal. A null id loses against any other; a group with null ids
only keeps all its rows. Rows that repeat id and text both count in ``group_size`` and carry the same
answer. Columns of the input other than the two named do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.llm.common import bitmap, lookup, lowered, text_or_empty, with_bit, written

PREFIX = 256  # characters


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = False
) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when they are identical after lower-casing A-Z; the largest id of a group stays.
    ``text_sha256`` is null for texts whose length or prefix is unique already, unless ``hash_all``.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), text_or_empty(f"`{text_col}`").alias("_text"))
    length = F.octet_length("_text").alias("_length")
    prefix = F.xxhash64(lowered(F.substring("_text", 1, PREFIX))).alias("_prefix")

    # Level 1 and 2: groups by length, then by length and prefix.
    heads = written(texts.select(length, prefix), "exact-heads")
    lengths = heads.groupBy("_length").count().filter("count > 1").select("_length")
    left = written(lookup(heads, lengths, ["_length"], "inner"), "exact-shared-lengths")
    pairs = left.groupBy("_length", "_prefix").count().filter("count > 1")
    key = F.xxhash64("_length", "_prefix")
    marks = bitmap(pairs, key, "exact-marks")

    # Level 3: whole texts of the groups that are left.
    seen = with_bit(texts.withColumns({"_length": length, "_prefix": prefix}), key, marks, "_shared")
    digest = F.sha2(lowered(F.col("_text")).cast("binary"), 256)
    hashed = written(
        seen.select(
            "_id", "_length", "_prefix", "_shared",
            (digest if hash_all else F.when(F.col("_shared"), digest)).alias("text_sha256"),
        ),
        "exact-hashes",
    )
    keys = ["_length", "_prefix", "text_sha256"]
    groups = hashed.filter("_shared").groupBy(*keys).agg(
        F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_size")
    )
    answered = lookup(hashed.filter("_shared"), groups, keys, "inner").select(
        "_id", F.col("_keep"), F.col("_size"), "text_sha256"
    )
    alone = hashed.filter("NOT _shared").select(
        "_id", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_size"), "text_sha256"
    )
    return answered.unionByName(alone).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        "text_sha256",
    )
