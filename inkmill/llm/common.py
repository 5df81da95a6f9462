"""Shared folder, written tables and skew-proof look-ups of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: What counts as white space between words, as bytes, and a word as a pattern.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from ``spark.checkpoint.dir``.

    A cluster has to set it. Only a local session, as in tests, gets a temporary folder of its own.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="inkmill-shared-")
        context._conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder; a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup(rows: DataFrame, answers: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join with one answer per key, where one key may hold a third of ``rows``.

    The answers are dealt out anew, so that both sides of the join are plain exchanges and adaptive
    execution can split the partition of a hot key.
    """
    return rows.join(answers.hint("rebalance").hint("merge"), keys, how)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lowered(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def kept_rows(docs: DataFrame, ids: DataFrame, key: str = "doc_id", how: str = "left_semi") -> DataFrame:
    """The rows of ``docs`` whose key is among ``ids``, or with ``left_anti`` is not; null keys are equal."""
    sought = ids.select(F.col(key).alias("_sought")).hint("merge")
    return docs.join(sought, docs[key].eqNullSafe(F.col("_sought")), how)


def once(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One of the rows that repeat key and text; which one is settled by a hash over all columns."""
    names = [f"`{c}`" for c in docs.columns]
    inside = W.partitionBy(key, F.xxhash64(F.col(text))).orderBy(F.xxhash64(*[F.col(n) for n in names]))
    return docs.withColumn("_nth", F.row_number().over(inside)).filter("_nth = 1").select(*[F.col(n) for n in names])


# ---- a bitmap of fixed size: which keys may occur elsewhere -------------------------------------

_CELLS = 1024  # of 32,768 bits each: 4 MB in all, whatever the input
_BITS = 32768


def bitmap(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """The keys of ``rows``, 64-bit hashes, as a bitmap in at most 1024 rows of 4 KB. Written."""
    slot = F.pmod(key, F.lit(_CELLS * _BITS))
    return written(
        rows.groupBy(F.floor(slot / _BITS).alias("_cell")).agg(
            F.bitmap_construct_agg(F.pmod(slot, F.lit(_BITS))).alias("_bits")
        ),
        name,
    )


def with_bit(rows: DataFrame, key: Column, marks: DataFrame, name: str) -> DataFrame:
    """``rows`` with a flag that is false only where the key is surely not in the bitmap.

    The bitmap is broadcast, as its size is fixed. Two keys may share a bit, so whatever is flagged has to be
    looked up for good; the flag saves moving the rest.
    """
    slot = F.pmod(key, F.lit(_CELLS * _BITS))
    bit = F.pmod(slot, F.lit(_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.floor(byte / F.pow(F.lit(2), bit % 8)).cast("int") % 2 == 1
    return (
        rows.withColumn("_cell", F.floor(slot / _BITS))
        .join(F.broadcast(marks), "_cell", "left")
        .withColumn(name, F.coalesce(set_, F.lit(False)))
        .drop("_cell", "_bits")
    )
