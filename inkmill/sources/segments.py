"""Ingest state as bucketed segments under a manifest, for many batches.

A row of the state lies in a bucket by its chapter (book, URL) and in one by its content (book, digest), so a batch
reads only the buckets that its own chapters and contents fall into. When a chapter's content changes, the new row
also goes to the bucket of the content it had, where it outdates the old one; so the latest row of a chapter among
any buckets either is its latest row at all, or has a content nobody asked for in them.

Every batch adds a segment. As soon as ``FAN`` segments have one level, they are merged into one of the next level, so
batch n reads at most ``FAN - 1`` segments a level, log n levels, and a row is rewritten once a level. The manifest of
a batch, written last, names the segments that count after it. A batch that is run again starts from the manifest of
the one before and overwrites what it wrote; segments that no manifest in use names may be deleted by their owner.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.sources.state import STATE_COLUMNS, STATE_SCHEMA, empty_state, latest_state

BUCKETS = 64  # a fixed value of a store: rows lie where it put them
FAN = 8
_SCHEMA = f"{STATE_SCHEMA}, segment string, kind string, bucket int"
_MANIFEST = "segment string, level int"


class Segment(NamedTuple):
    name: str
    level: int


def _bucket(key: str | Column) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.when(key.isNotNull(), F.pmod(F.xxhash64("book_id", key), F.lit(BUCKETS)).cast("int"))


def segments_after(spark: SparkSession, path: str, batch_id: int) -> list[Segment]:
    """The segments that count after a batch; none before the first. At most ``FAN - 1`` for each level."""
    if batch_id < 0:
        return []
    rows = spark.read.schema(_MANIFEST).json(f"{path}/manifest/batch={batch_id}").collect()
    return sorted(Segment(r.segment, r.level) for r in rows)


def _entries(spark: SparkSession, path: str, segments: list[Segment]) -> DataFrame:
    reader = spark.read.schema(_SCHEMA).option("basePath", f"{path}/segments")
    return reader.parquet(*[f"{path}/segments/segment={s.name}" for s in segments])


def known_state(spark: SparkSession, path: str, segments: list[Segment], keys: DataFrame) -> DataFrame:
    """Current rows of the chapters, and of all that hold the contents, in ``keys(book_id, url, digest)``.

    Other rows may come along. Only the numbers of the buckets pass the driver.
    """
    if not segments:
        return empty_state(spark)
    hit = keys.agg(
        F.collect_set(_bucket("url")).alias("url"), F.collect_set(_bucket("digest")).alias("digest")
    ).first()
    kind, bucket = F.col("kind"), F.col("bucket")
    asked = ((kind == "url") & bucket.isin(hit.url)) | ((kind == "digest") & bucket.isin(hit.digest))
    return latest_state(_entries(spark, path, segments).filter(asked).select(*STATE_COLUMNS))


def whole_state(spark: SparkSession, path: str, segments: list[Segment]) -> DataFrame:
    """Current row of every chapter."""
    if not segments:
        return empty_state(spark)
    return latest_state(_entries(spark, path, segments).filter("kind = 'url'").select(*STATE_COLUMNS))


def commit_state(
    spark: SparkSession, path: str, batch_id: int, segments: list[Segment], changes: DataFrame, known: DataFrame
) -> list[Segment]:
    """Add the rows of a batch to the store and return the segments that count from now on."""
    before = known.select("book_id", "url", F.col("digest").alias("_before"))
    places = F.array_distinct(
        F.array(
            F.struct(F.lit("url").alias("kind"), _bucket("url").alias("bucket")),
            F.struct(F.lit("digest").alias("kind"), _bucket("digest").alias("bucket")),
            F.struct(F.lit("digest").alias("kind"), _bucket("_before").alias("bucket")),
        )
    )
    rows = changes.select(*STATE_COLUMNS).join(before, ["book_id", "url"], "left")
    placed = rows.select(*STATE_COLUMNS, F.inline(F.filter(places, lambda p: p["bucket"].isNotNull())))
    kept = [*segments, _write(placed, path, Segment(f"batch-{batch_id:08d}-level-0", 0))]
    level = 0
    while sum(s.level == level for s in kept) >= FAN:
        merged = [s for s in kept if s.level == level]
        level += 1
        rest = [c for c in STATE_COLUMNS if c not in ("book_id", "url")]
        newest = F.max_by(F.struct(*rest), F.struct("updated_at", F.xxhash64("status"))).alias("s")
        rows = _entries(spark, path, merged).groupBy("kind", "bucket", "book_id", "url").agg(newest)
        rows = rows.select("book_id", "url", "s.*", "kind", "bucket")
        kept = [s for s in kept if s not in merged]
        kept.append(_write(rows, path, Segment(f"batch-{batch_id:08d}-level-{level}", level)))
    names = spark.createDataFrame([tuple(s) for s in kept], _MANIFEST).coalesce(1)
    names.write.mode("overwrite").json(f"{path}/manifest/batch={batch_id}")
    return kept


def _write(rows: DataFrame, path: str, segment: Segment) -> Segment:
    # A bucket goes to one task, unless it is large: a content that fills a book is split by the planner.
    dealt = rows.sparkSession.sql("SELECT /*+ REBALANCE(kind, bucket) */ * FROM {rows}", rows=rows)
    dealt.write.partitionBy("kind", "bucket").mode("overwrite").parquet(f"{path}/segments/segment={segment.name}")
    return segment
