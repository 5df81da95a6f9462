"""Incremental ingest: newly landed chapters, state carried over batches, running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkmill.functions.text import content_hash
from inkmill.plans.clean import chapter_issues, judge
from inkmill.plans.ingest import IngestOptions, ingest, next_state
from inkmill.session import stored
from inkmill.sources.rules import Rules
from inkmill.sources.segments import commit_state, known_state, segments_after, whole_state

LANDED = "book_id string, chapter_index int, title string, url string, number bigint, text string, error string"


def landed_chapters(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of chapter rows that land as parquet files, with the time their file landed."""
    rows = spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn("landed_at", F.col("_metadata.file_modification_time"))


def ingest_batch(batch: DataFrame, batch_id: int, out: str, options: IngestOptions = IngestOptions()) -> None:
    """Ingest one batch against the state of all earlier ones, of which it reads the buckets its chapters fall into.

    It writes its own folders of chapters and outcomes and a segment of state. A batch that is run again after a
    failure overwrites what it wrote, so each chapter is kept once. Batches are numbered from 0 without gaps.
    """
    spark = batch.sparkSession
    store = f"{out}/state"
    # Of a chapter that landed twice in a batch the row that landed last counts; a hash parts equal times.
    rest = [c for c in batch.columns if c not in ("book_id", "url", "landed_at")]
    order = F.struct(*[c for c in ("landed_at",) if c in batch.columns], F.xxhash64(*rest))
    latest = batch.groupBy("book_id", "url").agg(F.max_by(F.struct(*rest), order).alias("r"))
    # Written once: every reader of its own would shuffle all texts again.
    rows = stored(latest.select("book_id", "url", "r.*"), "batch")
    segments = segments_after(spark, store, batch_id - 1)
    state = known_state(
        spark, store, segments, batch.select("book_id", "url", content_hash(F.col("text")).alias("digest"))
    )
    catalog = rows.select("book_id", "chapter_index", "title", "url", "number")
    done = ingest(catalog, rows.select("book_id", "url", "text", "error"), state, options)
    # The run is worked out once, for the outcomes; texts and state follow from what was written.
    done.outcomes.write.mode("overwrite").parquet(f"{out}/outcomes/batch={batch_id}")
    outcomes = spark.read.schema(done.outcomes.schema).parquet(f"{out}/outcomes/batch={batch_id}")
    kept = outcomes.filter("status = 'completed'").select("book_id", "url")
    texts = rows.select("book_id", "chapter_index", "title", "url", "text").join(kept, ["book_id", "url"], "left_semi")
    texts.select(*done.chapters.columns).write.mode("overwrite").parquet(f"{out}/chapters/batch={batch_id}")
    commit_state(spark, store, batch_id, segments, next_state(outcomes), state)


def ingest_stream(
    landed: DataFrame, out: str, checkpoint: str, options: IngestOptions = IngestOptions(deduplicate=True)
) -> StreamingQuery:
    """:func:`ingest_batch`, batch after batch of a stream."""
    return (
        landed.writeStream.foreachBatch(lambda batch, batch_id: ingest_batch(batch, batch_id, out, options))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_batches(spark: SparkSession, out: str, table: str, form: str = "parquet") -> DataFrame:
    return spark.read.option("basePath", f"{out}/{table}").format(form).load(f"{out}/{table}")


def current_state(spark: SparkSession, out: str) -> DataFrame:
    """Current row of every chapter after the last batch."""
    last = read_batches(spark, f"{out}/state", "manifest", "json").agg(F.max("batch")).first()[0]
    return whole_state(spark, f"{out}/state", segments_after(spark, f"{out}/state", last))


def first_seen(landed: DataFrame) -> DataFrame:
    """Light form without order: whichever copy of a content arrives first is kept."""
    return landed.withColumn("digest", content_hash(F.col("text"))).dropDuplicates(["book_id", "digest"])


# Kinds of ingest events.
EVENT_KINDS = [
    "book_loaded", "chapter_started", "page_started", "chapter_completed", "chapter_skipped", "chapter_failed",
    "chapter_duplicate", "finished", "cancelled",
]


def ingest_events(outcomes: DataFrame) -> DataFrame:
    """Event rows of a run: what became of each chapter."""
    return outcomes.select(
        "book_id", "chapter_index", F.concat(F.lit("chapter_"), F.col("status")).alias("kind"),
        F.col("title").alias("chapter_title"), F.coalesce("reason", F.lit("")).alias("message"),
    )


def event_counts(events: DataFrame, kind: str = "kind", book: str = "book_id") -> DataFrame:
    """Running count per book and kind, for tables and for streams (update or complete mode)."""
    return events.groupBy(book, kind).agg(F.count(F.lit(1)).alias("n"))


def issue_stream(landed: DataFrame, rules: Rules, corpus: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Issues of landed chapters, judged against the counts of a corpus written before."""

    def run(batch: DataFrame, batch_id: int) -> None:
        issues = chapter_issues(judge(batch, rules, mode="detect", corpus=corpus))
        issues.write.mode("overwrite").parquet(f"{out}/issues/batch={batch_id}")

    return (
        landed.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def issue_count_stream(spark: SparkSession, out: str, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """Running number of issues per book and rule, from what :func:`issue_stream` writes below ``out``.

    Counts are a streaming aggregate; each batch writes those that changed (:func:`issue_counts_now` reads the latest).
    A batch of issues that was written again within ``delay`` of its first files counts once: its issues are known by
    batch and place, and the state remembers the places for that long.
    """
    chapters = spark.createDataFrame([], "book_id string, chapter_index int, text string")
    schema = chapter_issues(judge(chapters, Rules(), mode="detect")).schema
    issues = spark.readStream.schema(schema.add("batch", "long")).option("ignoreMissingFiles", True).parquet(f"{out}/issues")
    once = (
        issues.select("batch", "book_id", "chapter_index", "paragraph", "seq", "rule", F.col("_metadata.file_modification_time").alias("seen_at"))
        .withWatermark("seen_at", delay)
        .dropDuplicatesWithinWatermark(["batch", "book_id", "chapter_index", "paragraph", "seq"])
    )
    counts = once.groupBy("book_id", "rule").agg(F.count(F.lit(1)).alias("n"))

    def changed(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/issue_counts/batch={batch_id}")

    return (
        counts.writeStream.outputMode("update").foreachBatch(changed)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def issue_counts_now(spark: SparkSession, out: str) -> DataFrame:
    """``(book_id, rule, n)`` after the last batch of :func:`issue_count_stream`."""
    return read_batches(spark, out, "issue_counts").groupBy("book_id", "rule").agg(F.max_by("n", "batch").alias("n"))


__all__ = [
    "EVENT_KINDS", "LANDED", "current_state", "event_counts", "first_seen", "ingest_batch", "ingest_events",
    "ingest_stream", "issue_count_stream", "issue_counts_now", "issue_stream", "landed_chapters", "read_batches",
]
