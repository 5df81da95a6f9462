"""State over many batches: against one that keeps everything, and what a late batch reads."""

import random

from pyspark.sql import functions as F

from inkmill.plans.ingest import IngestOptions
from inkmill.sources import segments as store
from inkmill.sources.rules import load_rules
from inkmill.sources.state import STATE_COLUMNS, STATE_SCHEMA, latest_state
from inkmill.streaming.ingest import (
    LANDED, current_state, ingest_batch, issue_count_stream, issue_counts_now, issue_stream, landed_chapters, read_batches,
)


def row(book, url, digest, status, at):
    return (book, url, None, status, None, digest, None, None, status == "completed", at)


def test_many_batches_against_the_whole_history(spark, tmp_path, monkeypatch):
    """What a batch asks for is answered as by all rows there are, when contents change and go."""
    from datetime import datetime, timedelta

    monkeypatch.setattr(store, "FAN", 3)
    rng, path, kept, every = random.Random(5), str(tmp_path), [], []
    for batch in range(11):
        at = datetime(2020, 1, 1) + timedelta(seconds=batch)
        urls = rng.sample(range(30), 6)
        rows = [row("b", f"u{u}", rng.choice([None, "d1", "d2", "d3"]), "completed", at) for u in urls]
        changes = spark.createDataFrame(rows, STATE_SCHEMA)
        known = store.known_state(spark, path, kept, changes)
        if every:
            whole = latest_state(spark.createDataFrame(every, STATE_SCHEMA)).collect()
            asked_urls, asked_digests = {r[1] for r in rows}, {r[5] for r in rows} - {None}

            def asked(r):
                return r.url in asked_urls or r.digest in asked_digests

            got = {tuple(r) for r in known.select(*STATE_COLUMNS).collect() if asked(r)}
            assert got == {tuple(r[c] for c in STATE_COLUMNS) for r in whole if asked(r)}
        kept = store.commit_state(spark, path, batch, kept, changes, known)
        every += rows
        assert kept == sorted(kept, key=lambda s: (-s.level, s.name)) and store.segments_after(spark, path, batch) == sorted(kept)
    assert [s.level for s in kept] == [2, 0, 0]  # eleven batches: nine merged twice, two new
    whole = latest_state(spark.createDataFrame(every, STATE_SCHEMA))
    got = store.whole_state(spark, path, kept)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in whole.collect()}


def test_a_batch_reads_its_own_buckets(spark, tmp_path):
    from datetime import datetime

    rows = [row("b", f"u{i}", f"d{i}", "completed", datetime(2020, 1, 1)) for i in range(400)]
    changes = spark.createDataFrame(rows, STATE_SCHEMA)
    nothing = store.known_state(spark, str(tmp_path), [], changes)
    kept = store.commit_state(spark, str(tmp_path), 0, [], changes, nothing)
    one = changes.filter("url = 'u7'")
    read = store.known_state(spark, str(tmp_path), kept, one)
    assert 0 < read.count() < 60 and read.filter("url = 'u7'").count() == 1
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [((kind" in plan or "PartitionFilters: [(((kind" in plan


def test_a_batch_run_again_and_a_content_that_is_replaced(spark, tmp_path):
    out = str(tmp_path)

    def land(k, *rows, force=False):
        landed = spark.createDataFrame([("a", i, f"t{i}", f"a/{i}", i, text, None) for i, text in rows], LANDED)
        ingest_batch(landed, k, out, IngestOptions(force=force))

    def state():
        return {r.url: (r.status, r.first_url) for r in current_state(spark, out).collect()}

    land(0, (1, "x"), (2, "y"))
    land(1, (3, " x"), (4, ""))
    land(1, (3, " x"), (4, ""))
    assert state() == {"a/1": ("completed", None), "a/2": ("completed", None), "a/3": ("duplicate", "a/1"), "a/4": ("failed", None)}
    land(2, (2, "new"), force=True)
    land(3, (5, "y"), (6, "new"), (4, "z"))
    assert state() == {
        "a/1": ("completed", None), "a/2": ("completed", None), "a/3": ("duplicate", "a/1"), "a/4": ("completed", None),
        "a/5": ("completed", None), "a/6": ("duplicate", "a/2"),
    }
    assert {r.chapter_index for r in read_batches(spark, out, "chapters").collect()} == {1, 2, 4, 5}


def test_running_issue_counts(spark, tmp_path):
    """Counts go on after a restart, and issues that were written twice count once."""
    out, landed = str(tmp_path / "out"), str(tmp_path / "landed")
    corpus = spark.createDataFrame([("a", 9, "我们去。我们来。")], "book_id string, chapter_index int, text string")

    def land(*rows):
        frame = spark.createDataFrame([("a", i, "一", f"a/{i}", i, text, None) for i, text in rows], LANDED)
        frame.coalesce(1).write.mode("append").parquet(landed)
        issue_stream(landed_chapters(spark, landed), load_rules(), corpus, out, str(tmp_path / "c1")).awaitTermination()
        return count()

    def count():
        issue_count_stream(spark, out, str(tmp_path / "c2")).awaitTermination()
        return {(r.book_id, r.rule): r.n for r in issue_counts_now(spark, out).collect()}

    comma, character = ("a", "ascii_comma_in_chinese"), ("a", "contextual_traditional_character")
    assert land((1, "我們走,好")) == {comma: 1, character: 1}
    assert land((2, "你,好"), (3, "他,她")) == {comma: 3, character: 1}
    again = spark.read.parquet(f"{out}/issues/batch=1").collect()
    schema = spark.read.parquet(f"{out}/issues/batch=1").schema
    spark.createDataFrame(again, schema).write.mode("overwrite").parquet(f"{out}/issues/batch=1")
    assert count() == {comma: 3, character: 1}
    whole = read_batches(spark, out, "issues").groupBy("book_id", "rule").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {(r.book_id, r.rule): r.n for r in whole} == {comma: 3, character: 1}
