"""Outcomes of a run are worked out from hashes: texts are read once, and move only for the chapters that are kept."""

from pyspark.sql import functions as F

from inkmill.plans.ingest import ingest
from inkmill.session import stored
from inkmill.streaming import ingest as batches


def test_texts_are_worked_out_once_for_all_outcomes(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    rows = [("b", i, f"t{i}", f"u{i}", None, ["a b", "ab", "", "c", None][i]) for i in range(5)]
    table = spark.createDataFrame(rows, "book_id string, chapter_index long, title string, url string, number long, text string")
    catalog = table.drop("text")
    texts = table.filter("url <> 'u4'").select("book_id", "url", counted(F.col("text")).alias("text"), F.lit(None).cast("string").alias("error"))
    done = ingest(catalog, texts)
    told = {r.url: (r.status, r.reason, r.first_url) for r in done.outcomes.collect()}
    assert told == {
        "u0": ("completed", None, None), "u1": ("duplicate", None, "u0"), "u2": ("failed", "no text", None),
        "u3": ("completed", None, None), "u4": ("failed", "no text", None),
    }
    assert read.value == 4
    assert {(r.url, r.text) for r in done.chapters.collect()} == {("u0", "a b"), ("u3", "c")}


def test_a_batch_goes_on_from_rows_written_once(spark, tmp_path, monkeypatch):
    names = []
    monkeypatch.setattr(batches, "stored", lambda df, name: names.append(name) or stored(df, name))
    rows = [("b", i, f"t{i}", f"u{i}", None, "x", None) for i in range(3)]
    batch = spark.createDataFrame(
        rows, "book_id string, chapter_index long, title string, url string, number long, text string, error string"
    )
    batches.ingest_batch(batch, 0, str(tmp_path))
    assert names == ["batch"]
    assert sorted(r.status for r in batches.current_state(spark, str(tmp_path)).collect()) == ["completed", "duplicate", "duplicate"]
