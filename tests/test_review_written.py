"""What review writes down."""

from inkmill.suite import review


def _documents(spark, folder, texts):
    rows = [(i, f"s{i % 2}", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_changes_are_written_without_what_they_repeat(spark, tmp_path):
    changed = review._changed(spark, _documents(spark, tmp_path, ["also real elephants", "", "halls"]))
    assert not {"issues", "cleaned_text", "target_text"} & set(changed.columns)
    assert changed.count() == 3
