import pytest
from pyspark.sql import functions as F

from inkmill.operators.assembling import join_pages, readable_pages
from inkmill.operators.dedup import mark_duplicates
from inkmill.operators.keyed import lookup_by_key, with_position
from inkmill.operators.selecting import range_spans, select_range, single_chapter, with_process_order
from inkmill.plans.ingest import IngestOptions, duplicate_report, failure_report, ingest, ingest_summary
from inkmill.sources import sinks
from inkmill.sources.chapters import read_chapter_files
from inkmill.sources.state import latest_state, read_state, state_from_payload, state_payloads, write_state
from inkmill.streaming.ingest import LANDED, current_state, ingest_stream, issue_stream, landed_chapters, read_batches

CATALOG = "book_id string, chapter_index int, title string, url string, number bigint"


def catalog(spark, rows):
    return spark.createDataFrame(rows, CATALOG).repartition(3)


def test_hot_keys_are_split(spark):
    rows = spark.range(1000).select((F.col("id") % 7 * (F.col("id") % 2)).alias("k"), "id").repartition(4)
    answers = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).filter("k <> 3")
    plain = sorted(tuple(r) for r in rows.join(answers.drop("n"), "k", "left").collect())
    got = lookup_by_key(rows, answers.drop("n"), ["k"])
    assert sorted(tuple(r) for r in got.select("k", "id", "least").collect()) == plain


def test_positions(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 37 % 500).alias("o"))
    got = with_position(rows, ["g"], F.col("o"), width=20).collect()
    for g in range(3):
        ordered = sorted((r.o, r.position) for r in got if r.g == g)
        assert [p for _, p in ordered] == list(range(1, len(ordered) + 1))


def test_ranges(spark):
    numbers = [1, None, 3, 5, None, 7, 9]
    rows = [("a", i, f"t{i}", f"a/{i}", n) for i, n in enumerate(numbers, 1)] + [("b", i, "t", f"b/{i}", None) for i in range(1, 6)]
    df = catalog(spark, rows)
    got = sorted((r.book_id, r.chapter_index) for r in select_range(df, 3, 7).collect())
    assert got == [("a", 3), ("a", 4), ("a", 5), ("a", 6), ("b", 3), ("b", 4), ("b", 5)]
    errors = {r.book_id: r.selection_error for r in range_spans(df, 6, 6).collect()}
    assert errors == {"a": "no chapter in range", "b": "start lies behind the last chapter"}
    assert {r.selection_error for r in range_spans(df, 4, 2).collect()} == {"end lies before start"}


def test_single_chapter(spark):
    df = catalog(spark, [("a", 4, "四", "http://x/4/", 4)])
    asked = spark.createDataFrame([("a", "http://x/4"), ("a", "http://x/9"), ("a", "http://x/8")], "book_id string, url string")
    titles = spark.createDataFrame([("http://x/9", "页名"), ("http://x/8", "")], "url string, title string")
    got = {r.url: (r.chapter_index, r.title) for r in single_chapter(df, asked, titles).collect()}
    assert got == {"http://x/4/": (4, "四"), "http://x/9": (1, "页名"), "http://x/8": (1, "单章")}


def run(spark, bodies, state=None, **options):
    rows = [("a", i, f"t{i}", f"a/{i}", i) for i in range(1, len(bodies) + 1)]
    texts = spark.createDataFrame(
        [("a", f"a/{i}", b, "broken" if b is None else None) for i, b in enumerate(bodies, 1)],
        "book_id string, url string, text string, error string",
    ).repartition(2)
    return ingest(catalog(spark, rows), texts, state, IngestOptions(**options)), catalog(spark, rows)


def statuses(done):
    return {r.chapter_index: (r.status, r.first_url) for r in done.outcomes.collect()}


def test_runs_over_state(spark):
    first, rows = run(spark, ["x y", "xy", None, "z"])
    assert statuses(first) == {
        1: ("completed", None), 2: ("duplicate", "a/1"), 3: ("failed", None), 4: ("completed", None)
    }
    state = spark.createDataFrame(first.state.collect(), first.state.schema)
    assert [r.reason for r in failure_report(state, rows).collect()] == ["broken"]
    assert [(r.title, r.first_url) for r in duplicate_report(state, rows).collect()] == [("t2", "a/1")]
    second, _ = run(spark, ["x y", "xy", "z", "z"], state)
    assert statuses(second) == {
        1: ("skipped", None), 2: ("duplicate", None), 3: ("duplicate", "a/4"), 4: ("skipped", None)
    }
    assert tuple(ingest_summary(second.outcomes).first())[1:] == (0, 2, 2, 0)
    forced, _ = run(spark, ["x y", "xy", "new", "z"], state, force=True)
    assert statuses(forced) == {
        1: ("completed", None), 2: ("duplicate", None), 3: ("completed", None), 4: ("completed", None)
    }
    assert {r.chapter_index for r in forced.chapters.collect()} == {1, 3, 4}


def test_reverse_and_no_dedup(spark):
    done, _ = run(spark, ["s"] * 4, reverse=True)
    assert {k for k, v in statuses(done).items() if v[0] == "completed"} == {4}
    done, _ = run(spark, ["s"] * 4, deduplicate=False, limit=3)
    assert {k for k, v in statuses(done).items() if v[0] == "completed"} == {1, 2, 3}


def test_marks_keep_pointer_to_first(spark):
    rows = [("a", i, f"t{i}", f"a/{i}", "same" if i % 3 else f"own {i}") for i in range(1, 20)]
    df = spark.createDataFrame(rows, "book_id string, chapter_index int, title string, url string, text string").repartition(5)
    got = {r.chapter_index: (r.duplicate, r.first_url) for r in mark_duplicates(with_process_order(df)).collect()}
    assert got[1] == (False, None) and got[3] == (False, None) and got[17] == (True, "a/1")


def test_page_sequences(spark):
    rows = [("a", 1, p, 3, t) for p, t in enumerate(["p1", "p2", "p3", "p4"], 1)]
    rows += [("a", 2, p, None, t) for p, t in enumerate(["p1", "p 1", "p3"], 1)]
    rows += [("a", 3, p, None, t) for p, t in enumerate(["p1", "", "p3"], 1)]
    df = spark.createDataFrame(rows, "book_id string, chapter_index int, page_no int, page_total int, text string").repartition(3)
    got = {r.chapter_index: (r.text, r.pages) for r in join_pages(readable_pages(df)).collect()}
    assert got == {1: ("p1\n\np2\n\np3", 3), 2: ("p1", 1), 3: ("p1", 1)}
    with pytest.raises(ValueError):
        readable_pages(df, 0)


def test_state_payload(spark):
    good = '{"version":1,"completed":["u1"],"failures":{"u2":{"title":"t","reason":"r"}},"duplicates":{"u3":{"title":"t","hash":"h","first_title":"f","first_url":"u1"}}}'
    rows = spark.createDataFrame([("a", good), ("b", "broken")], "book_id string, json string")
    got = {r.url: r.status for r in latest_state(state_from_payload(rows)).collect()}
    assert got == {"u1": "completed", "u2": "failed", "u3": "duplicate"}


def test_files(spark, tmp_path):
    books = spark.createDataFrame([("书", "书", "", "http://x/")], "book_id string, title string, author string, source_url string")
    chapters = spark.createDataFrame(
        [("书", 2, "二", " 乙 "), ("书", 1, "一:?", "甲\n\n甲")], "book_id string, chapter_index int, title string, text string"
    )
    names = {r.file_name for r in sinks.chapter_files(chapters).collect()}
    assert names == {"0001_一__.txt", "0002_二.txt"}
    sinks.write_chapters(chapters, str(tmp_path / "chapters"))
    sinks.write_books(books, chapters, str(tmp_path / "books"))
    parts = sorted((tmp_path / "books").rglob("part-*.txt"))
    text = "".join(p.read_text(encoding="utf-8") for p in parts)
    assert text == "书\n作者：未知\n来源：http://x/\n\n一:?\n\n甲\n\n甲\n\n二\n\n乙\n\n"
    folder = tmp_path / "in" / "某书+1" / "chapters"
    folder.mkdir(parents=True)
    (folder / "0003_第三章.txt").write_text("正文\n\n二", encoding="utf-8")
    (folder / "附录.txt").write_text("附", encoding="utf-8")
    rows = {(r.book_id, r.chapter_index, r.title, r.text) for r in read_chapter_files(spark, str(tmp_path / "in")).collect()}
    assert rows == {("某书+1", 3, "第三章", "正文\n\n二"), ("某书+1", 10**9, "附录", "附")}
    with pytest.raises(FileNotFoundError):
        read_chapter_files(spark, str(tmp_path / "nothing"))


def test_reports(spark, tmp_path):
    from inkmill.plans.clean import clean

    rows = spark.createDataFrame([("b", 1, "一", "好,坏\n\n12\n\n嗯"), ("b", 2, "二", "无事")], "book_id string, chapter_index int, title string, text string")
    done = clean(rows, mode="auto")
    sinks.write_reports(done.chapters, done.issues, str(tmp_path), "auto")
    lines = [r.line for r in sinks.report_lines(done.chapters, done.issues, "auto").orderBy("place").collect()]
    assert lines == ["小说内容检测报告", "=" * 24, "处理模式：auto", "章节数量：2", "问题总数：2", "自动修改：2", "", "分类统计：",
                     "  punctuation: 1", "  web_residue: 1", "", "置信度统计：", "  high: 2"]
    csv = spark.read.csv(str(tmp_path / "clean_report_csv"), header=True)
    assert csv.columns[:11] == sinks.REPORT_COLUMNS and csv.count() == 2
    assert spark.read.json(str(tmp_path / "clean_report_json")).count() == 2
    blocks = {r.chapter_index: r.line for r in sinks.failure_lines(
        spark.createDataFrame([("b", 1, "一", "u", "坏")], "book_id string, chapter_index int, title string, url string, reason string")).collect()}
    assert blocks == {-1: "失败章节记录\n", 1: "一\nu\n失败原因：坏\n"}


def test_streamed_batches(spark, tmp_path):
    landed, out = tmp_path / "landed", tmp_path / "out"
    spark.createDataFrame([("a", 1, "一", "a/1", 1, "x", None), ("a", 2, "二", "a/2", 2, None, "broken")], LANDED).coalesce(1).write.parquet(str(landed))
    stream = landed_chapters(spark, str(landed))
    ingest_stream(stream, str(out), str(tmp_path / "check")).awaitTermination()
    spark.createDataFrame([("a", 3, "三", "a/3", 3, " x", None), ("a", 2, "二", "a/2", 2, "y", None)], LANDED).coalesce(1).write.mode("append").parquet(str(landed))
    ingest_stream(stream, str(out), str(tmp_path / "check")).awaitTermination()
    state = {r.url: (r.status, r.first_url) for r in current_state(spark, str(out)).collect()}
    assert state == {"a/1": ("completed", None), "a/2": ("completed", None), "a/3": ("duplicate", "a/1")}
    assert {r.chapter_index for r in read_batches(spark, str(out), "chapters").collect()} == {1, 2}


def test_streamed_issues(spark, tmp_path):
    from inkmill.sources.rules import load_rules

    corpus = spark.createDataFrame([("a", 9, "我们去。我们来。")], "book_id string, chapter_index int, text string")
    landed = tmp_path / "landed"
    spark.createDataFrame([("a", 1, "一", "a/1", 1, "我們走,好", None)], LANDED).write.parquet(str(landed))
    issue_stream(landed_chapters(spark, str(landed)), load_rules(), corpus, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = {(r.rule, r.confidence_score) for r in read_batches(spark, str(tmp_path / "out"), "issues").collect()}
    assert got == {("ascii_comma_in_chinese", 0.95), ("contextual_traditional_character", 0.96)}


def test_state_goes_out_and_comes_back(spark, tmp_path):
    done, _ = run(spark, ["x", "x", None, "z"])
    write_state(done.state, str(tmp_path / "state"))
    kept = read_state(spark, str(tmp_path / "state"))
    back = state_from_payload(state_payloads(kept))
    columns = ["book_id", "url", "status", "digest", "first_url"]
    rows = {tuple(r) for r in back.select(*columns).collect()}
    want = {tuple(r) for r in kept.select(*columns).collect()}
    # A snapshot lists completed chapters by URL alone.
    assert rows == {(b, u, s, d if s == "duplicate" else None, f) for b, u, s, d, f in want}
    assert len(rows) == 4
